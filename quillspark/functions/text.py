"""Text functions on columns: normalise, tokenise, split, count. All of it stays in the JVM but ``normalize``."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Unicode has it, and the four separators U+001C to U+001F.
SPACE = r"(?U)[\s\x1c-\x1f]"
TOKEN = r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)?"
TOKEN_LETTER_SUFFIX = r"[\p{L}\p{N}]+(?:'[\p{L}]+)?"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
URL = r"(?iU)\bhttps?://\S+|\bwww\.\S+"
MENTION = r"(?U)@\w+|(?:^|\s)/?[ur]/[A-Za-z0-9_-]+"
HASHTAG = r"(?U)#\w+"
LIST_MARKER = r"(?U)^\s*(?:•|-|\*|\d+[.)])\s+"
_GONE = re.compile("[​-‍﻿]")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fixed(value: Column) -> Column:
    """``value`` as a column that the optimizer does not take apart: without this, each use of a struct's field would repeat the field's expression."""
    return let(value, lambda x: x)


def normalize_value(text: str | None) -> str:
    """NFKC, without zero-width characters and carriage returns, trimmed."""
    text = text or ""
    if not text.isascii():
        text = _GONE.sub("", unicodedata.normalize("NFKC", text)).replace("\xa0", " ")
    return text.replace("\r", "").strip()


@F.pandas_udf(T.StringType())  # a type object: a string would need a session at import
def normalize(text: pd.Series) -> pd.Series:
    return text.map(normalize_value, na_action=None) if len(text) else text


def normal(text: Column) -> Column:
    """``normalize`` of text without nulls; what is ASCII needs no tables of characters and stays in the JVM."""
    other = F.rlike(text, F.lit("[^\\x00-\\x7f]"))
    return F.coalesce(F.when(~other, strip(F.replace(text, F.lit("\r"), F.lit("")))), normalize(F.when(other, text)))


def apostrophes(text: Column) -> Column:
    return F.translate(text, "‘’", "''")


def collapse(text: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(text, SPACE + "+", " ")


def tokenize(text: Column, pattern: str = TOKEN) -> Column:
    return F.transform(F.regexp_extract_all(apostrophes(text), F.lit(pattern), F.lit(0)), F.lower)


def count_tokens(text: Column) -> Column:
    return F.regexp_count(apostrophes(text), F.lit(TOKEN))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def _non_empty(pieces: Column) -> Column:
    return F.filter(F.transform(pieces, strip), lambda s: s != "")


def sentences(cleaned: Column) -> Column:
    """For features: pieces between runs of ``.!?`` of collapsed text."""
    return _non_empty(F.split(cleaned, "[.!?]+"))


def sentences_cue(raw: Column) -> Column:
    """For cues: pieces after ``.!?`` and white space, or at newlines, of text as it is."""
    return _non_empty(F.split(raw, r"(?U)(?<=[.!?])\s+|\n+"))


def paragraphs(raw: Column) -> Column:
    return F.split(raw, r"\n+")


def phrase_pattern(phrase: str) -> str:
    return r"(^|[^a-z0-9])" + re.escape(phrase).replace("\\ ", " ").replace("\\'", "'").replace("\\-", "-") + r"(?=$|[^a-z0-9])"


def phrase_text(text: Column) -> Column:
    return F.lower(apostrophes(text))


def phrase_count(lowered: Column, phrase: str) -> Column:
    # most texts hold few of the phrases: a plain search comes before the regular expression
    hits = F.regexp_count(lowered, F.lit(phrase_pattern(phrase)))
    return F.when(F.contains(lowered, F.lit(phrase)), hits).otherwise(F.lit(0))


def phrase_hits(lowered: Column, phrases: list[str]) -> Column:
    """Each phrase's occurrences between non-alphanumerics, summed; overlapping phrases count each."""
    return sum((phrase_count(lowered, p) for p in phrases[1:]), phrase_count(lowered, phrases[0]))


def phrase_match(lowered: Column, phrases: list[str]) -> Column:
    """The phrases that occur, in list order."""
    found = [F.when(F.contains(lowered, F.lit(p)) & F.rlike(lowered, F.lit(phrase_pattern(p))), F.lit(p)) for p in phrases]
    return F.filter(F.array(*found), lambda p: p.isNotNull())


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def utf16_units(text: Column) -> Column:
    """Code units of UTF-16 as integers."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0))
    return F.transform(units, lambda u: F.conv(u, 16, 10).cast("long"))


def fnv1a(units: Column) -> Column:
    """32-bit FNV-1a over an array of code units."""
    return F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, u: (h.bitwiseXOR(u) * 16777619).bitwiseAND(F.lit(4294967295).cast("long")))


def fingerprint(kind: Column, text: Column) -> Column:
    """FNV-1a of kind, newline and text, in base 36."""
    return F.lower(F.conv(fnv1a(utf16_units(F.concat(kind, F.lit("\n"), text))).cast("string"), 10, 36))


def latin_ratio(raw: Column) -> Column:
    letters = F.regexp_count(raw, F.lit(r"\p{L}"))
    return F.coalesce(F.try_divide(F.regexp_count(raw, F.lit("[A-Za-z]")).cast("double"), letters), F.lit(0.0))


def language_support(latin: Column, has_letters: Column, words: Column, stopword_ratio: Column) -> Column:
    """state, latinRatio, reason."""
    state = lambda s, r: F.struct(F.lit(s).alias("state"), latin.alias("latinRatio"), F.lit(r).alias("reason"))
    return (
        F.when(~has_letters, state("unsupported", "no letter evidence"))
        .when(latin < 0.72, state("unsupported", "non-Latin or mixed-script text"))
        .when((words >= 20) & (stopword_ratio < 0.055), state("uncertain", "English language could not be established"))
        .otherwise(state("supported", ""))
    )


def excerpt(text: Column) -> Column:
    """At most 110 UTF-16 units: longer texts give their first 107 and an ellipsis."""
    units = F.encode(text, "UTF-16LE")
    return F.when(utf16_length(text) > 110, F.concat(F.decode(F.substring(units, 1, 214), "UTF-16LE"), F.lit("…"))).otherwise(text)


def percent(signal: Column) -> Column:
    return F.floor(signal * 100 + 0.5)


def list_markers(raw: Column) -> Column:
    return F.size(F.filter(F.split(raw, "\n"), lambda x: F.rlike(x, F.lit(LIST_MARKER))))


def proper_nounish(cleaned: Column) -> Column:
    """Capitalised words that neither open the text nor follow a word that ends a sentence."""
    words = F.filter(F.split(cleaned, " "), lambda w: w != "")
    hit = lambda w, i, ws: (i > 0) & F.rlike(w, F.lit("^[^A-Za-z]*[A-Z][a-z]+")) & ~F.rlike(F.get(ws, i - 1), F.lit("[.!?]$"))
    return let(words, lambda ws: F.size(F.filter(ws, lambda w, i: hit(w, i, ws))))


PUNCTUATION = {
    "comma": ",", "colon": ":", "semicolon": ";", "exclamation": "!", "question": r"\?", "ellipsis": r"\.\.\.|…",
    "quote": "[\"'“”‘’]", "parenthesis": "[()]",
}


def punctuation(cleaned: Column) -> Column:
    return F.struct(*(F.regexp_count(cleaned, F.lit(p)).alias(k) for k, p in PUNCTUATION.items()))


def mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) > 0, total / F.size(values)).otherwise(F.lit(0.0))


def variation(values: Column) -> Column:
    """Population standard deviation over mean; 0 for no values or a mean of 0."""

    def of(m: Column) -> Column:
        squares = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))
        return F.when((F.size(values) == 0) | (m == 0), F.lit(0.0)).otherwise(F.sqrt(squares / F.size(values)) / m)

    return let(mean(values), of)


def repeat_ratio(items: Column) -> Column:
    """One less the share of distinct items; 0 for none."""
    return let(items, lambda x: F.when(F.size(x) == 0, F.lit(0.0)).otherwise(1.0 - F.size(F.array_distinct(x)) / F.size(x)))


def ngrams(tokens: Column, n: int) -> Column:
    gram = lambda i: F.concat_ws(" ", *(F.get(tokens, i + j) for j in range(n)))
    return F.when(F.size(tokens) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(tokens) - n, F.lit(0))), gram))


def token_stats(tokens: Column, window: int = 25) -> Column:
    """distinct, hapax, top (most frequent token's count), mattr_sum (distinct tokens over all windows).

    Tokens are sorted with their positions once. Runs of equal tokens give the counts; a token at i with
    the same token before it at p counts once in each window that starts after p and reaches i.
    """

    def of(p: Column) -> Column:
        n = F.size(p)
        starts = F.transform(F.filter(F.transform(p, lambda x, i: F.struct(i.alias("i"), (~F.coalesce(F.get(p, i - 1)["t"] == x["t"], F.lit(False))).alias("new"))), lambda x: x["new"]), lambda x: x["i"])
        runs = let(starts, lambda s: F.transform(s, lambda i, k: F.coalesce(F.get(s, k + 1), n) - i))
        windows = F.greatest(n - window, F.lit(0))

        def share(x: Column, i: Column) -> Column:
            before = F.get(p, i - 1)
            prev = F.when(before["t"] == x["t"], before["i"] + 1).otherwise(F.lit(0))
            return F.greatest(F.lit(0), F.least(x["i"], windows) - F.greatest(prev, x["i"] - (window - 1), F.lit(0)) + 1)

        total = F.aggregate(F.transform(p, share), F.lit(0).cast("long"), lambda a, x: a + x)
        return let(runs, lambda r: F.struct(
            F.size(r).alias("distinct"), F.size(F.filter(r, lambda x: x == 1)).alias("hapax"),
            F.coalesce(F.array_max(r), F.lit(0)).alias("top"), total.alias("mattr_sum")))

    return let(F.array_sort(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i")))), of)
