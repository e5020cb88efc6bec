"""All counts, features, metrics, cue measures and segments of texts, a batch at a time.

The texts of an Arrow batch are worked off in blocks of about BLOCK characters. A block's tokens and marks (ends of
sentences, lines) go into one flat array of numbers; what is counted per text (distinct tokens, n-grams, windows,
sentences, characters, hashed n-grams) is counted for all of its texts at once, by sorting or hashing
numbers that carry the text's own, and summed per text. Python touches a text only to normalise, split and scan it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from quillspark.functions import lexicons as lx

# by name: this module goes to Python workers whole, and must not take column functions with it
from quillspark.functions.phrases import scan
from quillspark.functions.text import normalize_value as normalized
from quillspark.functions.vectors import DIMENSION, profiles

_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
#: Tokens, ends of sentences with the white space after them, and line ends.
_MARKED = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[.!?]+\s*|\n+")
_CUE_ENDS = re.compile(r"(?<=[.!?])\s+|\n+")
_PIECE = re.compile(r"[^.!?\n]+(?:[.!?]+|\n+|\Z)")
_LIST = re.compile(r"\s*(?:•|-|\*|\d+[.)])\s+")
_URL, _MENTION, _HASHTAG = re.compile(r"\bhttps?://\S+|\bwww\.\S+", re.I), re.compile(r"@\w+|(?:^|\s)/?[ur]/[A-Za-z0-9_-]+"), re.compile(r"#\w+")
_STOP, _FIRST, _SECOND, _IGNORED = map(frozenset, (lx.STOPWORDS, lx.FIRST_PERSON, lx.SECOND_PERSON, lx.IGNORED_STARTERS))
_MARKS = {"comma": ",", "colon": ":", "semicolon": ";", "exclamation": "!", "question": "?", "quote": "\"'“”‘’", "parenthesis": "()", "ellipsis": "…"}
METRICS = (
    "wordCount charCount sentenceCount avgSentenceLen sentenceLenCV wordLenCV paragraphLenCV typeTokenRatio mattr25 hapaxRatio stopwordRatio bigramRepeatRatio trigramRepeatRatio charTrigramRepeatRatio "
    "sentenceStarterRepeatRatio topWordShare listMarkerCount urlCount mentionCount hashtagCount numberTokenRatio properNounishRatio latinRatio isReply"
).split()
#: Segments: closed at CLOSE tokens, a tail under TAIL joined to the last, those under LEAST left out, MOST at most, for texts of FROM_TOKENS.
CLOSE, TAIL, LEAST, MOST, FROM_TOKENS, WINDOW = 28, 15, 15, 8, 70, 25
#: Characters and texts of a block; a longer text is a block of its own.
BLOCK, TEXTS = 1 << 19, 4096
#: Kinds of characters, after the marks in their order.
_NEWLINE, _LATIN, _LETTER, _EMOJI, _KINDS = 9, 10, 11, 12, 16
_held: dict[str, np.ndarray] = {}


def _kinds() -> np.ndarray:
    """The kind of each code point; made once by each worker."""
    if "kinds" not in _held:
        out = np.zeros(0x110000, dtype=np.uint8)
        out[[c for c in range(0x110000) if chr(c).isalpha()]] = _LETTER
        out[0x1F300:0x1FB00] = out[0x2600:0x27C0] = _EMOJI
        out[[c for c in range(128) if chr(c).isalpha()]] = _LATIN
        out[10] = _NEWLINE
        for i, marks in enumerate(_MARKS.values(), 1):
            out[[ord(c) for c in marks]] = i
        _held["kinds"] = out
    return _held["kinds"]


def straight(text: str) -> str:
    return text if text.isascii() else text.replace("‘", "'").replace("’", "'")


def count_tokens(text: str) -> int:
    return len(_TOKEN.findall(straight(text)))


def has_tokens(text: str, least: int) -> bool:
    """Whether a text has so many tokens; it is read no further than that."""
    return sum(1 for _ in islice(_TOKEN.finditer(straight(text)), least)) >= least


def blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about BLOCK characters, and at most TEXTS of them."""
    i = n = 0
    for j, t in enumerate(texts):
        if j > i and (n + len(t) > BLOCK or j - i == TEXTS):
            yield i, j
            i, n = j, 0
        n += len(t)
    if i < len(texts):
        yield i, len(texts)


def _flat(texts: list[str], coding: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All units of texts, and where each text's begin (and the last ends)."""
    units = np.frombuffer("".join(texts).encode(coding, "surrogatepass"), dtype=kind)
    sizes = [len(t) for t in texts] if coding == "utf-32-le" or len(units) == sum(map(len, texts)) else [len(t.encode(coding, "surrogatepass")) // 2 for t in texts]
    return units, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(b)), where=b > 0)


def _repeats(n: np.ndarray, different: np.ndarray) -> np.ndarray:
    return np.where(n > 0, 1.0 - _share(different, n), 0.0)


class Batch:
    """The measures of texts; ``raws`` are normalised texts of one block."""

    def __init__(self, raws: list[str], replies: list[bool]):
        self.n, self.raws, self.replies = len(raws), raws, replies
        self.cleaned = [" ".join(r.split()) for r in raws]
        self._tokens()
        self._characters()
        self._values()

    def _sum(self, text: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(text, weights, self.n)

    def _distinct(self, text: np.ndarray, *columns: np.ndarray) -> np.ndarray:
        """How many different rows of numbers (each below ``self.size``, or -1) each text has."""
        key, width = text.astype(np.int64), max(self.n, 1)
        for c in columns:
            if width * (self.size + 1) >= 2**62:
                key = np.unique(key, return_inverse=True)[1]
                width = int(key.max(initial=0)) + 1
            key = key * (self.size + 1) + (c + 1)
            width *= self.size + 1
        order = pd.Series(key).drop_duplicates().index.to_numpy()
        return self._sum(text[order])

    def _variation(self, text: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean, and standard deviation over mean, of each text's values."""
        n = self._sum(text)
        mean = _share(self._sum(text, values), n)
        away = values - mean[text]
        return mean, _share(np.sqrt(_share(self._sum(text, away * away), n)), mean)

    def _tokens(self) -> None:
        found = [_MARKED.findall(straight(r)) for r in self.raws]
        text = np.repeat(np.arange(self.n), [len(f) for f in found])
        column = pa.array(list(chain.from_iterable(found)), pa.string()).dictionary_encode()
        spelled, at = column.dictionary, column.indices.to_numpy()
        holds = lambda strings, pattern: pc.match_substring_regex(strings, pattern).to_numpy(zero_copy_only=False)
        ends, lines, spaced = holds(spelled, "^[.!?]"), holds(spelled, "\n"), holds(spelled, r"^[.!?]+[^.!?]")
        numbers: dict[str, int] = {}
        number = np.array([numbers.setdefault(t.lower(), len(numbers)) for t in spelled.to_pylist()], dtype=np.int64)
        self.words, self.size = list(numbers), len(numbers)
        token = ~(ends | lines)[at]
        self.text, self.ids = text[token], number[at][token]
        # what a token belongs to: the number of ends before it
        self.sentence, self.paragraph, self.cue_sentence = (np.cumsum(m[at])[token] for m in (ends, lines, (ends & spaced) | lines))
        self.first = np.searchsorted(self.text, np.arange(self.n + 1))
        words = pa.array(self.words, pa.string())
        self.stop, self.person1, self.person2 = (np.zeros(self.size, dtype=bool) for _ in range(3))
        for flags, own in ((self.stop, _STOP), (self.person1, _FIRST), (self.person2, _SECOND)):
            flags[[numbers[w] for w in own if w in numbers]] = True
        self.contracted, self.numeral = holds(words, "'"), holds(words, r"\p{Nd}")
        self.lengths = (pc.utf8_length(words).to_numpy() - pc.count_substring(words, "'").to_numpy()).astype(np.int64)

    def tokens(self) -> list[list[str]]:
        words = [self.words[i] for i in self.ids.tolist()]
        return [words[a:b] for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True)]

    def _runs(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First tokens and lengths of runs of one text's tokens that belong to the same."""
        new = np.ones(len(of), dtype=bool)
        new[1:] = (np.diff(of) != 0) | (np.diff(self.text) != 0)
        first = np.flatnonzero(new)
        return first, np.diff(np.append(first, len(of)))

    def _characters(self) -> None:
        points, at = _flat(self.raws, "utf-32-le", "<u4")
        text = np.repeat(np.arange(self.n), np.diff(at))
        self.marks = np.bincount(text * _KINDS + _kinds()[points], minlength=self.n * _KINDS).reshape(self.n, _KINDS)
        self.wide = self._sum(text[points > 0xFFFF])
        # words after a word that ends no sentence, whose first ASCII letter is a capital before a small one
        points, at = _flat(self.cleaned, "utf-32-le", "<u4")
        space = np.flatnonzero(points == 32)
        owner = np.searchsorted(at, space, side="right") - 1
        end = np.minimum(np.append(space[1:], len(points)), at[owner + 1]) if len(space) else space
        letter = np.flatnonzero(((points | 32) >= 97) & ((points | 32) <= 122) & (points < 128))
        nth = np.searchsorted(letter, space)
        one = np.append(letter, len(points) + 2)[nth]
        padded = np.append(points, [0, 0, 0, 0])
        small = padded[np.minimum(one + 1, len(points) + 1)]
        capital = padded[np.minimum(one, len(points) + 1)]
        proper = (one + 1 < end) & (capital >= 65) & (capital <= 90) & (small >= 97) & (small <= 122) & ~np.isin(padded[np.maximum(space - 1, 0)], [33, 46, 63])
        self.proper = self._sum(owner[proper])
        lowered = [c.lower() for c in self.cleaned]
        self.units, self.unit_at = _flat(lowered, "utf-16-le", "<u2")
        self.lowered = [straight(t) for t in lowered]

    def _char_trigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """All and distinct unit trigrams of each text."""
        u, at = self.units.astype(np.uint64), self.unit_at
        owner = np.repeat(np.arange(self.n, dtype=np.uint64), np.diff(at))
        whole = owner[2:] == owner[:-2]
        key = ((owner[:-2] << np.uint64(48)) | (u[:-2] << np.uint64(32)) | (u[1:-1] << np.uint64(16)) | u[2:])[whole]
        return np.maximum(np.diff(at) - 2, 0), self._sum((pd.unique(key) >> np.uint64(48)).astype(np.int64))

    def _window_types(self, words: np.ndarray) -> np.ndarray:
        """Distinct tokens summed over all windows: a token counts once in each that starts after its last place and reaches it."""
        place = np.arange(len(self.text)) - self.first[self.text]
        order = np.argsort(self.text * max(self.size, 1) + self.ids, kind="stable")
        same = np.zeros(len(order), dtype=bool)
        same[1:] = (np.diff(self.text[order]) == 0) & (np.diff(self.ids[order]) == 0)
        last = np.full(len(order), -1)
        last[order[1:]] = np.where(same[1:], place[order[:-1]], -1)
        begin = np.maximum(np.maximum(last + 1, place - WINDOW + 1), 0)
        most = np.maximum(words - WINDOW, 0)[self.text]
        return self._sum(self.text, np.maximum(0, np.minimum(place, most) - begin + 1))

    def _values(self) -> None:
        n, text, ids = self.n, self.text, self.ids
        words = self._sum(text)
        pair = pd.Series(text * max(self.size, 1) + ids).value_counts(sort=False)
        owner, count = pair.index.to_numpy() // max(self.size, 1), pair.to_numpy()
        types, once, top = self._sum(owner), self._sum(owner[count == 1]), np.zeros(n, np.int64)
        np.maximum.at(top, owner, count)
        first, size = self._runs(self.sentence)
        sentences = self._sum(text[first])
        mean, sentence_cv = self._variation(text[first], size)
        second = np.where(size > 1, ids[np.minimum(first + 1, max(len(ids) - 1, 0))], -1) if len(ids) else ids
        starters = self._distinct(text[first], ids[first], second)
        lines, line_size = self._runs(self.paragraph)
        _, paragraph_cv = self._variation(text[lines], line_size)
        whole = self.lengths[ids] > 0
        _, word_cv = self._variation(text[whole], self.lengths[ids][whole])
        pairs, triples = text[1:] == text[:-1], text[2:] == text[:-2]
        two = _repeats(np.maximum(words - 1, 0), self._distinct(text[1:][pairs], ids[:-1][pairs], ids[1:][pairs]))
        three = _repeats(np.maximum(words - 2, 0), self._distinct(text[2:][triples], ids[:-2][triples], ids[1:-1][triples], ids[2:][triples]))
        all_trigrams, trigrams = self._char_trigrams()
        char_repeats, starter_repeats = _repeats(all_trigrams, trigrams), _repeats(sentences, starters)
        letters, latin = self.marks[:, _LATIN] + self.marks[:, _LETTER], self.marks[:, _LATIN]
        chars = np.array([len(c) for c in self.cleaned], dtype=np.int64) + self.wide
        ttr = _share(types, words)
        mattr = np.where(words > WINDOW, _share(self._window_types(words), WINDOW * (words - WINDOW + 1)), ttr)
        average = np.where(mean > 0, mean, words)
        count_of = lambda keep: self._sum(text[keep[ids]])
        stop, hapax, top_share = _share(count_of(self.stop), words), _share(once, words), _share(top, words)
        marks = {k: self.marks[:, i] for i, k in enumerate(_MARKS, 1)}
        marks["ellipsis"] = marks["ellipsis"] + np.array([c.count("...") for c in self.cleaned], dtype=np.int64)
        self.lists = np.array([sum(1 for line in r.split("\n") if _LIST.match(line)) for r in self.raws], dtype=np.int64)
        if_in = lambda pattern, *signs: np.array([len(pattern.findall(c)) if any(s in low for s in signs) else 0 for c, low in zip(self.cleaned, self.lowered, strict=True)], dtype=np.int64)
        urls, mentions, hashtags = if_in(_URL, "://", "www."), if_in(_MENTION, "@", "u/", "r/"), if_in(_HASHTAG, "#")
        self.word_count, self.has_letters = words, letters > 0
        self.metrics = np.column_stack([
            words, chars, np.maximum(1, sentences), average, sentence_cv, word_cv, paragraph_cv, ttr, mattr, hapax, stop, two, three, char_repeats, starter_repeats, top_share,
            self.lists, urls, mentions, hashtags, _share(count_of(self.numeral), words), _share(self.proper, words), _share(latin, letters), np.array(self.replies, dtype=np.float64)]).astype(np.float64)
        families = np.zeros((n, 4))
        for i, low in enumerate(self.lowered):
            for family, _ in scan(low):
                if family < 4:
                    families[i, family] += 1
        per100 = lambda x: np.where(words > 0, x * 100.0 / np.maximum(words, 1), 0.0)
        raw_units = np.array([len(r) for r in self.raws], dtype=np.int64) + self.wide
        buzz, hedge, transition, template = families.T
        features = {
            "aiHedgePresent": hedge > 0, "buzzPer100w": per100(buzz) / 6, "templatePer100w": per100(template) / 6, "discoursePer100w": per100(transition) / 10,
            "bigramRepeatRatio": two, "trigramRepeatRatio": three, "sentenceStarterRepeatRatio": starter_repeats, "charTrigramRepeatRatio": char_repeats, "typeTokenRatio": ttr, "mattr25": mattr, "hapaxRatio": hapax,
            "sentenceLenCV": sentence_cv / 2, "avgSentenceLen": average / 40, "wordLenCV": word_cv, "paragraphLenCV": paragraph_cv / 2, "contractionRatio": _share(count_of(self.contracted), words),
            "firstPersonRatio": _share(count_of(self.person1), words), "secondPersonRatio": _share(count_of(self.person2), words),
            "shortSentenceRatio": _share(self._sum(text[first][size <= 8]), sentences), "stopwordRatio": stop, "listMarkerCount": self.lists / 4,
            "newlineRatio": self.marks[:, _NEWLINE] / np.maximum(1, raw_units) / 0.15, "colonPer100w": per100(marks["colon"]) / 10, "commaPer100w": per100(marks["comma"]) / 30, "semicolonPer100w": per100(marks["semicolon"]) / 6,
            "exclamationsPer100w": per100(marks["exclamation"]) / 6, "questionsPer100w": per100(marks["question"]) / 6, "ellipsisPer100w": per100(marks["ellipsis"]) / 4, "quoteRatio": marks["quote"] / np.maximum(1, chars) / 0.08,
            "parenRatio": marks["parenthesis"] / np.maximum(1, chars) / 0.08, "punctuationVariety": sum((m > 0).astype(np.int64) for m in marks.values()) / 8.0, "emojiPresent": self.marks[:, _EMOJI] > 0, "topWordShare": top_share,
        }
        self.features = np.clip(np.column_stack([features[k] for k in lx.FEATURE_ORDER]).astype(np.float64), 0.0, 1.0)

    def profiles(self) -> np.ndarray:
        """The hashed character profile of each text (texts x DIMENSION)."""
        u = self.units.astype(np.uint32)
        u[(u == 0x2018) | (u == 0x2019)] = 39
        u[(u >= 48) & (u <= 57)] = 48
        return profiles(u, self.unit_at)

    def cues(self) -> list[dict]:
        """What the cue rubric counts, from the texts as they are (sentences here end at newlines too)."""
        content = (np.array([len(w.encode("utf-16-le")) > 4 for w in self.words], dtype=bool) & ~self.stop)[self.ids]
        text, ids = self.text[content], self.ids[content]
        n, follow = self._sum(text), text[1:] == text[:-1]
        different = self._distinct(text[1:][follow], ids[:-1][follow], ids[1:][follow])
        repeat = np.where(n >= 12, (n - 1 - different) / np.maximum(1, n - 1), 0.0)
        first, size = self._runs(self.cue_sentence)
        at = np.searchsorted(self.text[first], np.arange(self.n + 1))
        dashes = [r.count("—") + r.count("–") for r in self.raws]
        out = []
        for i, raw in enumerate(self.raws):
            own = first[at[i] : at[i + 1]]
            openers = Counter(w for w in (self.words[j] for j in self.ids[own].tolist()) if w not in _IGNORED)
            met: list[set] = [set() for _ in lx.FAMILIES]
            for family, phrase in scan(straight(raw).lower()):
                met[family].add(phrase)
            out.append({
                "matched": {k: [lx.FAMILIES[k][j] for j in sorted(m)] for k, m in zip(lx.FAMILIES, met, strict=True)},
                "sentences": {"n": sum(1 for s in _CUE_ENDS.split(raw) if s.strip()), "starters": [{"word": w, "count": c} for w, c in openers.most_common() if c >= 2], "lengths": size[at[i] : at[i + 1]].tolist()},
                "colons": int(self.marks[i, 2]), "dashes": dashes[i], "lists": int(self.lists[i]), "repeat": float(repeat[i]),
            })
        return out


def segments_of(raw: str) -> list[str]:
    """At most MOST segments of whole sentences."""
    done, open_, n, size = [], [], 0, []
    for piece in _PIECE.finditer(raw):
        piece = piece.group()
        open_.append(piece.strip())
        n += count_tokens(piece)
        if n >= CLOSE:
            done.append(" ".join(open_))
            size.append(n)
            open_, n = [], 0
            if len(done) > MOST:  # the tail can change the last one only
                break
    if open_:
        if done and n < TAIL:
            done[-1] += " " + " ".join(open_)
        else:
            done.append(" ".join(open_))
    return [s for s in done if count_tokens(s) >= LEAST][:MOST]


def excerpt(text: str) -> str:
    """At most 110 UTF-16 units: longer texts give their first 107 and an ellipsis."""
    units = text.encode("utf-16-le")
    return units[:214].decode("utf-16-le", "replace") + "…" if len(units) > 220 else text

