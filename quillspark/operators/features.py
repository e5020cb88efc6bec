"""The 33 bounded features, 24 metrics and the 128-part character profile of each text.

One Arrow function makes them all, and what the cue rubric and segments need, in one pass over a text
(``functions/measures``); nothing is shuffled and texts need not come back.

Defined cases: null text counts as empty; a text without tokens has ratios of 0 and one sentence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import lexicons as lx
from quillspark.functions import measures as ms
from quillspark.functions import text as tx

RAW = "raw"
_FEATURES, _METRICS = ("struct<" + ", ".join(f"{k}: double" for k in names) + ">" for names in (lx.FEATURE_ORDER, ms.METRICS))
_CUES = "struct<matched: struct<" + ", ".join(f"{k}: array<string>" for k in ("buzz", "hedge", "transition", "template", "rhetorical")) + ">, sentences: struct<n: int, starters: array<struct<word: string, count: int>>, lengths: array<int>>, colons: int, dashes: int, lists: int, repeat: double>"


def normalized(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with raw, cleaned and tokens."""
    df = df.withColumn(RAW, tx.normal(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    df = df.withColumn("cleaned", tx.collapse(F.col(RAW)))
    return df.withColumn("tokens", tx.tokenize(F.col("cleaned")))


def _arrow(schema: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(schema))


def _columns(table: np.ndarray, names: list[str]) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(table[:, i])) for i in range(len(names))], names=list(names))


def _lists(table: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(table) + 1, dtype=np.int32) * table.shape[1], pa.array(table.ravel()))


def measured(text: Column, reply: Column, vectors: bool = True, texts: bool = False, cues: bool = False, parts: bool = False, part_vectors: bool = False) -> Column:
    """features, metrics and has_letters of a text; as asked for char_ngrams, raw, cleaned and tokens, cue_measures, and parts (segments with their features)."""
    fields = {"features": _FEATURES, "metrics": _METRICS, "has_letters": "boolean"}
    fields |= {"char_ngrams": "array<double>"} if vectors else {}
    fields |= {"raw": "string", "cleaned": "string", "tokens": "array<string>"} if texts else {}
    fields |= {"cue_measures": _CUES} if cues else {}
    if parts:
        fields |= {"parts": "array<struct<features: array<double>, char_ngrams: array<double>, words: int, excerpt: string>>"}
    schema = "struct<" + ", ".join(f"{k}: {t}" for k, t in fields.items()) + ">"
    arrow = {k: _arrow(t) for k, t in fields.items()}
    with_texts = texts

    def segments(raws: list[str], given: list[str], replies: list[bool]) -> list[list[dict]]:
        """The segments of texts that are long enough, with their features; all of a block's segments are measured together."""
        cut = [ms.segments_of(r) if ms.has_tokens(t, ms.FROM_TOKENS) else [] for r, t in zip(raws, given, strict=True)]
        cut = [c if len(c) >= 2 else [] for c in cut]
        flat = [(s, r) for c, r in zip(cut, replies, strict=True) for s in c]
        rows = []
        for i, j in ms.blocks([s for s, _ in flat]):
            m = ms.Batch([ms.normalized(s) for s, _ in flat[i:j]], [r for _, r in flat[i:j]])
            chars = m.profiles().tolist() if part_vectors else [None] * m.n
            rows.extend({"features": f, "char_ngrams": c, "words": int(w), "excerpt": ms.excerpt(s)} for f, c, w, (s, _) in zip(m.features.tolist(), chars, m.word_count.tolist(), flat[i:j], strict=True))
        each = iter(rows)
        return [[next(each) for _ in c] for c in cut]

    @F.arrow_udf(schema)
    def of(text: pa.Array, reply: pa.Array) -> pa.Array:
        texts, replies = [t or "" for t in text.to_pylist()], [bool(r) for r in reply.to_pylist()]
        out: dict[str, list] = {k: [] for k in fields}
        for i, j in ms.blocks(texts):
            m = ms.Batch([ms.normalized(t) for t in texts[i:j]], replies[i:j])
            out["features"].append(_columns(m.features, lx.FEATURE_ORDER))
            out["metrics"].append(_columns(m.metrics, ms.METRICS))
            out["has_letters"].append(pa.array(m.has_letters))
            if vectors:
                out["char_ngrams"].append(_lists(m.profiles()))
            if with_texts:
                out["raw"].append(pa.array(m.raws, pa.string()))
                out["cleaned"].append(pa.array(m.cleaned, pa.string()))
                out["tokens"].append(pa.array(m.tokens(), pa.list_(pa.string())))
            if cues:
                out["cue_measures"].append(pa.array(m.cues(), arrow["cue_measures"]))
            if parts:
                out["parts"].append(pa.array(segments(m.raws, texts[i:j], replies[i:j]), arrow["parts"]))
        if not texts:
            return pa.array([], pa.struct([(k, arrow[k]) for k in fields]))
        return pa.StructArray.from_arrays([pa.concat_arrays(c) for c in out.values()], names=list(out))

    return of(text, reply)


def extract(df: DataFrame, text: str = "text", kind: str | None = "kind", vectors: bool = True, texts: bool = True, **more: bool) -> DataFrame:
    """``df`` with features, metrics and language_support; as asked for char_ngrams, raw, cleaned and tokens, and what ``measured`` gives besides."""
    reply = F.coalesce(F.col(kind) == "comment", F.lit(False)) if kind else F.lit(False)
    out = df.withColumn("__measured", measured(F.col(text).cast("string"), reply, vectors, texts, **more))
    names = out.schema["__measured"].dataType.names
    out = out.select(*[c for c in df.columns if c not in names], *(F.col(f"__measured.{k}").alias(k) for k in names))
    m = lambda k: F.col(f"metrics.{k}")
    language = tx.language_support(m("latinRatio"), F.col("has_letters"), m("wordCount"), m("stopwordRatio"))
    return out.withColumn("language_support", tx.fixed(language)).drop("has_letters")
