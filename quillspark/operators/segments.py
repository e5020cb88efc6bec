"""Segments of longer texts, scored one by one, and whether they disagree.

Segments are cut and featurised with the text that they come from (``features.measured``), at most eight of
them, and scored within its row: no text is read twice and nothing is joined.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import measures as ms
from quillspark.operators import scoring as sc

CLOSE, TAIL, LEAST, MOST, FROM_TOKENS = ms.CLOSE, ms.TAIL, ms.LEAST, ms.MOST, ms.FROM_TOKENS


@F.arrow_udf(T.ArrayType(T.StringType()))
def split(raw: pa.Array) -> pa.Array:
    """At most eight segments of whole sentences: closed at 28 tokens, a short tail joined to the last, those under 15 tokens left out."""
    return pa.array([ms.segments_of(t or "") for t in raw.to_pylist()], pa.list_(pa.string()))


def score(df: DataFrame) -> DataFrame:
    """``df`` (with parts and model) with segments (signal, words, excerpt), and the least and greatest of their scores, null without any."""
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda a, v: a + v)

    def signal(x: Column) -> Column:
        own = F.coalesce("model.intercept", F.lit(0.0)) + total(F.col("model.feature_weights"), x["features"])
        chars = F.when(F.col("model.char_weights").isNull(), F.lit(0.0)).otherwise(total(F.col("model.char_weights"), x["char_ngrams"]))
        return sc.signal(own + chars)

    each = F.transform("parts", lambda x: F.struct(signal(x).alias("signal"), x["words"].alias("words"), x["excerpt"].alias("excerpt")))
    df = df.withColumn("segments", each)
    signals = F.transform("segments", lambda x: x["signal"])
    return df.withColumns({"low": F.array_min(signals), "high": F.array_max(signals)}).drop("parts")


def mixed(low: Column, high: Column, moderate: Column, strong: Column) -> Column:
    """Whether the segments' scores lie so far apart that one label would not do."""
    return F.coalesce(((high - low >= 0.25) & (low < moderate) & (high >= strong)) | (high - low >= 0.38), F.lit(False))
