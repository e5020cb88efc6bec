"""The whole analysis of each text: features, score, evidence, segments, cues, label and explanation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import models as md
from quillspark.functions import text as tx
from quillspark.operators import cues, features, scoring, segments

VERSION = "stylometry-v2"


def analyze(df: DataFrame, row: str, bundle: dict | None = None, sensitivity: str = "balanced", with_segments: bool = True) -> DataFrame:
    """One analysis for each row of ``df`` (``row``, text, platform, kind), made within the row: nothing is shuffled.

    Scores describe style. They are no evidence of who wrote a text, which ``disclaimer`` says in each row.
    """
    bundle = md.DEFAULT_BUNDLE if bundle is None else bundle
    kind = F.when(F.col("kind") == "comment", "comment").otherwise("post")
    chars = any(m.get("charNgramWeights") for m in bundle.get("models", {}).values())
    rows = df.select(row, "text", F.coalesce("platform", F.lit("unknown")).alias("platform"), kind.alias("kind"))
    base = features.extract(rows, texts=False, cues=True, parts=with_segments, part_vectors=chars).drop("text")
    out = scoring.score(scoring.with_model(base, bundle))
    out = out.withColumns({"thresholds": tx.fixed(scoring.cutoffs(sensitivity)), "evidence": tx.fixed(scoring.evidence())}).withColumn("cues", tx.fixed(cues.assess()))
    if with_segments:
        out = segments.score(out)
        out = out.withColumn("mixed", segments.mixed(F.col("low"), F.col("high"), F.col("thresholds.moderate"), F.col("thresholds.strong")))
    else:
        out = out.withColumns({"mixed": F.lit(False), "segments": F.lit(None).cast("array<struct<signal: double, words: int, excerpt: string>>")})
    none = F.array().cast("array<struct<signal: double, words: int, excerpt: string>>")
    provenance = bundle.get("metadata", {}).get("provenance")
    disclaimer = F.when(F.col("calibrated"), "Experimental style signal, not proof of authorship.").otherwise("Explainable cue profile, not proof of AI use or authorship.")
    return out.withColumn("label", scoring.label()).select(
        row, F.lit(VERSION).alias("version"), "platform", "kind", "model_key", F.lit(provenance).cast("string").alias("model_provenance"), "calibrated", "cues", "logit", "signal",
        tx.percent(F.col("signal")).alias("signal_percent"), "label", "evidence", "thresholds", "mixed", F.coalesce("segments", none).alias("segments"),
        scoring.drivers(True).alias("positive_drivers"), scoring.drivers(False).alias("negative_drivers"), scoring.counter_signals().alias("counter_signals"),
        "metrics", "language_support", "features", "char_ngrams", disclaimer.alias("disclaimer"))
