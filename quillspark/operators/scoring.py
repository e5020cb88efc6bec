"""Model lookup, scores, contributions, evidence, cutoffs, drivers and labels as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import lexicons as lx
from quillspark.functions import models as md

CHAR_KEY = "hashedCharacterNgrams"


def sigmoid(x: Column) -> Column:
    """Logistic, exactly 1 and 0 from 20 and -20 on."""
    return F.when(x >= 20, F.lit(1.0)).when(x <= -20, F.lit(0.0)).otherwise(1.0 / (1.0 + F.exp(-x)))


def with_model(df: DataFrame, bundle: dict, platform: str = "platform", kind: str = "kind") -> DataFrame:
    """``df`` with model_key and ``model``: of platform and kind, else the default, else null. A bundle is small by nature."""
    keys = list(bundle.get("models", {}))
    wanted = F.concat(F.col(platform), F.lit(":"), F.when(F.col(kind) == "comment", "comment").otherwise("post"))
    use = F.when(wanted.isin(keys), wanted).when(F.lit("default" in keys), F.lit("default")) if keys else F.lit(None).cast("string")
    table = md.model_table(df.sparkSession, bundle)
    table = table.select(F.col("model_key").alias("__use"), F.struct(*(c for c in table.columns if c != "model_key")).alias("model"))
    return df.withColumns({"model_key": wanted, "__use": use}).join(F.broadcast(table), "__use", "left").drop("__use")


def contributions(features: str = "features", chars: str | None = "char_ngrams") -> Column:
    """key, value, coefficient, contribution of each weight, in the model's order, the character profile last."""
    values = F.map_from_arrays(F.array(*map(F.lit, lx.FEATURE_ORDER)), F.array(*(F.col(f"{features}.{k}") for k in lx.FEATURE_ORDER)))
    item = lambda k, v, c, x: F.struct(k.alias("key"), v.alias("value"), c.alias("coefficient"), x.alias("contribution"))

    def own(k: Column, c: Column) -> Column:
        v = F.coalesce(F.element_at(values, k), F.lit(0.0))
        return item(k, v, c, c * v)

    out = F.zip_with("model.weight_keys", "model.weight_values", own)
    if chars:
        pairs = F.zip_with("model.char_weights", chars, lambda w, x: F.coalesce(w * x, F.lit(0.0)))
        total = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)
        out = F.when(F.col("model.char_weights").isNull(), out).otherwise(F.concat(out, F.array(item(F.lit(CHAR_KEY), F.lit(1.0), total, total))))
    return F.coalesce(out, F.array().cast("array<struct<key: string, value: double, coefficient: double, contribution: double>>"))


def by_size(items: Column) -> Column:
    """Items by falling size of their contribution, ties in the order they have."""
    keyed = F.transform(items, lambda x, i: F.struct((-F.abs(x["contribution"])).alias("size"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda k: k["x"])


def score(df: DataFrame, chars: str | None = "char_ngrams") -> DataFrame:
    """``df`` (with model and features) with contributions, logit, calibrated and signal; without a model 0 and 0.5."""
    df = df.withColumn("contributions", contributions(chars=chars))
    total = F.aggregate("contributions", F.coalesce(F.col("model.intercept"), F.lit(0.0)), lambda a, x: a + x["contribution"])
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    df = df.withColumns({"logit": total, "calibrated": F.coalesce(finite("model.slope") & finite("model.calibration_intercept"), F.lit(False))})
    return df.withColumns({"signal": signal(F.col("logit")), "contributions": by_size(F.col("contributions"))})


def signal(logit: Column) -> Column:
    """The score of a logit under the row's model, calibrated where the model is; 0.5 without a model."""
    plain = F.when(F.col("calibrated"), sigmoid(F.col("model.slope") * logit + F.col("model.calibration_intercept"))).otherwise(sigmoid(logit))
    return F.when(F.col("model").isNull(), F.lit(0.5)).otherwise(plain)


def cutoffs(sensitivity: str = "balanced") -> Column:
    """moderate and strong, shifted by sensitivity and kept within bounds."""
    shift = {"conservative": 0.06, "aggressive": -0.06}.get(sensitivity, 0.0)
    # a cutoff of 0 counts as none
    given = lambda c, d: F.coalesce(F.nullif(F.col(f"model.{c}"), F.lit(0.0)), F.lit(d)) + shift
    between = lambda x, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), x))
    return F.struct(
        between(given("moderate", 0.58), 0.2, 0.9).alias("moderate"), between(given("strong", 0.76), 0.35, 1.01).alias("strong"),
        F.col("model.target_fpr").alias("target_fpr"), F.coalesce("model.method", F.lit("unknown")).alias("method"))


def evidence(platform: str = "platform", kind: str = "kind") -> Column:
    """level and reasons from words, sentences, language and lexical diversity."""
    m = lambda k: F.col(f"metrics.{k}")
    rows = {f"{p}:{k}": F.array(*map(F.lit, v)) for p, kinds in lx.EVIDENCE_LIMITS.items() for k, v in kinds.items()}
    table = F.create_map(*(x for k, v in rows.items() for x in (F.lit(k), v)))
    known = F.when(F.col(platform).isin(list(lx.EVIDENCE_LIMITS)), F.col(platform)).otherwise(F.lit("unknown"))
    limits = F.element_at(table, F.concat(known, F.lit(":"), F.when(F.col(kind) == "comment", "comment").otherwise("post")))
    least, medium, high = (limits[i] for i in range(3))
    words, sentences = m("wordCount"), m("sentenceCount")
    language = F.col("language_support")
    doubts = F.filter(F.array(
        F.when(language["state"] == "uncertain", language["reason"]),
        F.when(sentences < 2, F.lit("too little sentence variation")),
        F.when((m("typeTokenRatio") >= 0.9) & (words < 45), F.lit("lexical diversity is unstable at this length"))), lambda x: x.isNotNull())
    some = F.size(doubts) > 0
    level = (
        F.when((words >= high) & (sentences >= 3), F.when(some, "medium").otherwise("high"))
        .when(words >= medium, F.when(some, "weak").otherwise("medium"))
        .otherwise("weak")
    )
    of = lambda a, r: F.struct(a.alias("level"), r.alias("reasons"))
    few = F.concat(F.lit("only "), words.cast("int").cast("string"), F.lit(" words; at least "), least.cast("string"), F.lit(" are required"))
    return F.when(language["state"] == "unsupported", of(F.lit("insufficient"), F.array(language["reason"]))).when(words < least, of(F.lit("insufficient"), F.array(few))).otherwise(of(level, doubts))


def drivers(positive: bool) -> Column:
    """name and contribution of the four largest contributions of one sign."""
    names = F.create_map(*(F.lit(x) for kv in lx.FEATURE_NAMES.items() for x in kv))
    keep = F.filter("contributions", lambda x: x["contribution"] > 0.01 if positive else x["contribution"] < -0.01)
    other = lambda k: F.when(k == CHAR_KEY, F.lit("character n-gram profile")).otherwise(k) if positive else k
    return F.transform(F.slice(keep, 1, 4), lambda x: F.struct(F.coalesce(F.element_at(names, x["key"]), other(x["key"])).alias("name"), x["contribution"].alias("contribution")))


def counter_signals() -> Column:
    m = lambda k: F.col(f"metrics.{k}")
    count = lambda k, word: F.when(m(k) > 0, F.concat(m(k).cast("int").cast("string"), F.lit(f" {word}"), F.when(m(k) == 1, "").otherwise("s")))
    own = F.array(
        count("urlCount", "link"), count("mentionCount", "mention"), count("hashtagCount", "hashtag"),
        F.when(m("numberTokenRatio") >= 0.1, F.lit("number-heavy text")), F.when(m("properNounishRatio") >= 0.08, F.lit("many proper names")))
    return F.concat(F.filter(own, lambda x: x.isNotNull()), F.col("evidence.reasons"))


def label() -> Column:
    """level and text; an uncalibrated model's label is that of the cues."""
    of = lambda a, t: F.struct(F.lit(a).alias("level"), F.lit(t).alias("text"))
    return (
        F.when(~F.col("calibrated"), F.struct(F.col("cues.level").alias("level"), F.col("cues.text").alias("text")))
        .when(F.col("evidence.level") == "insufficient", of("insufficient", "Insufficient signal"))
        .when(F.col("mixed"), of("mixed", "Mixed AI-style signals"))
        .when(F.col("signal") < F.col("thresholds.moderate"), of("low", "Low AI-style signal"))
        .when((F.col("signal") < F.col("thresholds.strong")) | (F.col("evidence.level") == "weak"), of("moderate", "Moderate AI-style signal"))
        .otherwise(of("strong", "Strong AI-style signal"))
    )


def hidden(hide_insufficient: bool = False, hide_low: bool = False) -> Column:
    """Which analyses the settings hide."""
    level, coverage = F.col("label.level"), F.col("cues.coverage.level")
    thin = (level == "insufficient") | (~F.col("calibrated") & coverage.isin("short", "unsupported"))
    return (F.lit(hide_insufficient) & thin) | (F.lit(hide_low) & level.isin("low", "cue-none"))


