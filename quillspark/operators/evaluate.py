"""Evaluation statistics of scores against targets, overall and by slice.

Everything is a grouped aggregate. Ranks for ROC and average precision and medians come from counts per distinct
score, combined before the shuffle and accumulated in two levels: ranges of scores that hold equally many, found by
Spark's range partitioning, then scores within a range. So ties are exact, and no task orders all scores of a
group, however close to each other they lie.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.sources.readers import written

DIMENSIONS = ("platform", "kind", "authorship", "generator", "attack", "language")
#: Edges of ten equal bins as the usual division of [0, 1] gives them in doubles.
EDGES = [i * 0.1 for i in range(10)] + [1.0]


def length_bucket(words: Column) -> Column:
    return F.when(words < 20, "0-19").when(words < 50, "20-49").when(words < 120, "50-119").otherwise("120+")


def counts(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``by``, dimension, value, n for authorship, platform and kind."""
    by = by or []
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in ("authorship", "platform", "kind"))))
    return df.select(*by, cells.alias("x")).groupBy(*by, "x.dimension", "x.value").agg(F.count(F.lit(1)).alias("n"))


def _bin(score: Column) -> Column:
    out = F.when((score >= EDGES[9]) & (score <= 1.0), 9)
    for i in range(8, -1, -1):
        out = F.when((score >= EDGES[i]) & (score < EDGES[i + 1]), i).otherwise(out)
    return out


#: Ranges in which cutoffs are looked for at each step.
RANGES = 1024


def _running(ties: DataFrame, keys: list[str], counts: list[str], down: bool = False) -> DataFrame:
    """``ties`` (keys, s, counts; one row for each score) with ``{count}_upto``: the sum of all scores from the first up to this one.

    Ranges are the parts of a range partitioning, which samples its bounds; they are written, so that both levels see the same.
    """
    way = lambda c: F.desc(c) if down else F.asc(c)
    ties = written(ties.repartitionByRange(*(F.asc(k) for k in keys), way("s")).withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ties.groupBy(*keys, "range").agg(*(F.sum(c).alias(c) for c in counts))
    sums = sums.select(*keys, "range", *(F.coalesce(F.sum(c).over(before), F.lit(0).cast("long")).alias(f"{c}_before") for c in counts))
    within = Window.partitionBy(*keys, "range").orderBy(way("s"))
    own = ties.select("*", *(F.sum(c).over(within).alias(f"{c}_own") for c in counts))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*keys, "range"]]
    return own.alias("a").join(sums.alias("b"), same).select(*(f"a.{c}" for c in ties.columns if c != "range"), *((F.col(f"a.{c}_own") + F.col(f"b.{c}_before")).alias(f"{c}_upto") for c in counts))


def medians(rows: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """keys and ``median``: the middle score of each group, or the mean of the two middle ones."""
    ties = rows.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).cast("double").alias("s")).agg(F.count(F.lit(1)).alias("c"))
    at = _running(ties, keys, ["c"])
    sizes = ties.groupBy(*keys).agg(F.sum("c").alias("n_all"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys]
    both = at.alias("a").join(sizes.alias("b"), same).select(*(f"a.{c}" for c in keys), "s", "c", "c_upto", "n_all")
    holds = lambda place: F.min(F.when(F.col("c_upto") >= place, F.col("s")))
    return both.groupBy(*keys).agg(((holds(F.expr("(n_all + 1) div 2")) + holds(F.expr("n_all div 2 + 1"))) / 2).alias("median"))


def binary_metrics(df: DataFrame, by: list[str], threshold: float | Column, score: str = "score", target: str = "target") -> DataFrame:
    """One row for each group of ``by`` that has rows of target 0 or 1."""
    keys = by or ["__all"]
    rows = df.where(F.col(target) < 2).withColumn("__all", F.lit(1)).select(*keys, F.col(score).cast("double").alias("s"), F.col(target).cast("int").alias("y"))
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit, ai = F.col("s") >= cut, F.col("y") == 1
    n = lambda c: F.sum(c.cast("long"))
    main = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), n(~ai).alias("n_human"), n(ai).alias("n_ai"), n(hit & ai).alias("tp"), n(hit & ~ai).alias("fp"), F.avg((F.col("s") - F.col("y")) ** 2).alias("brier"))
    bins = rows.groupBy(*keys, _bin(F.col("s")).alias("b")).agg(F.count(F.lit(1)).alias("c"), F.avg("s").alias("ms"), F.avg("y").alias("my"))
    ece = bins.groupBy(*keys).agg(F.sum(F.when(F.col("b").isNotNull(), F.col("c") * F.abs(F.col("ms") - F.col("my"))).otherwise(0.0)).alias("gap"))
    ties = rows.groupBy(*keys, "s").agg(n(ai).alias("p"), n(~ai).alias("q"))
    ties = _running(ties, keys, ["p", "q"], down=True).withColumnsRenamed({"p_upto": "ai_upto", "q_upto": "human_upto"})
    # an AI row beats the human rows of lower scores and half of those with its own
    ranks = ties.groupBy(*keys).agg(
        F.sum(F.col("q") * (F.col("ai_upto") - F.col("p")) + F.col("p") * F.col("q") / 2.0).alias("wins"),
        F.sum(F.col("p") * (F.col("ai_upto") / (F.col("ai_upto") + F.col("human_upto")))).alias("precise"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    both = (F.col("n_human") > 0) & (F.col("n_ai") > 0)
    precision, recall = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("n_ai"))
    out = main.join(ece, keys).join(ranks, keys).select(
        *keys, "n", "n_human", "n_ai", precision.alias("precision"), recall.alias("recall"), share(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("n_ai")).alias("f1"),
        F.when(F.col("n_human") > 0, F.col("fp") / F.col("n_human")).alias("false_positive_rate"),
        F.when(both, F.col("wins") / (F.col("n_human") * F.col("n_ai"))).alias("roc_auc"), F.when(both, F.col("precise") / F.col("n_ai")).alias("average_precision"),
        "brier", (F.col("gap") / F.col("n")).alias("expected_calibration_error"))
    return out.drop("__all")


def sliced(df: DataFrame, words: str = "words", by: list[str] | None = None) -> DataFrame:
    """Each row once for each slice dimension: ``by``, dimension, value, and the row's score and target."""
    value = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("unknown")) if c in df.columns else F.lit("unknown")
    cells = [F.struct(F.lit(c).alias("dimension"), value(c).alias("value")) for c in DIMENSIONS]
    cells.append(F.struct(F.lit("length").alias("dimension"), length_bucket(F.col(words)).alias("value")))
    by = by or []
    return df.select(*by, F.explode(F.array(*cells)).alias("x"), "score", "target").select(*by, "x.dimension", "x.value", "score", "target")


def slice_report(df: DataFrame, threshold: float | Column, words: str = "words", by: list[str] | None = None) -> DataFrame:
    """``by``, dimension, value, binary metrics (null without binary rows) and those of mixed rows (null without any)."""
    each, keys = sliced(df, words, by), [*(by or []), "dimension", "value"]
    both = each.where("target = 2")
    mixed = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("mixed_n"), F.avg("score").alias("mixed_mean_signal"), F.avg((F.col("score") >= threshold).cast("double")).alias("mixed_share_at_or_above_strong"))
    mixed = mixed.join(medians(both, keys).withColumnRenamed("median", "mixed_median_signal"), keys, "left")
    return binary_metrics(each, keys, threshold).join(mixed, keys, "full")


def human_threshold(df: DataFrame, target_fpr: float = 0.01, score: str = "score", target: str = "target") -> dict:
    """The cutoff of one group of rows; see ``human_thresholds``."""
    found = human_thresholds(df.withColumn("__all", F.lit("all")), "__all", target_fpr, score, target)
    if not found:
        raise ValueError("calibration needs texts written by humans")
    return found["all"]


def human_thresholds(df: DataFrame, by: str, target_fpr: float = 0.01, score: str = "score", target: str = "target") -> dict[str, dict]:
    """For each value of ``by``, the cutoff just above the human scores' quantile: what a human-written text passes at most ``target_fpr`` of the time.

    The quantiles are found by counting scores in ranges, then in ranges of the range that holds it, and so on, for all groups
    at once: counts of at most RANGES ranges of each group come to the driver, and no task orders scores.
    """
    if not 0 < target_fpr < 1:
        raise ValueError("the false positive rate must lie between 0 and 1")
    human = df.where(F.col(target) == 0).select(F.col(by).cast("string").alias("k"), F.col(score).cast("double").alias("s"))
    sizes = {r.k: r for r in human.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi")).collect()}
    left = {k: max(0, min(r.n - 1, -int(-(1.0 - target_fpr) * r.n // 1) - 1)) for k, r in sizes.items()}
    bounds = {k: (r.lo, r.hi) for k, r in sizes.items()}
    of = lambda values: F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), F.col("k"))
    while wide := {k: b for k, b in bounds.items() if b[0] < b[1]}:
        lo, hi = of({k: b[0] for k, b in wide.items()}), of({k: b[1] for k, b in wide.items()})
        inside = human.where(F.col("k").isin(list(wide))).withColumns({"lo": lo, "hi": hi}).where(F.col("s").between(F.col("lo"), F.col("hi")))
        ranges = inside.groupBy("k", F.floor((F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (RANGES - 1)).alias("r")).agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi"))
        found = set()
        for r in sorted(ranges.collect(), key=lambda r: r.r):
            if r.k not in found and left[r.k] < r.n:
                bounds[r.k] = (r.lo, r.hi)
                found.add(r.k)
            elif r.k not in found:
                left[r.k] -= r.n
    if not sizes:
        return {}
    strong = {k: float(np.nextafter(b[0], np.inf)) for k, b in bounds.items()}
    above = {r.k: r.n for r in human.where(F.col("s") >= of(strong)).groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {
        k: {
            "strong": s, "moderate": max(0.2, min(0.5, s - 0.12)), "target_fpr": float(target_fpr), "calibration_human_n": sizes[k].n,
            "empirical_calibration_fpr": above.get(k, 0) / sizes[k].n, "minimum_resolvable_fpr": 1.0 / (sizes[k].n + 1), "method": "held-out-human-quantile",
        }
        for k, s in strong.items()
    }
