"""Training: logistic models per platform and kind, calibrated and with cutoffs from held-out rows.

Texts are featurised once and written; all models are split, fitted, calibrated and judged together from that table.
Metrics and cutoffs are aggregates. What comes to the driver are counts, coefficients and reports.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import lexicons as lx
from quillspark.functions import vectors as vx
from quillspark.operators import evaluate as ev
from quillspark.operators import features as fe
from quillspark.operators import split as sp
from quillspark.sources.readers import written

MODELS = [(p, k) for p in ("linkedin", "reddit", "x") for k in ("post", "comment")]
MIN_TOTAL, MIN_CLASS, MIN_CALIBRATION, TARGET_FPR = 300, 20, 20, 0.01
#: Rows of a partition that a fit passes over at each step: fewer would cost more in tasks than in arithmetic.
FIT_ROWS = 20_000


def matrix(df: DataFrame) -> DataFrame:
    """``df`` with ``inputs`` (33 features, then 128 of the character profile) and ``words``."""
    out = fe.extract(df, texts=False)
    inputs = F.concat(F.array(*(F.col(f"features.{k}") for k in lx.FEATURE_ORDER)), F.col("char_ngrams"))
    return out.select(*df.columns, inputs.alias("inputs"), F.col("metrics.wordCount").alias("words"))


def fit(df: DataFrame, balanced: bool = True) -> tuple[list[float], float]:
    """Coefficients and intercept of an L2-penalised (C = 1) logistic model of ``inputs`` on ``target``."""
    n = {r["target"]: r["count"] for r in df.groupBy("target").count().collect()}
    total = sum(n.values())
    weight = F.element_at(F.create_map(*(F.lit(x) for t, c in n.items() for x in (t, total / (len(n) * c)))), F.col("target")) if balanced else F.lit(1.0)
    rows = df.select(array_to_vector("inputs").alias("features"), F.col("target").cast("double").alias("label"), weight.alias("w"))
    m = LogisticRegression(regParam=1 / total, elasticNetParam=0.0, standardization=False, maxIter=2000, tol=1e-8, weightCol="w").fit(rows.coalesce(1 + total // FIT_ROWS))
    return m.coefficients.toArray().tolist(), float(m.intercept)


def logit(coefficients: list[float], intercept: float) -> Column:
    pairs = F.zip_with("inputs", F.array(*map(F.lit, coefficients)), lambda x, w: x * w)
    return F.aggregate(pairs, F.lit(float(intercept)), lambda a, x: a + x)


def calibrate(df: DataFrame) -> dict:
    """A one-dimensional logistic fit of ``logit`` on ``target``; needs 20 rows and both targets."""
    n, kinds = df.agg(F.count(F.lit(1)), F.count_distinct("target")).first()
    if n < MIN_CALIBRATION or kinds < 2:
        raise ValueError("calibration needs at least 20 rows and both labels")
    rows = df.select(array_to_vector(F.array("logit")).alias("features"), F.col("target").cast("double").alias("label"))
    m = LogisticRegression(regParam=1 / n, elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-8).fit(rows.coalesce(1 + n // FIT_ROWS))
    return {"slope": float(m.coefficients[0]), "intercept": float(m.intercept), "method": "held-out-sigmoid"}


def calibrated(value: Column, calibration: dict) -> Column:
    x = calibration["slope"] * value + calibration["intercept"]
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-20.0), F.least(F.lit(20.0), x))))


#: Rows of the matrix of second derivatives that are added up together.
_BLOCK = 32


def fit_many(df: DataFrame, balanced: bool = True, tolerance: float = 1e-14, steps: int = 100) -> dict[str, tuple[list[float], float]]:
    """Coefficients and intercept of every model at once: L2-penalised (C = 1) logistic models of ``inputs`` on ``target`` (0 or 1).

    ``df`` has ``models``, an array of the keys of the models that a row belongs to. Each step passes over the rows once for all
    models that have not converged: tasks add up loss, gradient and second derivatives per model, their sums are added by
    (model, block), and the driver takes a Newton step for each model (halved where the loss rose). What comes to
    the driver is bounded by the number of models and of inputs, whatever the rows. A model needs rows of both targets.
    """
    sizes: dict[str, dict[int, int]] = {}
    for r in df.select(F.explode("models").alias("m"), F.col("target").cast("int").alias("t")).groupBy("m", "t").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes.setdefault(r.m, {})[r.t] = r.n
    names = sorted(sizes)
    if not names:
        return {}
    if one := [k for k in names if len(sizes[k]) < 2]:
        raise ValueError(f"one class only: {', '.join(one)}")
    weights = np.array([[sum(sizes[k].values()) / (2 * sizes[k][t]) if balanced else 1.0 for t in (0, 1)] for k in names])
    rows = df.select(F.transform("models", lambda m: F.array_position(F.array(*map(F.lit, names)), m).cast("int") - 1).alias("models"), F.col("inputs").cast("array<double>").alias("inputs"), F.col("target").cast("int").alias("target"))
    rows = rows.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism))  # each task gives one set of sums: no more of them than cores
    width = len(rows.first().inputs) + 1

    def gather(beta: np.ndarray, live: list[int]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
        """Loss, gradient and second derivatives of the unpenalised likelihood of the models ``live``."""

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {k: np.zeros((width + 2, width)) for k in live}
            for batch in batches:
                owners = np.asarray(batch.column(0).flatten())
                at = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(batch.column(0))))
                x = np.concatenate([np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, width - 1), np.ones((batch.num_rows, 1))], axis=1)
                y = np.asarray(batch.column(2))
                for k in live:
                    own = at[owners == k]
                    if len(own):
                        z, t = x[own], y[own]
                        m = z @ beta[k]
                        p, w = 1 / (1 + np.exp(-np.clip(m, -500, 500))), weights[k, t]
                        sums[k][0] += z.T @ (w * (p - t))
                        sums[k][1, 0] += float((w * (np.logaddexp(0, m) - t * m)).sum())
                        sums[k][2:] += (z * (w * p * (1 - p))[:, None]).T @ z
            parts = [(k, b, s[b : b + _BLOCK].ravel()) for k, s in sums.items() for b in range(0, width + 2, _BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array([q[0] for q in parts], pa.int32()), pa.array([q[1] for q in parts], pa.int32()), pa.array([q[2] for q in parts], pa.list_(pa.float64()))], names=["model", "block", "sums"])

        def added(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"model": [key[0]], "block": [key[1]], "sums": [np.sum(np.stack(frame["sums"].to_numpy()), axis=0)]})

        shape, found = "model int, block int, sums array<double>", {k: np.zeros((width + 2, width)) for k in live}
        for r in rows.mapInArrow(task, shape).groupBy("model", "block").applyInPandas(added, shape).collect():
            found[r.model][r.block : r.block + _BLOCK] = np.array(r.sums).reshape(-1, width)
        return {k: (float(s[1, 0]), s[0], s[2:]) for k, s in found.items()}

    penalty = np.append(np.ones(width - 1), 0.0)
    beta, move = np.zeros((len(names), width)), np.zeros((len(names), width))
    best, live = np.full(len(names), np.inf), list(range(len(names)))
    for _ in range(steps):
        if not live:
            break
        for k, (loss, gradient, second) in gather(beta + move, live).items():
            value = loss + 0.5 * float(penalty @ (beta[k] + move[k]) ** 2)
            if value > best[k] + 1e-9 * (1 + abs(best[k])):
                move[k] /= 2
                continue
            beta[k], best[k] = beta[k] + move[k], value
            slope = gradient + penalty * beta[k]
            move[k] = -np.linalg.solve(second + np.diag(penalty + 1e-12), slope)
            if -float(slope @ move[k]) < tolerance * (1 + abs(value)):
                beta[k] += move[k]
                live.remove(k)
    return {name: (beta[k, :-1].tolist(), float(beta[k, -1])) for k, name in enumerate(names)}


def _clean(rows: list, *less: str) -> list[dict]:
    """Report rows as dicts without some columns; what is not a number is none."""
    return [{k: None if isinstance(v, float) and math.isnan(v) else v for k, v in r.asDict().items() if k not in less} for r in rows]


def _by_model(rows: list, *less: str) -> dict[str, list[dict]]:
    out: dict[str, list[dict]] = {}
    for r in rows:
        out.setdefault(r.model, []).extend(_clean([r], "model", *less))
    return out


def train_models(table: DataFrame, models: Column, names: list[str], seed: int = 1337, test_size: float = 0.2, calibration_size: float = 0.2, group: str = "source_id", target_fpr: float = TARGET_FPR, balanced: bool = True, min_total: int = MIN_TOTAL) -> dict[str, dict]:
    """For each name a model and its report, or why there is none. ``models``: the names that a row of ``table`` trains.

    ``table`` is featurised and written. All models go through each step together: counts, splits, one fit of all, calibrations,
    cutoffs, metrics and slices take as many jobs for seven models as for one.
    """
    table = written(table.withColumns({"__models": models, "__id": F.monotonically_increasing_id()}), "rows")
    each = table.select(F.explode("__models").alias("model"), "__id", *(c for c in table.columns if c not in ("__models", "__id", "inputs")))
    per: dict[str, dict] = {k: {} for k in names}
    for r in each.groupBy("model", "target").agg(F.count(F.lit(1)).alias("n")).collect():
        per.setdefault(r.model, {})[r.target] = r.n
    out, able = {}, []
    for k, n in per.items():
        both = {t: c for t, c in n.items() if t in (0, 1)}
        if sum(both.values()) < min_total or len(both) < 2 or min(both.values()) < MIN_CLASS:
            out[k] = {"skipped": {"reason": "insufficient binary examples or class coverage", "n_total": sum(n.values()), "binary_counts": both}}
        else:
            able.append(k)
    sp.check(test_size, calibration_size)
    if not able:
        return out
    parts, about = sp.split_each(each.where(F.col("model").isin(able)), seed, test_size, calibration_size, group)
    parts = written(parts, "parts")  # model, __id, part and the group
    about = sp.audit_each(parts, about)
    kinds = {(r.model, r.part): r.n for r in parts.where("target < 2").groupBy("model", "part").agg(F.count_distinct("target").alias("n")).collect()}
    lost = [k for k in able if min(kinds.get((k, p), 0) for p in ("train", "calibration")) < 2]
    out |= {k: {"skipped": {"reason": "train or calibration split lost a binary class", "split": about[k]}} for k in lost}
    able = [k for k in able if k not in lost]
    if not able:
        return out
    entries = parts.where(F.col("model").isin(able)).groupBy("__id").agg(F.map_from_entries(F.collect_list(F.struct("model", "part"))).alias("__parts"))  # a row trains two models at most
    placed = written(table.drop("__models").join(entries, "__id").drop("__id"), "placed")
    train = placed.where("target < 2").withColumn("models", F.map_keys(F.map_filter("__parts", lambda _, p: p == "train"))).where(F.size("models") > 0)
    fitted = fit_many(train.select("models", "inputs", "target"), balanced)
    of = lambda values: F.element_at(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v))), F.col("model"))
    held = placed.select("*", F.explode(F.map_filter("__parts", lambda _, p: p != "train")).alias("model", "part"))
    weights, start = of({k: F.array(*map(F.lit, w)) for k, (w, _) in fitted.items()}), of({k: F.lit(b) for k, (_, b) in fitted.items()})
    value = F.aggregate(F.zip_with("inputs", weights, lambda x, w: x * w), start, lambda a, x: a + x)
    held = written(held.withColumn("logit", value).drop("inputs", "__parts", "text"), "held")
    own = held.where("part = 'calibration' and target < 2")
    sizes = {r.model: r.n for r in own.groupBy("model").agg(F.count(F.lit(1)).alias("n")).collect()}
    if small := [k for k in able if sizes.get(k, 0) < MIN_CALIBRATION]:
        raise ValueError(f"calibration needs at least {MIN_CALIBRATION} rows and both labels: {', '.join(small)}")
    sigmoids = fit_many(own.select(F.array("model").alias("models"), F.array("logit").alias("inputs"), "target"), False)
    score = of({k: calibrated(F.col("logit"), {"slope": w[0], "intercept": b}) for k, (w, b) in sigmoids.items()})
    scored = held.withColumn("score", score)
    cuts = ev.human_thresholds(scored.where("part = 'calibration' and target < 2"), "model", target_fpr)
    if none := [k for k in able if k not in cuts]:
        raise ValueError(f"calibration needs texts written by humans: {', '.join(none)}")
    strong = of({k: F.lit(cuts[k]["strong"]) for k in able})
    metrics = {(r.model, r.part): _clean([r], "model", "part")[0] for r in ev.binary_metrics(scored, ["model", "part"], strong).collect()}
    slices = _by_model(ev.slice_report(scored.where("part = 'test'"), strong, by=["model"]).orderBy("model", "dimension", "value").collect())
    counts = _by_model(ev.counts(each, ["model"]).collect())
    n = len(lx.FEATURE_ORDER)
    for k in able:
        (coefficients, intercept), (slope, offset) = fitted[k], (sigmoids[k][0][0], sigmoids[k][1])
        model = {
            "intercept": intercept, "weights": dict(zip(lx.FEATURE_ORDER, coefficients[:n], strict=True)), "charNgramWeights": coefficients[n:], "char_hash_dim": vx.DIMENSION,
            "calibration": {"slope": slope, "intercept": offset, "method": "held-out-sigmoid"}, "feature_order": lx.FEATURE_ORDER, "thresholds": cuts[k],
        }
        report = {
            "split": about[k], "counts": counts[k], "calibration": {"n": sizes[k], "metrics_at_strong": metrics.get((k, "calibration")), **cuts[k]},
            "test": metrics.get((k, "test"), {"n": 0}), "slices": slices.get(k, []),
        }
        out[k] = {"model": model, "report": report}
    return out


def train_one(table: DataFrame, **options) -> dict:
    """A model and its report, or why there is none. ``table``: featurised, normalised rows."""
    return train_models(table, F.array(F.lit("model")), ["model"], **options)["model"]


def train_all(records: DataFrame, path: str | None = None, **options) -> tuple[dict, dict]:
    """(weights bundle, report) of the six keyed models and the pooled default.

    ``records`` are normalised rows (text, target, platform, kind, source_id). They are featurised once, and written
    to ``path`` if one is given.
    """
    table = matrix(records)
    if path:
        table.write.mode("overwrite").parquet(path)
        table = records.sparkSession.read.parquet(path)
    names = [f"{p}:{k}" for p, k in MODELS]
    key = F.concat_ws(":", "platform", "kind")
    found = train_models(table, F.when(key.isin(names), F.array(key, F.lit("default"))).otherwise(F.array(F.lit("default"))), [*names, "default"], **options)
    weights, report = {"schema_version": 2, "metadata": {"feature_set": "stylometry-v2-charhash128"}, "models": {}}, {"models": {}, "skipped_models": {}}
    for name in [*names, "default"]:
        out = found[name]
        if "skipped" in out:
            report["skipped_models"][name] = out["skipped"]
        else:
            weights["models"][name], report["models"][name] = out["model"], out["report"]
    if not weights["models"]:
        raise ValueError(f"no model could be trained: {report['skipped_models']}")
    return weights, report
