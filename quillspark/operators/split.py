"""Splits into train, calibration and test that keep groups together or strata in proportion.

Membership follows a seeded hash, so it does not depend on partitions. Groups (or rows of a stratum) are
ranked by that hash in two levels: hash ranges are counted, and only the range that holds the cut is
ranked, so no task orders all of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PARTS = ("train", "calibration", "test")
RANGES = 1024


def _first(df: DataFrame, by: list[str], order: Column, counts: dict | Column, name: str) -> DataFrame:
    """``df`` with ``name``: whether a row is among the first ``counts`` (a column) of its ``by`` in ``order`` (a hash)."""
    df = df.withColumns({"__h": order, "__n": counts}).withColumn("__r", F.shiftright("__h", 54))
    sums = df.groupBy(*by, "__r").agg(F.count(F.lit(1)).alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.partitionBy(*by).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    sums = sums.select(*by, "__r", before.alias("__before"))
    rank = F.row_number().over(Window.partitionBy(*by, "__r").orderBy("__h", *[c for c in ("__key",) if c in df.columns]))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "__r"]]
    joined = df.alias("a").join(sums.alias("b"), same, "left").select("a.*", "b.__before")
    return joined.withColumn(name, F.col("__before") + rank <= F.col("__n")).drop("__h", "__n", "__r", "__before")


def check(test_size: float, calibration_size: float) -> None:
    if test_size <= 0 or calibration_size <= 0 or test_size + calibration_size >= 0.8:
        raise ValueError("test and calibration sizes must be positive and leave at least 20 % for training")


def _two_cuts(keys: DataFrame, by: list[str], seed: int, test: Column, calibration: Column) -> DataFrame:
    hashed = lambda s: F.xxhash64(F.lit(s), F.col("__key"))
    first = _first(keys, by, hashed(seed), test, "__test")
    # the second cut ranks what the first has left; rows of the test set count for nothing in it
    rest = _first(first.where("not __test"), by, hashed(seed + 1), calibration, "__cal")
    return first.where("__test").select(*keys.columns, F.lit("test").alias("part")).unionByName(rest.select(*keys.columns, F.when(F.col("__cal"), "calibration").otherwise("train").alias("part")))


def _quotas(of: dict[str, int], part: float) -> dict[str, int]:
    """Whole numbers in proportion that add up to the part, rounded up, of all."""
    total = math.ceil(part * sum(of.values()))
    exact = {k: part * n for k, n in of.items()}
    out = {k: int(v) for k, v in exact.items()}
    for k in sorted(of, key=lambda k: (out[k] - exact[k], k))[: total - sum(out.values())]:
        out[k] += 1
    return out


def split_each(df: DataFrame, seed: int = 1337, test_size: float = 0.2, calibration_size: float = 0.2, group: str = "source_id") -> tuple[DataFrame, dict[str, dict]]:
    """``df`` (one row for each ``model`` that a row trains) with ``part`` and the group as ``__g``, and how each model's rows were split.

    Each model's rows are split as ``split`` would, by themselves; all models are ranked by the same jobs.
    """
    check(test_size, calibration_size)
    share = calibration_size / (1 - test_size)
    g = F.coalesce(F.col(group).cast("string"), F.lit("")) if group and group in df.columns else F.lit("")
    content = F.xxhash64(*[F.col(c).cast("string") for c in ("text", group, "kind", "target", "attack") if c in df.columns])
    rows = df.withColumns({"__row": content, "__g": g, "__s": F.concat_ws(":", F.col("target").cast("string"), "kind")}).drop("text")
    facts = {r.model: r for r in rows.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("__g").alias("groups"), F.sum((F.col("__g") == "").cast("int")).alias("empty")).collect()}
    grouped = {k for k, r in facts.items() if group and r.groups >= 6 and r.groups < r.n and not r.empty}
    about = {k: {"method": "group-shuffle", "group_field": group} if k in grouped else {"method": "stratified-random", "group_field": None} for k in facts}
    test, calibration = {}, {}  # how many to take, by model (and stratum)
    for k in grouped:
        test[k] = math.ceil(test_size * facts[k].groups)
        calibration[k] = math.ceil(share * (facts[k].groups - test[k]))
    strata: dict[str, dict[str, int]] = {}
    for r in rows.where(~F.col("model").isin(list(grouped))).groupBy("model", "__s").agg(F.count(F.lit(1)).alias("n")).collect():
        strata.setdefault(r.model, {})[r["__s"]] = r.n
    alike = {k for k, of in strata.items() if min(of.values()) < 2}  # a stratum of one row cannot be divided
    for k, of in strata.items():
        of = {"all": sum(of.values())} if k in alike else of
        first = _quotas(of, test_size)
        second = _quotas({s: n - first[s] for s, n in of.items()}, share)
        test |= {f"{k}\n{s}": n for s, n in first.items()}
        calibration |= {f"{k}\n{s}": n for s, n in second.items()}
    table = lambda q, key: F.element_at(F.create_map(*(F.lit(x) for kv in (q or {"": 0}).items() for x in kv)), key)
    whole = F.col("model").isin(list(grouped))
    keys = rows.where(whole).select("model", F.col("__g").alias("__key")).distinct()
    dealt = _two_cuts(keys, ["model"], seed, table(test, F.col("model")), table(calibration, F.col("model")))
    by_group = rows.where(whole).withColumn("__key", F.col("__g")).join(dealt, ["model", "__key"])
    single = rows.where(~whole).withColumns({"__s": F.when(F.col("model").isin(list(alike)), "all").otherwise(F.col("__s")), "__key": F.col("__row")})
    cell = F.concat(F.col("model"), F.lit("\n"), F.col("__s"))
    by_row = _two_cuts(single, ["model", "__s"], seed, table(test, cell), table(calibration, cell))
    out = by_group.unionByName(by_row) if grouped and strata else by_group if grouped else by_row
    return out.drop("__key", "__row", "__s"), about


def audit_each(parts: DataFrame, about: dict[str, dict]) -> dict[str, dict]:
    """Sizes of each model's parts and, for groups, how many groups two parts share."""
    out = {k: a | {f"n_{p}": 0 for p in PARTS} for k, a in about.items()}
    for r in parts.groupBy("model", "part").agg(F.count(F.lit(1)).alias("n")).collect():
        out[r.model][f"n_{r.part}"] = r.n
    pairs = (("train", "calibration"), ("train", "test"), ("calibration", "test"))
    held = parts.groupBy("model", "__g").agg(F.collect_set("part").alias("p"))
    both = lambda a, b: F.count(F.when(F.array_contains("p", a) & F.array_contains("p", b), 1)).alias(f"{a}_{b}")
    for r in held.groupBy("model").agg(*(both(*x) for x in pairs)).collect():
        if out[r.model]["group_field"]:
            out[r.model]["group_overlap"] = {f"{a}_{b}": r[f"{a}_{b}"] for a, b in pairs}
    return out


def split(df: DataFrame, seed: int = 1337, test_size: float = 0.2, calibration_size: float = 0.2, group: str = "source_id") -> tuple[DataFrame, dict]:
    """``df`` with ``part``, and how it was split.

    Whole groups are dealt where there are at least six, some hold several rows and none is empty;
    otherwise rows are dealt by strata of target and kind, or at random where a stratum has one row.
    """
    names = [c for c in df.columns if c != "text"]
    rows = df.withColumns({"model": F.lit("all"), "__text": F.col("text") if "text" in df.columns else F.lit(None).cast("string")})
    parts, about = split_each(rows, seed, test_size, calibration_size, group)
    kept = [F.col(c) for c in names]
    kept += [F.col("__text").alias("text")] if "text" in df.columns else []
    nothing = {"method": "stratified-random", "group_field": None}
    return parts.select(*kept, "part").select(*df.columns, "part"), about.get("all", nothing)


def audit(df: DataFrame, about: dict, group: str = "source_id") -> dict:
    """Sizes of the parts and, for groups, how many groups two parts share."""
    n = {r["part"]: r["count"] for r in df.groupBy("part").count().collect()}
    out = about | {f"n_{p}": n.get(p, 0) for p in PARTS}
    if about["group_field"]:
        keys = {p: df.where(F.col("part") == p).select(F.col(group).cast("string")).distinct() for p in PARTS}
        pairs = (("train", "calibration"), ("train", "test"), ("calibration", "test"))
        out["group_overlap"] = {f"{a}_{b}": keys[a].intersect(keys[b]).count() for a, b in pairs}
    return out
