"""Records of any tabular source to the training schema, and the checks that training makes of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: field -> columns to look in after the one asked for, and what stands for none
FALLBACKS = {
    "text": (["content", "body", "message", "tweet"], None),
    "label": (["authorship", "class", "target", "is_generated"], None),
    "platform": (["source", "network"], "unknown"),
    "kind": (["type"], "post"),
    "source_id": (["pair_id", "document_id", "id"], None),
    "generator": (["multi_label", "model", "llm"], "unknown"),
    "language": (["lang"], "unknown"),
    "attack": (["perturbation", "rewrite"], "none"),
}
# fixed values: the spellings that count as each authorship
HUMAN = ["0", "human", "human-written", "hwt"]
AI = ["1", "ai", "machine", "generated", "ai-generated", "mgt", "llm"]
MIXED = ["2", "mixed", "hybrid", "assisted", "ai-assisted", "human-polished", "ai-polished", "human-edited", "coauthored", "co-authored"]
IMPORT_HUMAN, IMPORT_AI = [*HUMAN, "real"], [*AI, "fake"]
IMPORT_MIXED = ["2", "mixed", "hybrid", "assisted", "ai-assisted", "human-edited", "human-polished"]
NAMES = {0: "human", 1: "ai", 2: "mixed"}


def first_present(df: DataFrame, requested: str, fallbacks: list[str], default: str | None = None) -> Column:
    """The first of the columns that exist whose value is not null (or NaN), as a string."""
    found = []
    for c in [requested, *fallbacks]:
        if c in df.columns:
            kind = df.schema[c].dataType.typeName()
            found.append(F.when(~F.isnan(c), F.col(c)).cast("string") if kind in ("double", "float") else F.col(c).cast("string"))
    return F.coalesce(*found, F.lit(default).cast("string"))


def _plain(value: Column) -> Column:
    return F.trim(F.lower(value))


def kind_of(value: Column) -> Column:
    return F.when(_plain(value).isin("reply", "replies", "comment", "comments"), "comment").otherwise("post")


def platform_of(value: Column) -> Column:
    p = F.coalesce(_plain(value), F.lit(""))
    return (
        F.when(p.isin("twitter", "x", "x.com"), "x")
        .when(p.isin("linkedin", "linkedin.com"), "linkedin")
        .when(p.isin("reddit", "reddit.com", "old.reddit.com"), "reddit")
        .when(p == "", "unknown")
        .otherwise(p)
    )


def _spelled(value: Column, human: list[str], ai: list[str], mixed: list[str]) -> Column:
    v = F.replace(_plain(value), F.lit("_"), F.lit("-"))
    return F.when(v.isin(human), 0).when(v.isin(ai), 1).when(v.isin(mixed), 2)


def target_of(value: Column, numeric: bool = False) -> Column:
    """0, 1 or 2 of a training label; null where it is none. Numbers are truncated."""
    text = F.when(value.cast("string").isin("true", "false"), value.cast("string") == "true").cast("int")
    number = F.try_to_number(value.cast("string"), F.lit("S9999999999D99999")) if not numeric else value
    whole = number.cast("int") if numeric else F.lit(None).cast("int")
    return F.coalesce(F.when(whole.between(0, 2), whole), text, _spelled(value.cast("string"), HUMAN, AI, MIXED))


def authorship_of(value: Column) -> Column:
    """human, ai or mixed of an imported label; null where it is none (a float such as 1.0 is none)."""
    code = _spelled(value.cast("string"), IMPORT_HUMAN, IMPORT_AI, IMPORT_MIXED)
    return F.when(code == 0, "human").when(code == 1, "ai").when(code == 2, "mixed")


def _imported(df: DataFrame, fields: dict[str, str] | None, platform: str | None, kind: str | None, row: str | None) -> DataFrame:
    """The training schema of every row of ``df``, ``label`` as it was, and ``reason``: why the row is none, or null."""
    fields = fields or {}
    pick = lambda f: first_present(df, fields.get(f, f), *FALLBACKS[f])
    number = F.col(row) if row else F.monotonically_increasing_id()
    base = df.select(*(pick(f).alias(f) for f in FALLBACKS), number.cast("string").alias("__row"))
    found = authorship_of(F.col("label"))
    reason = F.when(F.coalesce("text", F.lit("")) == "", "no text").when(F.col("label").isNull(), "no label").when(found.isNull(), "unknown label")
    return base.select(
        "text", found.alias("authorship"),
        (F.lit(platform) if platform else F.col("platform")).alias("platform"), (F.lit(kind) if kind else F.col("kind")).alias("kind"),
        F.coalesce("source_id", F.concat(F.lit("row-"), "__row")).alias("source_id"), "generator", "language", "attack", "label", reason.alias("reason"))


def import_records(df: DataFrame, fields: dict[str, str] | None = None, platform: str | None = None, kind: str | None = None, row: str | None = None, strict: bool = True) -> DataFrame:
    """Rows with a text and a label in the training schema.

    ``fields`` names columns other than the usual ones; ``platform`` and ``kind`` hold for every row.
    ``row`` is a column that numbers the source's rows (``readers.numbered`` makes one); without it rows are numbered in
    partition order. A label of unknown spelling raises, or leaves the row out where ``strict`` is false.
    """
    rows = _imported(df, fields, platform, kind, row)
    if strict:
        bad = F.raise_error(F.concat(F.lit("no authorship: "), F.col("label"))).cast("string")
        rows = rows.where(F.col("reason").isNull() | (F.col("reason") == "unknown label")).withColumn("authorship", F.coalesce("authorship", bad))
    else:
        rows = rows.where("reason is null")
    return rows.drop("label", "reason")


class Sorted:
    """What ``sort_out`` gives: ``kept``, ``rejected`` and, once one of them was worked off, ``counts``."""

    def __init__(self, kept: DataFrame, rejected: DataFrame, seen: Observation):
        self.kept, self.rejected, self._seen = kept, rejected, seen

    @property
    def counts(self) -> dict[str, int]:
        """Rows in, kept, and rejected by reason."""
        return {k: v for k, v in self._seen.get.items()}


REASONS = ("no text", "no label", "unknown label")


def sort_out(df: DataFrame, path: str, fields: dict[str, str] | None = None, platform: str | None = None, kind: str | None = None, row: str | None = None) -> Sorted:
    """Import what can be imported and keep the rest apart, each with its reason; every row of ``df`` is in one of the two.

    Rows are read and judged once and written to ``path``, a folder for each of the two; counts are observed on the way.
    ``rejected`` has the label as it was spelled beside the training schema.
    """
    seen = Observation()
    count = lambda c: F.count(F.when(c, 1))
    rows = _imported(df, fields, platform, kind, row)
    rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"), count(F.col("reason").isNull()).alias("kept"), *(count(F.col("reason") == r).alias(r) for r in REASONS))
    rows.withColumn("state", F.when(F.col("reason").isNull(), "kept").otherwise("rejected")).write.mode("overwrite").partitionBy("state").parquet(path)
    table = df.sparkSession.read.schema(rows.schema.add("state", "string")).parquet(path)
    part = lambda s: table.where(F.col("state") == s).drop("state")
    return Sorted(part("kept").drop("label", "reason"), part("rejected"), seen)


def normalize_rows(df: DataFrame, label: str = "label", row: str | None = None, strict: bool = True) -> DataFrame:
    """``df`` with platform and kind in their usual spelling, ``target``, source_id and authorship.

    Where there is an authorship column it decides, even where it is null. What is no label raises, or
    gives a null target where ``strict`` is false.
    """
    use = "authorship" if "authorship" in df.columns else label
    numeric = use in df.columns and df.schema[use].dataType.typeName() in ("integer", "long", "short", "byte", "double", "float", "decimal")
    found = target_of(F.col(use), numeric) if use in df.columns else F.lit(None).cast("int")
    bad = F.raise_error(F.concat(F.lit("no label: "), F.coalesce(F.col(use).cast("string"), F.lit("null")) if use in df.columns else F.lit("null"))).cast("int")
    number = F.concat(F.lit("row-"), (F.col(row) if row else F.monotonically_increasing_id()).cast("string"))
    given = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit(None).cast("string")
    out = df.withColumns({
        "target": F.coalesce(found, bad) if strict else found,
        "platform": platform_of(F.col("platform") if "platform" in df.columns else F.lit(None)),
        "kind": kind_of(F.coalesce(F.col("kind") if "kind" in df.columns else F.lit(None).cast("string"), F.lit("post"))),
    })
    if "source_id" not in df.columns:
        out = out.withColumn("source_id", F.coalesce(given("pair_id"), given("document_id"), number))
    if "authorship" not in df.columns:
        out = out.withColumn("authorship", F.element_at(F.create_map(*(F.lit(x) for kv in NAMES.items() for x in kv)), F.col("target")))
    return out


def subset(df: DataFrame, platform: str, kind: str) -> DataFrame:
    return df.where((F.col("platform") == platform) & (F.col("kind") == kind))


def binary(df: DataFrame) -> DataFrame:
    return df.where("target < 2")
