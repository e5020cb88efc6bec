"""Surface variants of texts: without punctuation, with changed case, with one typing error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as tx

SEED = 1337
ATTACKS = ("punctuation-drop", "case-variation", "single-typo")


def drop_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, "[,;:!?]", "")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, tx.SPACE + "+"), lambda w: w != "")


def vary_case(text: Column) -> Column:
    """Words joined by single spaces, every seventh from the first in lower case."""
    return F.array_join(F.transform(_words(text), lambda w, i: F.when(i % 7 == 0, F.lower(w)).otherwise(w)), " ")


def add_typo(text: Column, key: Column, seed: int = SEED) -> Column:
    """Two letters swapped in the middle of one word of seven letters or more, chosen by a hash of ``key`` and text; unchanged if there is none."""

    def of(ws: Column) -> Column:
        long = F.filter(F.transform(ws, lambda w, i: F.when(F.rlike(w, F.lit(r"^\p{L}{7,}$")), i)), lambda i: i.isNotNull())
        chosen = F.get(long, F.pmod(F.xxhash64(F.lit(seed), key, text), F.greatest(F.size(long), F.lit(1))).cast("int"))

        def swapped(w: Column) -> Column:
            n = F.char_length(w)
            p = F.greatest(F.lit(1), F.least(n - 2, F.floor(n / 2).cast("int")))
            return F.concat(F.substring(w, F.lit(1), p), F.substring(w, p + 2, F.lit(1)), F.substring(w, p + 1, F.lit(1)), F.substring(w, p + 3, n))

        # the choice is made once, outside the pass over the words
        return tx.let(chosen, lambda at: F.when(at.isNull(), text).otherwise(F.array_join(F.transform(ws, lambda w, i: F.when(i == at, swapped(w)).otherwise(w)), " ")))

    return tx.let(_words(text), of)


def variants(df: DataFrame, row: str | None = None, seed: int = SEED) -> DataFrame:
    """Each row and its three variants, which keep source_id and name their attack. No shuffle: four rows for one."""
    if "source_id" not in df.columns:
        number = F.concat(F.lit("row-"), (F.col(row) if row else F.monotonically_increasing_id()).cast("string"))
        pair = F.nullif(F.col("pair_id").cast("string"), F.lit("")) if "pair_id" in df.columns else F.lit(None).cast("string")
        df = df.withColumn("source_id", F.coalesce(pair, number))
    own = F.col("attack").cast("string") if "attack" in df.columns else F.lit(None).cast("string")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    item = lambda a, t: F.struct(a.alias("attack"), t.alias("text"))
    changed = dict(zip(ATTACKS, (drop_punctuation(text), vary_case(text), add_typo(text, F.col("source_id"), seed)), strict=True))
    each = df.withColumn("__v", F.explode(F.array(item(own, F.col("text").cast("string")), *(item(F.lit(a), t) for a, t in changed.items()))))
    rest = [c for c in df.columns if c not in ("text", "attack")]
    return each.select(*rest, F.col("__v.text").alias("text"), F.col("__v.attack").alias("attack"))
