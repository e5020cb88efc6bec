"""Exact dedup by deterministic block naming.

A text without white space is cut into blocks of ``block`` code points. Blocks are range partitioned by a
hash, sorted by hash and content, and all equal blocks get one integer name: the number of the first of
them in that order. Names of adjacent blocks are then paired and the pairs named in the same way, level
by level, until each document has one name. Two documents get equal names at equal levels if and only
if their normalised texts are equal: the hash only spreads blocks, and content decides. (What tells the
rows of one doc_id apart is a 64-bit hash of their text.)

A block or pair that holds a large share of all rows (copies of one text in a third of the corpus, say)
would fill a partition. Those few keys (``common.heavy_keys``) are found beforehand and named by a
broadcast table; the others go through the range partitioning. The verdicts of hot groups go to their
rows by a broadcast as well. Levels shrink by half: only documents of more
than one block reach the second, and each level is written to the shared folder, so lineage stays
short and names, once given, are fixed.

Defined cases: null and empty texts, and texts of white space alone, equal each other; a null doc_id
counts as the smallest id and is returned as null; rows that repeat both doc_id and text share one
verdict and are all counted in group_size; of rows that repeat doc_id with equal normalised texts but other
white space one stays; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import NO_ID, RID, TAG, TXT, WS, heavy_keys, rows_of, spread_join, stash

BLOCK = 2048
NONE = -(2**62)


def named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (identified by RID, TAG, idx) with an integer ``name`` in place of ``keys``: equal keys, equal names.

    Rows are ranged by the hash of their keys and sorted by hash and keys. The hash only spreads them, and
    keeps block contents out of the samples that the driver sees; equality of the keys decides.
    """
    rest = [c for c in rows.columns if c not in keys]
    rows = rows.withColumn("h", F.xxhash64(*keys))
    hot = heavy_keys(rows, keys)
    cold = rows if hot is None else rows.join(F.broadcast(hot), keys, "left_anti")
    # sorted before it is numbered: a task that runs again gives the same numbers
    ordered = cold.repartitionByRange("h").sortWithinPartitions("h", *keys, RID, TAG, "idx").withColumn("nr", F.monotonically_increasing_id())
    out = ordered.select(*rest, F.min("nr").over(Window.partitionBy("h", *keys)).alias("name"))
    if hot is None:
        return out
    table = hot.withColumn("name", -F.row_number().over(Window.orderBy(*keys)).cast("long"))
    return out.unionByName(rows.join(F.broadcast(table), keys).select(*rest, "name"))


def block_table(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, ids, length, hash for output, and the normalised text's blocks of each row; written once."""
    text = F.col("text")
    blocks = F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % block), F.lit(0)))
    rows = rows_of(docs).select("doc_id", RID, TAG, F.char_length(TXT).alias("len"), F.translate(TXT, WS, "").alias("text"))
    return stash(rows.select("doc_id", RID, TAG, "len", F.sha2(F.encode(text, "UTF-8"), 256).alias("text_sha256"), blocks.alias("blocks")), "texts")


def identities(table: DataFrame) -> DataFrame:
    """(RID, TAG, level, name): one collision-free identity for each row of a block table."""
    rows = table.select(RID, TAG, F.size("blocks").alias("n"), F.posexplode("blocks").alias("idx", "block"))
    level, done = stash(named(rows, ["block"]), "blocks"), []
    longest = level.agg(F.max("n")).first()[0] or 1
    for k in range(longest.bit_length() + 1):
        done.append(level.where("n = 1").select(RID, TAG, F.lit(k).alias("level"), "name"))
        if longest == 1:
            break
        longest = -(-longest // 2)
        left, right = (F.max(F.when(F.pmod("idx", F.lit(2)) == side, F.col("name"))) for side in (0, 1))
        pairs = level.where("n > 1").groupBy(RID, TAG, F.expr("cast((n + 1) div 2 as int)").alias("n"), F.expr("cast(idx div 2 as int)").alias("idx")).agg(left.alias("a"), F.coalesce(right, F.lit(NONE).cast("long")).alias("b"))
        level = stash(named(pairs, ["a", "b"]), "names")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.distinct()


def groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row."""
    table = block_table(docs, block)
    rows = stash(table.drop("blocks").join(identities(table), [RID, TAG]), "identities")
    best = rows.groupBy("level", "name").agg(F.min(F.struct((-F.col("len")).alias("len"), RID, TAG)).alias("best"), F.count(F.lit(1)).alias("group_size"))
    keep = F.col(f"best.{RID}")
    kept = (F.col(RID) == keep) & (F.col(TAG) == F.col(f"best.{TAG}"))
    return spread_join(rows, best, ["level", "name"]).select(
        "doc_id", F.nullif(keep, F.lit(NO_ID).cast("long")).alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256", "level", "name")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: group and verdict of each document."""
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("level", "name")


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT *, count(*) OVER (PARTITION BY norm) AS group_size, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
