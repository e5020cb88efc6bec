"""What the corpus operators share: text constants, written intermediate tables, heavy keys.

Row identity. Operators read ``doc_id`` and ``text`` only. Internally a null doc_id stands for the
smallest id (``NO_ID``) and a null text for an empty one. Rows that repeat a doc_id count as the
same document wherever documents are counted; each row still gets its own verdict, for which a
hash of its text is carried beside the id.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The white space of all contracts: U+0020 and U+0009 to U+000D.
WS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = -(2**63)

RID, TAG, TXT, ROW = "__rid", "__tag", "__txt", "__row"


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long"))


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, internal id, text hash and text of each row, free of the table's other columns."""
    return docs.select(F.col("doc_id"), row_id().alias(RID), text_of().alias(TXT)).withColumn(TAG, F.xxhash64(TXT))


def carried(docs: DataFrame, **more: Column) -> DataFrame:
    """Each row of ``docs`` whole in one struct, with its ids beside it: no column of the table can clash with ours."""
    return docs.select(F.struct("*").alias(ROW), row_id().alias(RID), F.xxhash64(text_of()).alias(TAG), *(c.alias(k) for k, c in more.items()))


def restored(rows: DataFrame, **changed: Column) -> DataFrame:
    """The columns of carried rows as they were, but for those ``changed`` that the table has."""
    return rows.select(*(changed.get(c, F.col(f"{ROW}.`{c}`")).alias(c) for c in rows.schema[ROW].dataType.names))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where all of them are one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def kept_by_worker(key: tuple, make: Callable):
    """What ``make`` gives, kept by this Python worker from task to task (one of a kind: another key takes its place)."""
    import sys

    held = vars(sys).setdefault("_quillspark_kept", {})
    if key not in held:
        for old in [k for k in held if k[0] == key[0]]:
            del held[old]
        held[key] = make()
    return held[key]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, which goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and a lost executor costs nothing."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def dropped(table: DataFrame) -> None:
    """Delete a ``stash`` that nothing reads any more; other tables are left alone."""
    if path := getattr(table, "stash_path", None):
        spark = table.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


#: A key is heavy if it holds one in SHARE of all rows, or one in twice the number of shuffle partitions where that is more.
SHARE, FLOOR, BUCKETS = 256, 1000, 64


def share_of(spark: SparkSession) -> int:
    """How many parts of all rows a key may not exceed one of; it follows the partitions, so no cold key is much beyond one."""
    return max(SHARE, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def heavy_keys(rows: DataFrame, keys: list[str], share: int | None = None, floor: int = FLOOR) -> DataFrame | None:
    """The at most ``share`` keys that each hold at least a 1/``share`` part of ``rows``, with their counts as ``heavy_n``, or None.

    Rows are counted in BUCKETS buckets of the key's hash for each part (a number of counts fixed by the
    session, combined before the shuffle; the numbers of the heavy ones alone come to the driver), then exactly
    within the few heavy buckets. The result is bounded by ``share`` rows whatever the input and so may be broadcast.
    """
    share = share or share_of(rows.sparkSession)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS * share)).cast("int")
    sizes = rows.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy(F.lit(0))))
    found = sizes.where((F.col("n") >= floor) & (F.col("n") * share >= F.col("all"))).collect()
    if not found:
        return None
    hot, least = [r["b"] for r in found], max(floor, -(-found[0]["all"] // share))
    return rows.where(bucket.isin(hot)).groupBy(*keys).agg(F.count(F.lit(1)).alias("heavy_n")).where(F.col("heavy_n") >= least)


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) to ``table``, which has one row for each key: heavy keys of ``rows`` by broadcast, all others by exchange."""
    hot = heavy_keys(rows, keys)
    if hot is None:
        return rows.join(table, keys, how)
    few = table.join(F.broadcast(hot), keys, "left_semi")
    cold = rows.join(F.broadcast(hot), keys, "left_anti").join(table, keys, how)
    return rows.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(few), keys, how).unionByName(cold)
