"""Readers of records by kind of file, and writers of records and reports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_jsonl(spark: SparkSession, path: str, schema=None, strict: bool = True) -> DataFrame:
    """One object a line; blank lines are passed over. A line that is no object raises, or is left out where ``strict`` is false."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects, or an object whose ``data`` is one."""
    df = spark.read.option("multiLine", True).json(path)
    if df.columns == ["data"] or ("data" in df.columns and df.schema["data"].dataType.typeName() == "array"):
        return df.select(F.explode("data").alias("r")).select("r.*")
    return df


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: .jsonl and .ndjson, .json, .parquet and .pq; all else is CSV with a header."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix in ("jsonl", "ndjson"):
        return read_jsonl(spark, path)
    if suffix == "json":
        return read_json(spark, path)
    if suffix in ("parquet", "pq"):
        return spark.read.parquet(path)
    return spark.read.option("header", True).option("inferSchema", True).option("multiLine", True).option("escape", '"').csv(path)


def is_scan(path: str) -> bool:
    """Whether ``read_records`` gives a plain scan, as ``numbered`` needs it; an array in one JSON document is none."""
    return not path.rstrip("/").lower().endswith(".json")


#: Setting of a session: the least number of parts tables are dealt to, for small tables on many cores.
DEAL = "spark.quillspark.deal"
#: Bytes of a table's files for each part that it is dealt to.
PART = 1 << 20


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files of a folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(hadoop).getLength()


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table in parts of about PART bytes of its files, and at least as many as the session asks for (``DEAL``).

    A row group is one task's, whatever the size of splits, so a table of few row groups would be worked off by as many tasks.
    Rows are dealt by a hash of the first column, a table's key. Parts of one size hold Python workers to one size as well.
    """
    df, parts = spark.read.parquet(path), max(-(-size_of(spark, path) // PART), int(spark.conf.get(DEAL, None) or 1))
    return df.repartition(parts, df.columns[0]) if parts > 1 else df


#: Up to so many file splits their offsets go to all tasks; more are joined by an exchange.
FEW_SPLITS = 100_000
#: Columns that ``numbered`` uses on its way.
_FILE, _BLOCK, _PLACE = "__file", "__block", "__place"


def numbered(rows: DataFrame, name: str = "row") -> DataFrame:
    """Records as read from files, with ``name``: their place from 0 among all records, by path and place in the file.

    ``rows`` is a plain scan, as the readers here return it. In a first pass each file split counts its records; prefix sums
    over the splits, in two levels (splits of a file, files), give each split its offset; in the second pass a record's
    number is that offset and its place within the split. Numbers are values, so no later repartitioning
    changes them, and reruns give the same ones however files are split. The records themselves are not shuffled.
    """
    scan = rows.select("*", F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_BLOCK), F.monotonically_increasing_id().alias(_PLACE))
    splits = scan.groupBy(_FILE, _BLOCK).agg(F.count(F.lit(1)).alias("n"), F.min(_PLACE).alias("first"))
    splits = written(splits, "splits")
    files = splits.groupBy(_FILE).agg(F.sum("n").alias("n"))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda w: F.coalesce(F.sum("n").over(w), F.lit(0).cast("long"))
    files = files.select(_FILE, total(before(_FILE)).alias("of_file"))  # one row for each file
    offsets = splits.select(_FILE, _BLOCK, "first", total(before(_FILE, _BLOCK)).alias("of_split")).join(files, _FILE)
    offsets = offsets.select(_FILE, _BLOCK, (F.col("of_file") + F.col("of_split") - F.col("first")).alias("shift"))
    if splits.count() <= FEW_SPLITS:
        offsets = F.broadcast(offsets)
    return scan.join(offsets, [_FILE, _BLOCK]).select(*(F.col(f"`{c}`") for c in rows.columns), (F.col(_PLACE) + F.col("shift")).alias(name))


def split_size(spark: SparkSession, path: str, most: str, splits: int = 64) -> int:
    """Bytes of a split for about so many of them in a folder: 4 KB at least, ``most`` (a setting of Spark) at most."""
    size = size_of(spark, path)
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(most)
    return max(4096, min(-(-size // splits), most))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share (``spark.checkpoint.dir``), which goes when the session ends."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    path = f"{path.rstrip('/')}/{uuid.uuid4().hex}.{name}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def write_jsonl(df: DataFrame, path: str) -> None:
    """Fields of null are left out, as JSON writers of records do."""
    df.write.mode("overwrite").json(path)


def read_text(spark: SparkSession, path: str) -> str:
    """A whole small file."""
    return spark.read.text(path, wholetext=True).first()[0]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, on any store that Spark reaches."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
