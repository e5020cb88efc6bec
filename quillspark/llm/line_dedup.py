"""Line dedup: range-partitioned hashes, streamed verdicts, compressed keep bitmaps.

Every line of at least ``min_chars`` code points (after trimming white space and lower-casing A-Z)
becomes a row (128-bit hash, document, position); texts stay where they are. Rows are range
partitioned by hash and sorted by hash, document and position, so one pass over a partition sees
the documents of a line in order. A line found in at least ``min_docs`` documents stays only in the
document with the largest id. Lines that hold more than 1/256 of all rows are too common for one
partition: they are found beforehand, at most 256 of them, counted with map-side combination and
resolved where their rows lie, by a broadcast of those few verdicts.

What comes back for each document is a sparse bitmap: 64-bit words of dropped positions, where an
absent word means that all its lines stay. ``apply`` joins bitmaps to texts.

Defined cases: null or empty text is one empty line and stays; a null doc_id counts as the smallest
id; rows that repeat a doc_id are one document when documents are counted, and all their lines of
that document are treated alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import LOWER, RID, ROW, TAG, TXT, UPPER, WS, carried, heavy_keys, let, restored, rows_of, stash

MIN_CHARS, MIN_DOCS = 20, 3


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(hash, document, row's text hash, position) of each line that is long enough to count."""
    lines = rows_of(docs).select(RID, TAG, F.posexplode(F.split(TXT, "\n")).alias("pos", "line"))
    key = F.translate(F.btrim("line", F.lit(WS)), UPPER, LOWER)
    keyed = lines.select(RID, TAG, "pos", key.alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7919), F.col("key")).alias("h2"), RID, TAG, "pos")


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(document, row's text hash, position) of each line that goes."""
    lines = stash(hashed_lines(docs, min_chars), "lines")  # texts are read once here; what follows reads hashes
    hot = heavy_keys(lines, ["h1", "h2"])
    cold = lines if hot is None else lines.join(F.broadcast(hot), ["h1", "h2"], "left_anti")
    ranged = cold.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", RID, "pos")
    same = Window.partitionBy("h1", "h2")
    nth = F.dense_rank().over(same.orderBy(RID))
    seen = ranged.withColumn("nth", nth).select("*", F.max("nth").over(same).alias("n_docs"))
    drop = seen.where((F.col("n_docs") >= min_docs) & (F.col("nth") < F.col("n_docs"))).select(RID, TAG, "pos")
    if hot is None:
        return drop
    rows = lines.join(F.broadcast(hot), ["h1", "h2"], "left_semi")
    each = rows.groupBy("h1", "h2", RID).agg(F.lit(1).alias("one"))
    verdicts = each.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max(RID).alias("last")).where(F.col("n_docs") >= min_docs)
    return drop.unionByName(rows.join(F.broadcast(verdicts), ["h1", "h2"]).where(F.col(RID) < F.col("last")).select(RID, TAG, "pos"))


def bitmaps(dropped: DataFrame) -> DataFrame:
    """One row for each row of documents that loses lines: its sparse bitmap of dropped positions."""
    word = F.expr("cast(pos div 64 as int)")
    bit = F.expr("shiftleft(1L, pos % 64)")
    words = dropped.repartition(RID, TAG).groupBy(RID, TAG, word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy(RID, TAG).agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("__dropped"))


def _kept(lines: Column) -> Column:
    """The lines whose bit in ``dropped`` is clear; bits are looked up in a dense array made once for a text."""
    dense = let(
        F.map_from_entries("__dropped"),
        lambda m: F.transform(F.sequence(F.lit(0), F.shiftright(F.size(lines) - 1, 6)), lambda w: F.coalesce(F.element_at(m, w), F.lit(0).cast("long"))),
    )
    bit = lambda d, i: F.get(d, F.shiftright(i, 6)).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(i, F.lit(64))))
    return F.array_join(let(dense, lambda d: F.filter(lines, lambda _, i: bit(d, i) == 0)), "\n")


def apply(docs: DataFrame, maps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text of each row."""
    lines = F.split(TXT, "\n")
    rows = rows_of(docs).join(maps, [RID, TAG], "left")
    n_dropped = F.coalesce(F.aggregate("__dropped", F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w["bits"])), F.lit(0).cast("long"))
    return rows.select(
        "doc_id", RID, TAG, F.size(lines).cast("long").alias("n_lines"), n_dropped.alias("n_dropped"),
        F.when(F.col("__dropped").isNull(), F.col(TXT)).otherwise(_kept(lines)).alias("kept_text"))


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    return apply(docs, bitmaps(dropped_lines(docs, min_chars, min_docs)))


def filter_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the dropped lines taken from the texts; n_chars, where present, follows the text."""
    maps = bitmaps(dropped_lines(docs, **options))
    rows = carried(docs).join(maps, [RID, TAG], "left")
    kept = F.when(F.col("__dropped").isNotNull(), _kept(F.split(F.col(f"{ROW}.text"), "\n")))
    out = {"text": F.coalesce(kept, F.col(f"{ROW}.text"))}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.coalesce(F.char_length(kept).cast("long"), F.col(f"{ROW}.n_chars"))
    return restored(rows, **out)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: line counts and hash of what is kept, for each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
v AS (SELECT k.*, c.last IS NOT NULL AND k.doc_id < c.last AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM v GROUP BY doc_id
"""
