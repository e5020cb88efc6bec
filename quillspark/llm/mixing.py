"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

The mix is a sequence of slots of ``block`` words. Slot i maps the golden-ratio point frac((i + 1/2) / phi)
through the sources' cumulative targets, so any stretch of the mix holds the sources nearly in
proportion. The r-th slot of a source takes the r-th block of that source's stream: its documents in
the order of a seeded hash, up to three times over. A slot joined to its block names the words of the
documents that it holds.

Nothing is gathered per source: slots are ranked and documents placed in two levels (a count or sum
per chunk, prefix sums over chunks, then order within the chunk), so a source with a third of all
documents is spread over many tasks. The number of slots that points deal is bounded by SLOTS; block sizes
grow with the corpus instead. A source gives exactly its rounded target, whatever the block: its last
block ends there, points beyond it stay empty, and blocks that no point was left for (those of sources
under a block among them) get slots of their own, a few per source, spread over the mix beside the others.

Defined cases: null or empty text has size 0 and is never taken; null sources come last in the order
of weights; rows that repeat a doc_id are separate entries of the mix; an empty table or one without
words gives targets and takings of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import RID, ROW, TAG, TXT, WORD, WS, carried, restored, row_id, stash, text_of

WEIGHTS, MAX_TIMES = (1, 2, 3), 3
SLOTS, LEAST_BLOCK, SEED = 2**20, 64, 20240229
CHUNK, CELLS, PLACES = 1024, 4096, 4096
GOLDEN = 0.6180339887498949


#: Source tables of up to so many rows are broadcast; larger ones are joined by shuffle, where AQE splits skew.
BROADCAST_SOURCES = 20_000


def per_source(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_SOURCES else table


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))


def sizes_of(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, ids, source key, size in words."""
    rows = docs.select("doc_id", row_id().alias(RID), text_of().alias(TXT), source_key().alias("source_key"))
    return rows.select("doc_id", RID, F.xxhash64(TXT).alias(TAG), "source_key", n_words(F.col(TXT)).alias("size"), F.monotonically_increasing_id().alias("uid"))


def targets(sizes: DataFrame, weights=WEIGHTS, max_times: int = MAX_TIMES) -> DataFrame:
    """source_key, source_size, weight, target: one row for each source.

    The water level: with sources ordered by cap over weight, those before the first that stays under
    its cap are capped, and the others share what is left by weight.
    """
    s = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source_key") == "-", "source_key")) - 1
    s = s.withColumn("weight", F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), (F.pmod(nth, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", max_times * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "source_key").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    before = lambda c: F.coalesce(F.sum(c).over(order), F.lit(0).cast("long"))
    s = s.select("*", (F.sum("source_size").over(everything) - before("cap")).alias("left"), (F.sum("weight").over(everything) - before("weight")).alias("w_left"))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    s = s.withColumn("capped", big("cap") * big("w_left") <= big("left") * big("weight"))
    level = F.max(F.when(~F.col("capped"), F.col("left").cast("double") / F.col("w_left"))).over(everything)
    return s.select("source_key", "source_size", "weight", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level * F.col("weight")).alias("target"))


def schedule(spark, goals: DataFrame, n_slots: int) -> DataFrame:
    """(slot, source_key, rank): the r-th slot of a source has rank r, from 0."""
    order = Window.orderBy("source_key")
    total = F.sum("target").over(Window.partitionBy(F.lit(0)))
    shares = goals.where("target > 0").select("source_key", (F.sum("target").over(order) / total).alias("hi"))
    shares = shares.select("source_key", F.lag("hi", 1, 0.0).over(order).alias("lo"), F.when(F.lead("hi").over(order).isNull(), F.lit(2.0)).otherwise(F.col("hi")).alias("hi"))
    cell = lambda c: F.least(F.floor(c * CELLS), F.lit(CELLS - 1).cast("long"))
    shares = shares.select("*", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    x = (F.col("id") + 0.5) * F.lit(GOLDEN)
    points = spark.range(n_slots).select(F.col("id").alias("slot"), (x - F.floor(x)).alias("u"))
    dealt = points.withColumn("cell", cell(F.col("u"))).join(shares, "cell").where("u >= lo and u < hi").select("slot", "source_key", F.expr(f"slot div {CHUNK}").alias("chunk"))
    counts = dealt.groupBy("source_key", "chunk").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("source_key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    counts = counts.select("source_key", "chunk", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("source_key", "chunk").orderBy("slot")) - 1
    return dealt.withColumn("own", own).join(counts, ["source_key", "chunk"]).select("slot", "source_key", (F.col("before") + F.col("own")).alias("rank"))


def settled(plan: DataFrame, goals: DataFrame, block: int, n_slots: int) -> DataFrame:
    """``plan`` and a slot for each block up to a source's ``words`` that it has none for, at the block's share of the mix."""
    dealt = plan.groupBy("source_key").agg(F.count(F.lit(1)).alias("n_slots"))
    short = goals.where("words > 0").join(dealt, "source_key", "left").select("source_key", F.coalesce("n_slots", F.lit(0).cast("long")).alias("n_slots"), F.expr(f"(words - 1) div {block} + 1").alias("blocks"))
    more = short.where("n_slots < blocks").withColumn("rank", F.explode(F.sequence(F.col("n_slots"), F.col("blocks") - 1)))
    within = F.pmod(F.xxhash64("source_key"), F.lit(2**20)) / 2**20
    return plan.unionByName(more.select(F.floor((F.col("rank") + within) / F.col("blocks") * n_slots).alias("slot"), "source_key", "rank"))


def placed(sizes: DataFrame, seed: int = SEED) -> DataFrame:
    """Each document's place in its source's shuffled stream: ``at``, words before it."""
    rows = sizes.where("size > 0").withColumn("ord", F.xxhash64(F.lit(seed), RID, TAG))
    rows = rows.withColumn("place", F.shiftright("ord", 64 - (PLACES.bit_length() - 1)))
    sums = rows.groupBy("source_key", "place").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source_key").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    sums = sums.select("source_key", "place", before.alias("before"))
    own = F.sum("size").over(Window.partitionBy("source_key", "place").orderBy("ord", RID, TAG, "uid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return rows.withColumn("own", own).join(sums, ["source_key", "place"]).select("uid", "source_key", "size", (F.col("before") + F.col("own")).alias("at"))


def mix(docs: DataFrame, weights=WEIGHTS, max_times: int = MAX_TIMES, slots: int = SLOTS, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes, targets, parts). parts: the mix, in pieces (slot, uid, first word, words)."""
    spark = docs.sparkSession
    sizes = stash(sizes_of(docs), "sizes")
    goals = stash(targets(sizes, weights, max_times), "targets")
    total = goals.agg(F.sum("source_size")).first()[0] or 0
    block = max(LEAST_BLOCK, -(-total // slots))
    n_slots = -(-total // block)
    goals = goals.withColumn("words", F.floor(F.coalesce("target", F.lit(0.0)) + 0.5))
    plan = settled(stash(schedule(spark, goals, n_slots), "schedule"), goals, block, n_slots)
    streams = placed(sizes, seed).join(per_source(goals.where("words > 0").select("source_key", "source_size", F.col("words").alias("goal"))), "source_key")
    passes = streams.withColumn("start", F.explode(F.transform(F.sequence(F.lit(0), F.lit(max_times - 1)), lambda j: F.col("at") + j * F.col("source_size"))))
    passes = passes.where("start < goal").withColumn("end", F.least(F.col("start") + F.col("size"), F.col("goal")))
    pieces = passes.withColumn("rank", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(end - 1) div {block}"))))
    lo, hi = F.greatest("start", F.col("rank") * block), F.least(F.col("end"), (F.col("rank") + 1) * block)
    pieces = pieces.select("uid", "source_key", "rank", (lo - F.col("start")).alias("first_word"), (hi - lo).alias("words"))
    return sizes, goals, plan.join(pieces, ["source_key", "rank"]).select("slot", "uid", "first_word", "words")


def takings(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot (null where nothing is taken), n_slots and internal ids of each row."""
    sizes, goals, parts = mix(docs, **options)
    taken = parts.groupBy("uid").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.count_distinct("slot").alias("n_slots"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return sizes.join(per_source(goals), "source_key").join(taken, "uid", "left").select(
        "doc_id", "size", "source_size", "target", none("taken"), "first_slot", none("n_slots"), RID, TAG, "source_key", "uid")


def filter_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, in the order of their first slots: each as often as it is taken; one taken in part brings its first words.

    Rows are range partitioned and sorted by slot, so that files written of them hold the mix from its beginning to its end, and any
    stretch of them holds the sources nearly in proportion. The words that a source gives are the head of its stream, so in any pass at most one document of
    a source is cut.
    """
    taken = takings(docs, **options).groupBy(RID, TAG, "source_key").agg(F.sum("taken").alias("taken"), F.max("size").alias("size"), F.count(F.lit(1)).alias("n_rows"), F.min("first_slot").alias("first_slot"))
    rows = carried(docs, source_key=source_key()).join(taken, [RID, TAG, "source_key"])
    # rows that are equal in id, text and source share what they take
    rows = rows.withColumn("share", F.expr("cast(taken div n_rows as bigint)")).where("size > 0 and share > 0")
    whole, rest = F.expr("cast(share div size as int)"), F.expr("share % size")
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("cut", F.explode(copies))
    text = F.col(f"{ROW}.text")
    head = F.array_join(F.slice(F.split(F.ltrim(text, F.lit(WS)), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"), F.lit(1), F.col("cut").cast("int")), "")
    out = {"text": F.when(F.col("cut") == 0, text).otherwise(head)}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("cut") == 0, F.col(f"{ROW}.n_chars")).otherwise(F.char_length(head).cast("long"))
    order = ["first_slot", RID, TAG, "source_key", F.desc("cut")]
    return restored(rows.repartitionByRange(*order).sortWithinPartitions(*order), **out)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: size, target, takings and slots of each document."""
    return takings(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")
