"""Queries of streams: pages replayed as snapshots, bursts of events, settings that change; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.sources import readers, snapshots
from quillspark.streaming import pages, quiet

#: Rounds of snapshots; a burst's quiet period and a scan's delay in seconds.
ROUNDS, QUIET, DELAY = 4, 6 * 3600, 12 * 3600
_GONE = "<html><body></body></html>"


def _end(stream) -> None:
    stream.trigger(availableNow=True).start().awaitTermination()


def _round(rows: DataFrame, seq: int) -> DataFrame:
    """The pages as they are at a round: every third is empty, and in the last round articles got a word more."""
    html = F.replace("html", F.lit("</article>"), F.lit(" Edited.</article>")) if seq == ROUNDS - 1 else F.col("html")
    return rows.select("page_id", F.when(F.pmod(F.col("page_id") + seq, F.lit(3)) == 0, _GONE).otherwise(html).alias("html"))


def _page_changes(spark: SparkSession, d: str, target: str, live: pages.Live | None = None) -> None:
    """Replay the pages as rounds of snapshots, two at a time, on one checkpoint; changes go to ``target``."""
    log, checkpoint = readers.scratch(spark, "log"), readers.scratch(spark, "checkpoint")
    table = spark.read.parquet(f"{d}/pages.parquet")

    def write(batch: DataFrame, number: int) -> None:
        path = f"{target}/batch={number}"
        batch.write.mode("overwrite").parquet(path)
        if live:
            live.merge(spark.read.schema(pages.OUT).parquet(path), number)

    with pages.stateful(spark):
        for seq in range(ROUNDS):
            snapshots.append(_round(table, seq), log, seq)
            if seq % 2:
                out = pages.watch(snapshots.read_stream(spark, log), "page")
                _end(out.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write))


def page_stream(spark: SparkSession, d: str) -> DataFrame:
    """Each change of an element of the replayed pages: scored (with its text) or removed."""
    target = readers.scratch(spark, "changes")
    _page_changes(spark, d, target)
    rows = spark.read.schema(pages.OUT).parquet(f"{target}/batch=*")
    return rows.select(F.col("page_id").cast("long").alias("page_id"), "element_id", "seq", "change", F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_md5"))


def live_elements(spark: SparkSession, d: str) -> DataFrame:
    """The elements that are there after the replay, with the round in which they were scored last."""
    target, root = readers.scratch(spark, "changes"), readers.scratch(spark, "live")
    live = pages.Live(spark, root, "page_id string, element_id string, seq long, text string")
    _page_changes(spark, d, target, live)
    return live.read().select(F.col("page_id").cast("long").alias("page_id"), "element_id", "seq", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


def snapshot_log(spark: SparkSession, d: str) -> DataFrame:
    """The whole log of snapshots in one batch: rounds, pages and characters."""
    log = readers.scratch(spark, "log")
    for seq in range(ROUNDS):
        snapshots.append(_round(spark.read.parquet(f"{d}/pages.parquet"), seq), log, seq)
    return snapshots.read(spark, log).groupBy("seq").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.char_length("html")).alias("chars"))


def _bursts(spark: SparkSession, d: str, bursts) -> DataFrame:
    source, checkpoint, target = (readers.scratch(spark, k) for k in ("events", "checkpoint", "bursts"))
    events = spark.read.parquet(f"{d}/events.parquet")
    rows = events.select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast(T.TimestampType()).alias("at"), F.col("event_type").alias("state")).where("key is not null and at is not null")
    schema = rows.schema
    lo, hi = rows.agg(F.coalesce(F.min(F.unix_micros("at")), F.lit(0)), F.coalesce(F.max(F.unix_micros("at")), F.lit(0))).first()
    part = F.least(F.floor((F.unix_micros("at") - lo) * 4 / max(hi - lo, 1)), F.lit(3))
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{target}/batch={n}")
    # rows of no key end the stream: the first moves the watermark beyond all timers, the second makes a batch in which they fire
    end = spark.range(1).select(F.lit(None).cast("string").alias("key"), F.timestamp_micros(F.lit(hi + 10 * 86_400_000_000)).alias("at"), F.lit(None).cast("string").alias("state"))
    with pages.stateful(spark):
        for i in range(6):
            (rows.where(part == i) if i < 4 else end).write.mode("append").parquet(source)
            stream = spark.readStream.schema(schema).parquet(source)
            _end(bursts(stream).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write))
    return spark.read.schema(quiet.OUT).parquet(f"{target}/batch=*").select(F.col("key").cast("long").alias("user_id"), "first_us", "last_us", "n", "state")


def quiet_periods(spark: SparkSession, d: str) -> DataFrame:
    """Runs of a user's events with gaps below the quiet period, each with its last type, once it is over."""
    return _bursts(spark, d, lambda stream: quiet.settled(stream, QUIET))


def delayed_scans(spark: SparkSession, d: str) -> DataFrame:
    """What scans see that come a fixed time after the first event of a user that no scan has seen."""
    return _bursts(spark, d, lambda stream: quiet.scans(stream, DELAY))


def settings_reset(spark: SparkSession, d: str) -> DataFrame:
    """Events as edits of one element per user, under two settings on one checkpoint: how often each is scored under each.

    Half way through the settings change; all elements that are there are scored again under the new ones.
    """
    source, inbox, checkpoint, target, root = (readers.scratch(spark, k) for k in ("edits", "inbox", "checkpoint", "scored", "live"))
    events = spark.read.parquet(f"{d}/events.parquet").where("ts is not null and user_id is not null")
    rows = events.select(F.col("user_id").alias("page_id"), F.unix_micros(F.col("ts").cast(T.TimestampType())).alias("seq"), F.lit("element").alias("element_id"), F.lit("reddit").alias("platform"), F.lit("post").alias("kind"), F.col("event_type").alias("text"))
    lo, hi = rows.agg(F.coalesce(F.min("seq"), F.lit(0)), F.coalesce(F.max("seq"), F.lit(0))).first()
    live = pages.Live(spark, root, pages.OUT)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")
        live.merge(spark.read.schema(pages.OUT).parquet(f"{target}/batch={number}"), number)

    spark.createDataFrame([], pages.ROWS).write.parquet(inbox)
    with pages.stateful(spark):
        for version in (1, 2):
            half = F.col("seq") * 2 < lo + hi
            rows.where(half if version == 1 else ~half).write.mode("append").parquet(source)
            if version == 2:
                pages.rescan(live.read(), inbox, version)
            stream = spark.readStream.schema("page_id long, seq long, element_id string, platform string, kind string, text string").parquet(source)
            out = pages.watch_with_rescans(pages.fingerprinted(stream, version), inbox)
            _end(out.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write))
    found = spark.read.schema(pages.OUT).parquet(f"{target}/batch=*").where("change = 'scored'")
    return found.groupBy(F.col("page_id").cast("long").alias("user_id"), "version").agg(F.count(F.lit(1)).alias("scored"))


# ---- SQL ----


def oracle_sql() -> dict[str, str]:
    entity = "replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"
    body = entity.format("regexp_replace(regexp_extract(html, '(?s)<article[^>]*>(.*?)(?:</article>|$)', 1), '<[^>]*>', '', 'g')")
    rounds = f"""rounds AS (
  SELECT page_id, seq, CASE WHEN (page_id + seq) % 3 = 0 THEN '{_GONE}' WHEN seq = {ROUNDS - 1} THEN replace(html, '</article>', ' Edited.</article>') ELSE html END AS html
  FROM pages, range({ROUNDS}) t(seq)
)"""
    changed = f"""WITH {rounds}, texts AS (
  SELECT page_id, seq, nullif(trim(regexp_replace({body}, '\\s+', ' ', 'g')), '') AS text FROM rounds
), before AS (
  SELECT *, lag(text) OVER (PARTITION BY page_id ORDER BY seq) AS old FROM texts
)"""
    events = "e AS (SELECT user_id, event_type, epoch_us(ts) AS us FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL)"
    return {
        "page_stream": f"""{changed}
SELECT page_id, 'post-0' AS element_id, seq, CASE WHEN text IS NULL THEN 'removed' ELSE 'scored' END AS change, md5(coalesce(text, '')) AS text_md5
FROM before WHERE text IS DISTINCT FROM old""",
        "live_elements": f"""{changed}, scored AS (
  SELECT page_id, max(seq) AS seq, max_by(text, seq) AS text FROM before WHERE text IS DISTINCT FROM old GROUP BY page_id
)
SELECT page_id, 'post-0' AS element_id, seq, md5(text) AS text_md5 FROM scored WHERE text IS NOT NULL
AND page_id IN (SELECT page_id FROM texts WHERE seq = {ROUNDS - 1} AND text IS NOT NULL)""",
        "snapshot_log": f"WITH {rounds} SELECT seq, count(*) AS pages, sum(length(html))::BIGINT AS chars FROM rounds GROUP BY seq",
        "quiet_periods": f"""WITH {events}, gaps AS (
  SELECT *, CASE WHEN us - lag(us) OVER w < {QUIET * 1_000_000} THEN 0 ELSE 1 END AS starts FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_type)
), runs AS (
  SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY us, event_type ROWS UNBOUNDED PRECEDING) AS run FROM gaps
)
SELECT user_id, min(us) AS first_us, max(us) AS last_us, count(*) AS n, max_by(event_type, (us, event_type)) AS state FROM runs GROUP BY user_id, run""",
        "delayed_scans": f"""WITH RECURSIVE {events}, firsts AS (
  SELECT user_id, min(us) AS first FROM e GROUP BY user_id
  UNION ALL
  SELECT f.user_id, (SELECT min(us) FROM e WHERE e.user_id = f.user_id AND e.us >= f.first + {DELAY * 1_000_000}) AS first FROM firsts f
  WHERE EXISTS (SELECT 1 FROM e WHERE e.user_id = f.user_id AND e.us >= f.first + {DELAY * 1_000_000})
)
SELECT user_id, first AS first_us, max(us) AS last_us, count(*) AS n, max_by(event_type, (us, event_type)) AS state
FROM firsts JOIN e USING (user_id) WHERE us >= first AND us < first + {DELAY * 1_000_000} GROUP BY user_id, first""",
        "settings_reset": f"""WITH {events}, b AS (
  SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY us) AS old, us * 2 < (SELECT min(us) + max(us) FROM e) AS early FROM e
), n AS (
  SELECT user_id, CASE WHEN early THEN 1 ELSE 2 END AS version FROM b WHERE event_type IS DISTINCT FROM old
  UNION ALL SELECT DISTINCT user_id, 2 FROM b WHERE early
)
SELECT user_id, version::BIGINT AS version, count(*) AS scored FROM n GROUP BY ALL""",
    }


def queries():
    return {f.__name__: f for f in (page_stream, live_elements, snapshot_log, quiet_periods, delayed_scans, settings_reset)}
