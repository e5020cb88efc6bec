"""Window panes with revisions: hourly totals that are published once they are due, and revised when late rows still come.

Rows arrive in batches. Each batch goes through a native streaming aggregation (count and sum per kind and event
hour, update mode) that retains the totals of all open panes; the query is started anew for each batch, on one checkpoint.
``foreachBatch`` joins the panes that changed to the table of panes published so far (kept in the shared folder, one
version per batch) and writes its next version with the records that each pane makes: what is due, what is revised, what is forgotten. Rows of closed panes bypass
the aggregation: they go to the sink as they are.

The clock W is the greatest event time of all earlier batches. A pane is due once W has reached its end plus DUE_HOURS, and
closed once W has reached its end plus CLOSED_HOURS. Both bounds are whole hours, so the greatest event hour decides
like W itself. Spark's own watermark (greatest event time less CLOSED_HOURS) frees the state of a pane exactly when
the pane is closed. Watermarks start at 1970, before which events may lie, so the stream's time is shifted by SHIFT_DAYS.

Nothing that grows with the rows meets in one task, on the driver or in a broadcast: rows are deduplicated by an exchange
on their id, batches are written by ranges of (batch, id), totals are combined before their exchange, and the
table of panes is joined by an exchange on (kind, hour), where each pane is one row. The driver gets one hour per batch.
A batch's outputs are overwritten if it runs again, and follow from its rows and the version before it alone.

Defined cases: rows without ts are left out; of rows with one click_id (nulls count as one id) the smallest by (ts,
arrived_at, kind, value) stays; without arrived_at a row arrives on the day of its ts; a kind of null is ``none``; a value
of null, NaN or infinity counts 0 cents. A batch without rows still publishes what is due. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import new_path

BATCHES, DUE_HOURS, CLOSED_HOURS = 10, 12, 48
#: So many days are added to the stream's event times; more than lie between year 1, less the days of a cycle, and 1970.
SHIFT_DAYS = 800_000
#: Partitions of panes that one task takes. A checkpoint's partitions are as many as they were at first, whatever a batch holds; panes are few next to rows.
TOGETHER = 8
DAY_US, HOUR_US = 86_400_000_000, 3_600_000_000
ROWS = "click_id long, event_us long, kind string, hour long, cents long"
PANES = "kind string, hour long, n_rows long, cents long, published boolean, kept boolean, records array<struct<record:string,n_rows:long,cents:long>>, batch long"
CHANGES = "hour long, click_id long, n_rows long, cents long, record string, kind string, batch long"


def _micros(column: str) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    return F.expr(f"cast((cast(`{column}` as timestamp_ntz) - timestamp_ntz'1970-01-01 00:00:00') div interval '0.000001' second as bigint)")


def cut(clicks: DataFrame) -> DataFrame:
    """``batch`` and the columns of ROWS of each click, once."""
    cents = F.coalesce(F.when(F.abs("value") < float("inf"), F.floor(F.col("value") * 100 + 0.5)), F.lit(0)).cast("long")
    rows = clicks.where("ts is not null").select(
        F.col("click_id").cast("long").alias("click_id"), _micros("ts").alias("ts_us"),
        F.floor(F.coalesce(_micros("arrived_at"), _micros("ts")) / DAY_US).cast("long").alias("day"),
        F.coalesce(F.col("kind"), F.lit("none")).alias("kind"), cents.alias("cents"))
    once = rows.groupBy("click_id").agg(F.min(F.struct("ts_us", "day", "kind", "cents")).alias("r")).select("click_id", "r.*")
    q = F.pmod(F.col("day"), F.lit(BATCHES))
    delay = F.greatest(F.lit(0), F.crc32(F.coalesce(F.col("click_id").cast("string"), F.lit("")).cast("binary")) % 30 - 23)
    event = F.col("ts_us") - (F.col("day") - q) * DAY_US
    hour = F.floor(event / HOUR_US)
    return once.select("click_id", event.alias("event_us"), "kind", hour.cast("long").alias("hour"), "cents", F.least(F.lit(BATCHES - 1), q + delay).cast("int").alias("batch"))


def write_batches(rows: DataFrame, path: str, batches: int = BATCHES) -> None:
    """``rows`` in a folder for each batch, of which those without rows get a file without rows, so that they run too."""
    spark = rows.sparkSession
    # ranges of (batch, id) hold equally many rows: few files for each batch, none of them for one task
    rows.repartitionByRange("batch", "click_id").write.partitionBy("batch").parquet(path)
    there = {r.batch for r in rows.sparkSession.read.parquet(path).select("batch").distinct().collect()} if _exists(spark, path, "batch=*") else set()
    for b in sorted(set(range(batches)) - there):
        spark.createDataFrame([], ROWS).coalesce(1).write.mode("append").parquet(f"{path}/batch={b}")


def _exists(spark: SparkSession, path: str, pattern: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{pattern}")
    return bool(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop))


class Publisher:
    """The panes published so far and the records made of them, under ``root``."""

    def __init__(self, spark: SparkSession, root: str, batches: int = BATCHES, due: int = DUE_HOURS, closed: int = CLOSED_HOURS):
        self.spark, self.root, self.batches, self.due, self.closed = spark, root, batches, due, closed
        self.now: int | None = None  # the greatest event hour of all batches that ran

    def _path(self, kind: str, batch: int) -> str:
        return f"{self.root}/{kind}/batch={batch}"

    def stream(self, batch: int) -> DataFrame:
        """Of the newest batch: new totals of the panes that changed, and the rows of closed panes."""
        now, files = self.now, f"{self.root}/rows/batch={{{','.join(map(str, range(batch + 1)))}}}"
        rows = self.spark.readStream.schema(ROWS).parquet(files)
        late = F.lit(False) if now is None else F.col("hour") + 1 + self.closed <= now
        timed = rows.where(~late).withColumn("time", F.timestamp_micros(F.col("event_us") + SHIFT_DAYS * DAY_US)).withWatermark("time", f"{self.closed} hours")
        totals = timed.groupBy("kind", F.window("time", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("cents").alias("cents"))
        hour = F.floor(F.unix_micros("w.start") / HOUR_US).cast("long") - SHIFT_DAYS * 24
        panes = totals.select(hour.alias("hour"), F.lit(-1).cast("long").alias("click_id"), "n_rows", "cents", F.lit("pane").alias("record"), "kind")
        passed = rows.where(late).select("hour", "click_id", F.lit(1).cast("long").alias("n_rows"), "cents", F.lit("late").alias("record"), "kind")
        return panes.unionByName(passed).withColumn("batch", F.lit(batch).cast("long"))

    def publish(self, changes: DataFrame, batch: int) -> None:
        """Write the batch's changes, and the next version of the panes with the records that they make."""
        now, clock = self.now, Observation()
        # written first: the aggregation runs once, whatever is read from it
        fewer = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // TOGETHER)
        changes.observe(clock, F.max("hour").alias("hour")).coalesce(fewer).write.mode("overwrite").parquet(self._path("changes", batch))
        self.latest = clock.get.get("hour")
        new = self.spark.read.schema(CHANGES).parquet(self._path("changes", batch)).where("record = 'pane'").select("kind", "hour", F.col("n_rows").alias("new_n"), F.col("cents").alias("new_cents"))
        before = self.spark.read.schema(PANES).parquet(self._path("panes", batch - 1)) if batch else self.spark.createDataFrame([], PANES)
        both = before.where("kept").drop("records", "kept", "batch").join(new, ["kind", "hour"], "full_outer")
        changed, known = F.col("new_n").isNotNull(), F.coalesce("published", F.lit(False))
        reached = lambda hours: F.lit(False) if now is None else F.col("hour") + 1 + hours <= now
        n, cents = F.coalesce("new_n", "n_rows"), F.coalesce("new_cents", "cents")
        record = lambda name, n, cents: F.struct(F.lit(name).alias("record"), n.alias("n_rows"), cents.alias("cents"))
        made = (
            F.when(known & changed, F.array(record("retract", F.col("n_rows"), F.col("cents")), record("replace", n, cents)))
            .when(~known & reached(self.due), F.array(record("emit", n, cents)))
            .when(~known & F.lit(batch == self.batches - 1), F.array(record("final", n, cents)))
        )
        out = both.select(
            "kind", "hour", n.alias("n_rows"), cents.alias("cents"), (known | reached(self.due)).alias("published"), (~reached(self.closed)).alias("kept"),
            made.alias("records"), F.lit(batch).cast("long").alias("batch"))
        out.coalesce(fewer).write.mode("overwrite").parquet(self._path("panes", batch))

    def run(self, batch: int) -> None:
        """Start the query on the checkpoint, let it take the batch's rows, and end it."""
        query = (
            self.stream(batch).writeStream.outputMode("update").option("checkpointLocation", f"{self.root}/checkpoint")
            .foreachBatch(lambda df, _: self.publish(df, batch)).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        self.now = max((x for x in (self.now, self.latest) if x is not None), default=None)

    def records(self) -> DataFrame:
        """All records of all batches."""
        read = lambda kind, schema: self.spark.read.schema(schema).parquet(*(self._path(kind, b) for b in range(self.batches)))
        made = read("panes", PANES).select("batch", "hour", "kind", F.explode("records").alias("r"))
        made = made.select("batch", "hour", F.lit(-1).cast("long").alias("click_id"), "r.n_rows", "r.cents", "r.record", "kind")
        return made.unionByName(read("changes", CHANGES).where("record = 'late'"))


def revisions(clicks: DataFrame, batches: int = BATCHES) -> DataFrame:
    """batch, hour, click_id, n_rows, cents, record and kind of every record that the batches give, in a new folder at every call."""
    spark = clicks.sparkSession
    root = new_path(spark, "panes")
    write_batches(cut(clicks), f"{root}/rows", batches)
    publisher = Publisher(spark, root, batches)
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")  # state is freed when the next batch runs; a run without rows would be one batch too many
    try:
        for b in range(batches):
            publisher.run(b)
    finally:
        spark.conf.set(key, before)
    return publisher.records().select("batch", "hour", "click_id", "n_rows", "cents", "record", "kind")


def query(spark, sf_dir: str) -> DataFrame:
    """op12: what the batches of clicks publish."""
    return revisions(spark.read.parquet(f"{sf_dir}/clicks.parquet"))


ORACLE = f"""
WITH RECURSIVE bits(i, c, k) AS (
  SELECT i, i::UBIGINT, 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
once AS (
  SELECT click_id, any_value(epoch_us(ts)) AS ts_us, any_value(floor(epoch_us(arrived_at) / {DAY_US}.0)::BIGINT) AS d,
    any_value(coalesce(kind, 'none')) AS kind, any_value(coalesce(floor(100 * value + 0.5)::BIGINT, 0)) AS cents
  FROM clicks WHERE ts IS NOT NULL GROUP BY click_id
), hashed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(click_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS crc FROM once, crc
), r AS MATERIALIZED (
  SELECT click_id, kind, cents, ts_us - (d - d % 10) * {DAY_US} AS ev, floor((ts_us - (d - d % 10) * {DAY_US}) / {HOUR_US}.0)::BIGINT AS hour,
    least(9, d % 10 + greatest(0, crc % 30 - 23)) AS batch FROM hashed
), w AS MATERIALIZED (
  SELECT b, max(ev) AS w FROM range({BATCHES}) t(b) LEFT JOIN r ON batch < b GROUP BY b
), marked AS MATERIALIZED (
  SELECT r.*, coalesce(w.w >= (hour + 1 + {CLOSED_HOURS}) * {HOUR_US}, false) AS late FROM r JOIN w ON batch = b
), steps AS MATERIALIZED (
  SELECT kind, hour, batch, count(*) AS n, sum(cents)::BIGINT AS c FROM marked WHERE NOT late GROUP BY ALL
), sums AS MATERIALIZED (
  SELECT *, sum(n) OVER p AS n_rows, sum(c) OVER p AS total FROM steps WINDOW p AS (PARTITION BY kind, hour ORDER BY batch)
), due AS MATERIALIZED (
  SELECT kind, hour, first, min(b) AS due FROM (SELECT kind, hour, min(batch) AS first FROM steps GROUP BY ALL)
    LEFT JOIN w ON b >= first AND w >= (hour + 1 + {DUE_HOURS}) * {HOUR_US} GROUP BY ALL
), shown AS (
  SELECT kind, hour, coalesce(due, 9) AS batch, CASE WHEN due IS NULL THEN 'final' ELSE 'emit' END AS record, max(n_rows) AS n_rows, max_by(total, s.batch) AS cents
  FROM due JOIN sums s USING (kind, hour) WHERE s.batch <= coalesce(due, 9) GROUP BY ALL
), revised AS (
  SELECT s.* FROM sums s JOIN due d USING (kind, hour) WHERE s.batch > d.due
), records AS (
  SELECT batch, hour, click_id, 1 AS n_rows, cents, 'late' AS record, kind FROM marked WHERE late
  UNION ALL SELECT batch, hour, -1, n_rows, cents, record, kind FROM shown
  UNION ALL SELECT batch, hour, -1, n_rows - n, total - c, 'retract', kind FROM revised
  UNION ALL SELECT batch, hour, -1, n_rows, total, 'replace', kind FROM revised
)
SELECT batch::BIGINT AS batch, hour::BIGINT AS hour, click_id::BIGINT AS click_id, n_rows::BIGINT AS n_rows, cents::BIGINT AS cents, record, kind FROM records"""
