"""Pages that change: state per page of the elements it holds, so that what goes is forgotten and what is new is scored.

Input rows say of a page at ``seq`` that it holds an element (element_id, kind, text, fingerprint); a row with a null
element_id says that a whole snapshot was taken. An element is scored if its fingerprint is not the one that was last
scored. Elements that a later whole snapshot lacks are forgotten (``removed``), and scored again if they
come back. Rows without a snapshot row at their ``seq`` are edits: they add or change elements and remove none.

Settings have a version. What was scored under an older version counts as unscored: the first rows of a page under the
new version are scored in full, and ``rescan`` feeds all elements that are there, so that pages which do not
change are scored again as well, on the checkpoint that there is.

A page's rows of one micro-batch are put in order together; the batch's size bounds them. State is one value for
each page in RocksDB (its elements' fingerprints, no texts), read once and written once for a page's rows of a micro-batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import groupby

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from quillspark.functions import text as tx
from quillspark.operators.analyze import analyze
from quillspark.sources import html

COLUMNS = ["page_id", "element_id", "seq", "version", "change", "platform", "kind", "text", "fingerprint"]
_OUT = Row(*COLUMNS)
ROWS = "page_id string, seq long, version long, element_id string, platform string, kind string, text string, fingerprint string"
OUT = "page_id string, element_id string, seq long, version long, change string, platform string, kind string, text string, fingerprint string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Page(StatefulProcessor):
    """What one page holds: element_id to the fingerprint that was scored last; and the last (seq, version) seen."""

    def __init__(self, forget_ms: int = 0):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.page = handle.getValueState("page", "seq long, version long, known string")

    def _held(self) -> tuple[int, int, dict[str, tuple]]:
        held = self.page.get()
        return (-(2**62), -(2**62), {}) if held is None else (held[0], held[1], {k: tuple(v) for k, v in json.loads(held[2]).items()})

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        heard = sorted((r for r in rows if r.seq is not None and r.version is not None), key=lambda r: (r.seq, r.version, r.element_id is None, r.element_id or ""))
        seq, version, now = self._held()
        out = []
        for (at, under), own in groupby(heard, key=lambda r: (r.seq, r.version)):
            if under < version or (under == version and at <= seq):
                continue  # heard of already, or of settings that are gone
            if under > version:
                now = {k: ("", *v[1:]) for k, v in now.items()}
            seq, version = max(seq, at), under
            held, whole = {}, False
            for r in own:
                whole |= r.element_id is None
                if r.element_id is not None and r.text:
                    held.setdefault(r.element_id, r)
            for name, r in held.items():
                if name not in now or now[name][0] != r.fingerprint:
                    out.append((key[0], name, seq, version, "scored", r.platform, r.kind, r.text, r.fingerprint))
                now[name] = (r.fingerprint, r.platform, r.kind)
            if whole:
                for name in sorted(now.keys() - held.keys()):
                    out.append((key[0], name, seq, version, "removed", *now.pop(name)[1:], None, None))
        self.page.update((seq, version, json.dumps(now)))
        if self.forget_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.forget_ms)
        yield from (_OUT(*x) for x in out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        seq, version, known = self._held()
        self.page.clear()
        yield from (_OUT(key[0], k, seq, version, "removed", v[1], v[2], None, None) for k, v in known.items())


def fingerprinted(elements: DataFrame, version: Column | int = 0) -> DataFrame:
    """Rows as ``changes`` takes them, of (page_id, seq, element_id, platform, kind, text)."""
    kind = F.coalesce(F.col("kind"), F.lit("post"))
    return elements.select(
        F.col("page_id").cast("string").alias("page_id"), F.col("seq").cast("long").alias("seq"), (F.lit(version) if isinstance(version, int) else version).cast("long").alias("version"),
        F.col("element_id").cast("string").alias("element_id"), "platform", "kind", "text", tx.fingerprint(kind, F.coalesce("text", F.lit(""))).alias("fingerprint"))


def changes(rows: DataFrame, forget: int = 0) -> DataFrame:
    """What is to be scored, and what went, of a stream of ``fingerprinted`` rows.

    A page not heard of for ``forget`` seconds loses all its elements; 0 keeps them. Streams that forget by the clock
    do not end by themselves.
    """
    return rows.groupBy("page_id").transformWithState(Page(forget * 1000), OUT, "Update", "ProcessingTime" if forget else "None")


def watch(snapshots: DataFrame, platform: str, comments: bool = True, version: int = 0, forget: int = 0) -> DataFrame:
    """``changes`` of a stream of page snapshots (page_id, seq, html): elements are found and followed in one plan."""
    return changes(fingerprinted(html.snapshot_elements(snapshots, platform, comments), version), forget)


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """Streams started here keep their state in RocksDB, which ``changes`` and the bursts of ``quiet`` need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def follow(rows: DataFrame, live: Live, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None, bundle: dict | None = None, sensitivity: str = "balanced", every: str = "180 milliseconds", once: bool = False) -> StreamingQuery:
    """Analyse what ``changes`` says is to be scored, and keep the latest analysis of each element that is there in ``live``.

    ``sink`` gets each micro-batch's changes with their analyses (null for what went). ``live`` is a ``Live`` of the columns
    of OUT and ``analysis``, as ``analysed`` gives them. ``once`` takes what is there and ends.
    """

    def batch(df: DataFrame, number: int) -> None:
        rows = analysed(df.persist(), bundle, sensitivity).persist()
        try:
            if sink:
                sink(rows, number)
            live.merge(rows, number)
        finally:
            rows.unpersist()
            df.unpersist()

    with stateful(rows.sparkSession):
        writer = rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(batch)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def analysed(changed: DataFrame, bundle: dict | None = None, sensitivity: str = "balanced") -> DataFrame:
    """Rows of ``changes`` with ``analysis``, a struct of the whole analysis of what is to be scored."""
    keyed = changed.withColumn("row", F.concat_ws(":", "page_id", "element_id", "version", "seq"))
    done = analyze(keyed.where("change = 'scored'"), "row", bundle, sensitivity)
    return keyed.join(done.select("row", F.struct(*(c for c in done.columns if c != "row")).alias("analysis")), "row", "left").select(*COLUMNS, "analysis")


class Live:
    """The elements that are there, with whatever columns their rows bring (such as their latest analysis).

    One version of the table is written for each micro-batch, from the version before and the batch's changes; a batch that
    runs again writes the same. Versions before the last two are deleted.
    """

    KEY = ["page_id", "element_id"]

    def __init__(self, spark: SparkSession, root: str, schema: str | StructType):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def _path(self, batch: int) -> str:
        return f"{self.root}/batch={batch}"

    def _versions(self) -> list[int]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/batch=*/_SUCCESS")
        found = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(hadoop)
        return sorted(int(x.getPath().getParent().getName()[6:]) for x in found or [])

    def read(self, before: int | None = None) -> DataFrame:
        """The newest version, or the newest one before a batch."""
        known = [v for v in self._versions() if before is None or v < before]
        return self.spark.read.schema(self.schema).parquet(self._path(known[-1])) if known else self.spark.createDataFrame([], self.schema)

    def merge(self, changed: DataFrame, batch: int) -> None:
        """Take in the rows of ``changes`` (with more columns or fewer): the last of each element counts."""
        rows = changed.groupBy(*self.KEY).agg(F.max_by(F.struct("*"), F.struct("version", "seq")).alias("r"))
        old = self.read(batch).join(rows, self.KEY, "left_anti")
        new = rows.where("r.change <> 'removed'").select(*(F.col(f"r.{c}").alias(c) for c in old.columns))
        old.unionByName(new).write.mode("overwrite").parquet(self._path(batch))
        for v in [v for v in self._versions() if v < batch][:-1]:
            hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(v))
            hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def rescan(live: DataFrame, inbox: str, version: int) -> None:
    """Put all elements that are there into the folder that a stream of ``ROWS`` is read from, as rows of new settings.

    They are no snapshot: they remove nothing, and any snapshot is later than they are.
    """
    fingerprinted(live.withColumn("seq", F.lit(-1)), version).write.mode("append").parquet(inbox)


def watch_with_rescans(rows: DataFrame, inbox: str, forget: int = 0) -> DataFrame:
    """``changes`` of a stream of ``fingerprinted`` rows and of what ``rescan`` puts into the folder ``inbox``, which exists."""
    return changes(rows.unionByName(rows.sparkSession.readStream.schema(ROWS).parquet(inbox)), forget)
