"""Elements that change: each is scored again only when its kind or text does.

State is kept per element: the fingerprint of what was last scored, and the last sequence number. A text
that goes from A to B and back to A is scored three times; repeats in between are not. Within a
micro-batch the sequence column decides the order. Elements not heard of for ``forget`` are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from quillspark.functions import text as tx
from quillspark.operators.analyze import analyze

OUT = "element_id string, seq long, platform string, kind string, text string, fingerprint string"


def fingerprint(kind: str | None, text: str | None) -> str:
    """``tx.fingerprint`` of one text outside of Spark: FNV-1a over the UTF-16 units of kind, newline and text, in base 36."""
    h, out = 2166136261, ""
    for unit in memoryview(f"{kind}\n{text}".encode("utf-16-le", "surrogatepass")).cast("H"):
        h = ((h ^ unit) * 16777619) & 0xFFFFFFFF
    while h:
        h, d = divmod(h, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
    return out or "0"


def _rows(elements: DataFrame) -> DataFrame:
    """What is kept of elements, with the fingerprint of kind and text; elements without a text are none."""
    own = elements.select(F.col("element_id").cast("string").alias("element_id"), F.col("seq").cast("long").alias("seq"), "platform", "kind", "text").where("text <> ''")
    return own.withColumn("fingerprint", tx.fingerprint(F.coalesce("kind", F.lit("None")), F.col("text")))


def _collapse(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, forget_ms: int, latest: bool) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
    last, seq = state.get if state.exists else ("", -(2**62))
    out = []
    if latest:
        rows = rows.tail(1)
    for r in rows.itertuples(index=False):
        if r.seq <= seq:
            continue
        if r.fingerprint != last:
            out.append((key[0], r.seq, r.platform, r.kind, r.text, r.fingerprint))
        last, seq = r.fingerprint, r.seq
    state.update((last, seq))
    if forget_ms:
        state.setTimeoutDuration(forget_ms)
    if out:
        yield pd.DataFrame(out, columns=["element_id", "seq", "platform", "kind", "text", "fingerprint"])


def changes(elements: DataFrame, forget: int = 24 * 3600, latest: bool = False) -> DataFrame:
    """Those rows of a stream (element_id, seq, platform, kind, text) that are to be scored.

    ``latest``: of a micro-batch only each element's last state counts, so a burst of edits is scored once.
    """
    rows = _rows(elements)
    timeout = GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout

    def step(key, frames, state):
        yield from _collapse(key, frames, state, forget * 1000, latest)

    return rows.groupBy("element_id").applyInPandasWithState(step, OUT, "fingerprint string, seq long", "update", timeout)


#: Spans of the sequence numbers in which a replay looks for the state before.
SPANS = 256


def replay(elements: DataFrame) -> DataFrame:
    """What ``changes`` gives for a table that holds each element's whole history.

    The fingerprint before is looked up in two levels, within a span of sequence numbers and then in the last span that the
    element has any in, so that the history of one element is not one task's. Of rows with one number the smallest counts.
    """
    rows = _rows(elements).where("seq is not null").groupBy("element_id", "seq").agg(F.min(F.struct("platform", "kind", "text", "fingerprint")).alias("r")).select("element_id", "seq", "r.*")
    lo, hi = elements.agg(F.coalesce(F.min("seq"), F.lit(0)).cast("long"), F.coalesce(F.max("seq"), F.lit(0)).cast("long")).first()
    rows = rows.withColumn("span", F.expr(f"(seq - {lo}) div {(hi - lo) // SPANS + 1}"))
    last = rows.groupBy("element_id", "span").agg(F.max_by("fingerprint", "seq").alias("last"))
    before = last.select("element_id", "span", F.lag("last").over(Window.partitionBy("element_id").orderBy("span")).alias("before"))
    own = F.lag("fingerprint").over(Window.partitionBy("element_id", "span").orderBy("seq"))
    found = rows.withColumn("own", own).join(before, ["element_id", "span"])
    return found.where(~F.coalesce("own", "before").eqNullSafe(F.col("fingerprint"))).select("element_id", "seq", "platform", "kind", "text", "fingerprint")


def rescore(elements: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, bundle: dict | None = None, sensitivity: str = "balanced", every: str = "180 milliseconds", once: bool = False, **options):
    """Run the whole analysis on what changes, micro-batch by micro-batch; ``sink`` gets each batch's analyses.

    A change of settings needs a new ``checkpoint``: everything is then scored anew. ``once`` takes what is there and
    ends; elements are not forgotten then, since a stream that waits for their time to run out does not end.
    """
    if once:
        options = {"forget": 0} | options

    def batch(df: DataFrame, number: int) -> None:
        rows = df.withColumn("row", F.concat_ws(":", "element_id", F.col("seq").cast("string"))).persist()
        try:
            done = analyze(rows, "row", bundle, sensitivity)
            sink(rows.select("row", "element_id", "seq", "fingerprint").join(done, "row").drop("row"), number)
        finally:
            rows.unpersist()

    writer = changes(elements, **options).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
