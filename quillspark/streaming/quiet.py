"""Bursts of events: one row for each once it is over.

``settled`` waits for a quiet period: each event pushes its key's timer back, and when the timer fires the key's last state
is emitted. ``scans`` looks at fixed delays, as a page's own rescan does: the first event after a scan sets the
timer, events until then join in, and the scan sees the last of them.

Time is the events' own (event-time timers, watermark ``late``), so results do not depend on how a stream is cut into
micro-batches; a timer fires once the watermark has passed it. An event that comes late joins the burst that is open, and one
older than the watermark is left out. Of events of one key at the same time the greatest
state is the last. A key's events of one micro-batch are put in order together; state is one row for each key with
an open burst.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

COLUMNS = ["key", "first_us", "last_us", "n", "state"]
_OUT = Row(*COLUMNS)
OUT = "key string, first_us long, last_us long, n long, state string"


class Burst(StatefulProcessor):
    """The open burst of a key: times of its first and last event, their number, the last state."""

    def __init__(self, period_us: int, pushed_back: bool):
        self.period_us, self.pushed_back = period_us, pushed_back

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first_us long, last_us long, n long, state string")

    def _end(self, burst: tuple) -> int:
        return burst[1 if self.pushed_back else 0] + self.period_us

    def _timer(self, burst: tuple) -> int:
        """When the timer of a burst fires, in milliseconds; it follows from the burst, so no timers need be listed."""
        return -(-self._end(burst) // 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        events = sorted(((r.at_us, r.state) for r in rows), key=lambda e: (e[0], e[1] is not None, e[1] or ""))
        held = self.open.get()
        before = burst = None if held is None else tuple(held)
        done = []
        for at, state in events:
            if burst is not None and at >= self._end(burst):
                done.append((key[0], *burst))
                burst = None
            if burst is None:
                burst = (at, at, 1, state)
            else:
                burst = (min(burst[0], at), max(burst[1], at), burst[2] + 1, state if at >= burst[1] else burst[3])
        self.open.update(burst)
        if before is None or self._timer(before) != self._timer(burst):
            if before is not None:
                self.handle.deleteTimer(self._timer(before))
            self.handle.registerTimer(self._timer(burst))
        yield from (_OUT(*x) for x in done)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        burst = tuple(self.open.get())
        self.open.clear()
        yield _OUT(key[0], *burst)


def _bursts(events: DataFrame, period: float, late: str, pushed_back: bool) -> DataFrame:
    # the filter names the time, else Spark would move it below the watermark, which rows without a key are to move
    timed = events.withWatermark("at", late).where(F.col("key").isNotNull() | (F.col("at") < F.timestamp_micros(F.lit(-(2**60)))))
    rows = timed.select(F.col("key").cast("string").alias("key"), "at", F.unix_micros("at").alias("at_us"), F.col("state").cast("string").alias("state"))
    return rows.groupBy("key").transformWithState(Burst(round(period * 1_000_000), pushed_back), OUT, "Append", "EventTime")


def settled(events: DataFrame, period: float, late: str = "0 seconds") -> DataFrame:
    """One row for each run of a key's events (key, at, state) whose gaps are below ``period`` seconds.

    Rows of a null key move the watermark on and nothing else.
    """
    return _bursts(events, period, late, True)


def scans(events: DataFrame, period: float, late: str = "0 seconds") -> DataFrame:
    """One row for each scan: ``period`` seconds after the first event that no scan has seen."""
    return _bursts(events, period, late, False)
