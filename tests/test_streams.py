"""Page snapshots, elements that go and come back, quiet periods, settings that change."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspark.plans import flows
from quillspark.sources import html as html_source
from quillspark.sources import snapshots
from quillspark.streaming import pages, quiet


def page(*texts):
    return "<main>" + "".join(f'<article role="article" id="{i}"><div data-testid="tweetText">{t}</div></article>' for i, t in texts) + "</main>"


def end(stream):
    stream.trigger(availableNow=True).start().awaitTermination(180)


@pytest.fixture
def watched(spark, tmp_path):
    """A log of snapshots, and a function that runs the stream on a checkpoint and gives what it made of the new rounds."""
    log, got = str(tmp_path / "log"), []

    def run(version=0, sink=None):
        got.clear()

        def take(df, n):
            df = df.persist()
            got.extend((r.page_id, r.element_id, r.seq, r.version, r.change, r.text) for r in df.collect())
            if sink:
                sink(df, n)

        with pages.stateful(spark):
            end(pages.watch(snapshots.read_stream(spark, log), "x", version=version).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(take))
        return sorted(got, key=str)

    def add(seq, *rows):
        snapshots.append(spark.createDataFrame(list(rows), "page_id string, html string"), log, seq)

    return log, add, run


def test_removed_elements_are_scored_again(watched):
    log, add, run = watched
    add(0, ("p", page(("a", "one"), ("b", "two"))), ("q", None))
    add(1, ("p", page(("b", "two"))))
    assert run() == [("p", "a", 0, 0, "scored", "one"), ("p", "a", 1, 0, "removed", None), ("p", "b", 0, 0, "scored", "two")]
    add(2, ("p", page(("a", "one"), ("b", "two!"))), ("q", page(("c", "new"))))
    assert run() == [("p", "a", 2, 0, "scored", "one"), ("p", "b", 2, 0, "scored", "two!"), ("q", "c", 2, 0, "scored", "new")]
    add(3, ("p", page(("a", "one"), ("b", "two!"))), ("q", ""))
    assert run() == [("q", "c", 3, 0, "removed", None)]
    assert run() == []


def test_new_settings_score_everything_once(watched):
    log, add, run = watched
    add(0, ("p", page(("a", "one"), ("b", "two"))))
    assert len(run(1)) == 2
    add(1, ("p", page(("a", "one"), ("b", "three"))))
    assert [(r[1], r[3], r[5]) for r in run(2)] == [("a", 2, "one"), ("b", 2, "three")]
    add(2, ("p", page(("a", "one"), ("b", "three"))))
    assert run(2) == []


def test_unfinished_rounds_wait(spark, tmp_path):
    log = tmp_path / "log"
    snapshots.append(spark.createDataFrame([("p", "x")], "page_id string, html string"), str(log), 7)
    snapshots.append(spark.createDataFrame([("p", "y")], "page_id string, html string"), str(log), 8)
    os.remove(log / "seq=8/_SUCCESS")
    assert [tuple(r) for r in snapshots.read(spark, str(log)).collect()] == [("p", 7, "x")]
    assert snapshots.read(spark, str(tmp_path / "none")).collect() == []
    with pytest.raises(Exception, match="path of a log"):
        spark.read.format(snapshots.NAME).load().collect()


def test_live_elements(spark, tmp_path):
    live = pages.Live(spark, str(tmp_path / "live"), pages.OUT)
    row = lambda e, seq, change, text: ("p", e, seq, 0, change, "x", "post", text, text)
    frame = lambda *rows: spark.createDataFrame(list(rows), pages.OUT)
    texts = lambda: {(r.element_id, r.text) for r in live.read().collect()}
    assert texts() == set()
    live.merge(frame(row("a", 0, "scored", "1"), row("b", 0, "scored", "1"), row("a", 1, "scored", "2")), 0)
    assert texts() == {("a", "2"), ("b", "1")}
    for _ in range(2):  # a batch that runs again
        live.merge(frame(row("b", 2, "removed", None), row("c", 2, "scored", "3"), row("c", 3, "removed", None)), 1)
    assert texts() == {("a", "2")}
    live.merge(frame(row("b", 4, "scored", "4")), 2)
    assert texts() == {("a", "2"), ("b", "4")}
    pages.rescan(live.read(), str(tmp_path / "inbox"), 5)
    got = spark.read.schema(pages.ROWS).parquet(str(tmp_path / "inbox")).collect()
    assert {(r.element_id, r.version, r.seq) for r in got} == {("a", 5, -1), ("b", 5, -1)}


def test_latest_analysis_of_each_element(spark, tmp_path):
    """What is asked of a live element: its newest analysis, and none once it went."""
    log, got = str(tmp_path / "log"), []
    schema = pages.analysed(spark.createDataFrame([], pages.OUT)).schema
    live = pages.Live(spark, str(tmp_path / "live"), schema)
    for seq, html in enumerate([page(("a", "Leverage a robust plan, moreover."), ("b", "I went home.")), page(("a", "We went home, and it was late."))]):
        snapshots.append(spark.createDataFrame([("p", html)], "page_id string, html string"), log, seq)
        stream = pages.changes(pages.fingerprinted(html_source.snapshot_elements(snapshots.read_stream(spark, log), "x")))
        pages.follow(stream, live, str(tmp_path / "ck"), lambda df, n: got.extend((r.element_id, r.change, r.analysis is not None) for r in df.collect()), once=True).awaitTermination(180)
    assert sorted(got) == [("a", "scored", True), ("a", "scored", True), ("b", "removed", False), ("b", "scored", True)]
    rows = live.read().collect()
    assert [(r.element_id, r.seq, r.text) for r in rows] == [("a", 1, "We went home, and it was late.")]
    assert rows[0].analysis.metrics.wordCount == 7 and 0 <= rows[0].analysis.signal <= 1


def plain_bursts(events, period, pushed_back):
    out, at = [], {}
    for key, t, state in sorted(events, key=lambda e: (e[1], e[2])):
        if key is None:
            continue
        if key in at and t >= at[key][1 if pushed_back else 0] + period:
            out.append((key, *at.pop(key)))
        at[key] = (at[key][0], t, at[key][2] + 1, state) if key in at else (t, t, 1, state)
    return sorted([*out, *((k, *v) for k, v in at.items())])


@pytest.mark.parametrize("pushed_back", [True, False])
def test_bursts(spark, tmp_path, pushed_back):
    """The same rows whichever way the stream is cut."""
    start, events = datetime(2024, 1, 1), []
    for i in range(60):
        events.append((("a", "b", None)[i % 3], start + timedelta(seconds=(i * i * 7) % 400), f"s{i % 5}"))
    events.sort(key=lambda e: e[1])
    want = [(k, a.timestamp(), b.timestamp(), n, s) for k, a, b, n, s in plain_bursts(events, timedelta(seconds=15), pushed_back)]
    last = max(e[1] for e in events) + timedelta(days=1)
    for cut in ([60], [7, 30, 41, 60]):
        source, got = str(tmp_path / f"in{len(cut)}"), []
        edges = [0, *[next((j for j in range(c, 60) if events[j][1] != events[j - 1][1]), 60) for c in cut]]
        parts = [events[a:b] for a, b in zip(edges, edges[1:], strict=False)] + [[(None, last, None)]] * 2
        for part in parts:
            spark.createDataFrame(part, "key string, at timestamp, state string").coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema("key string, at timestamp, state string").parquet(source)
            made = (quiet.settled if pushed_back else quiet.scans)(stream, 15)
            with pages.stateful(spark):
                end(made.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / f"ck{len(cut)}")).foreachBatch(lambda df, n, got=got: got.extend(df.collect())))
        local = lambda us: us / 1e6
        found = sorted((r.key, local(r.first_us), local(r.last_us), r.n, r.state) for r in got)
        assert [(f[0], f[2] - f[1], f[3], f[4]) for f in found] == [(w[0], w[2] - w[1], w[3], w[4]) for w in want]


def test_fingerprints_of_elements(spark):
    rows = spark.createDataFrame([("p", 1, "e", "x", None, None)], "page_id string, seq int, element_id string, platform string, kind string, text string")
    r = pages.fingerprinted(rows, F.lit(3)).first()
    assert (r.version, r.fingerprint) == (3, pages.fingerprinted(rows.withColumn("kind", F.lit("post")).withColumn("text", F.lit("")), 3).first().fingerprint)


def test_changes_of_a_table_in_many_files(spark, tmp_path):
    """Later events in an earlier file of the table: each quarter's files are taken together, so none is late."""
    day = datetime(2024, 1, 1)
    rows = [(i, day + timedelta(hours=i), 1, "ABBA"[i % 4], 0.0, "") for i in range(40)]
    for part in (rows[1::2], rows[::2]):
        spark.createDataFrame(part, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    got = {r.text: r.scored for r in flows.stream_changes(spark, str(tmp_path)).collect()}
    assert got == {"A": 11, "B": 10}
