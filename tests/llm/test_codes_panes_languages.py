"""Vector codes, window panes and languages: plain versions, odd rows, held-out accuracy."""

import glob
import hashlib
import os
import zlib
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest

from quillspark.llm import codes, languages, panes, registry

DIR = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_window_panes"])
def test_query_equals_its_sql(spark, con, name):
    df = registry.queries()[name](spark, DIR)
    want = con.execute(registry.oracle_sql()[name])
    at = [d[0] for d in want.description]
    assert sorted(at) == sorted(df.columns)
    got = rows_of(df.select(*at))
    assert got == sorted(want.fetchall(), key=repr) and got


# vector codes


def plain_codes(rows, rounds=codes.ROUNDS):
    """op11 by plain comparison in Python's own integers."""
    good = [(i, [int(np.floor(codes.SCALE * x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(good[0][1]) // codes.PARTS
    cut = lambda v, p: v[p * w : p * w + w]
    seen, books = set(), [[] for _ in range(codes.PARTS)]
    for i, v, _ in good:
        if i not in seen and len(seen) < codes.ENTRIES:
            seen.add(i)
            for p in range(codes.PARTS):
                books[p].append(cut(v, p))
    nearest = lambda q, book: min((sum((a - b) ** 2 for a, b in zip(q, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            taken = {}
            for _, v, _ in good:
                taken.setdefault(nearest(cut(v, p), book)[1], []).append(cut(v, p))
            for k, own in taken.items():
                book[k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [[nearest(cut(v, p), books[p]) for p in range(codes.PARTS)] for _, v, _ in good]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, label), e in zip(good, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, by_label[label], sha) for (i, _, label), f, e in zip(good, found, errors, strict=True)), key=repr)


def test_codes_of_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    some = [[float(x) for x in rng.normal(0, 0.01, 8)] for _ in range(300)]
    rows = [(i, some[i % 300] if i % 7 else some[0], None if i % 5 == 0 else i % 3) for i in range(420)]  # ties, copies, null labels
    rows += [(3, some[5], 1), (3, some[5], 1), (None, some[6], 1), (900, [0.5] * 8, 2), (901, [-250.0, 250.0] * 4, 2)]
    broken = [(-5, None, 1), (-4, [None] + [0.1] * 7, 1), (-3, [float("nan")] * 8, 1), (-2, [float("inf")] + [0.0] * 7, None)]
    kind = "vec_id long, embedding array<float>, label int, code string, x int"
    df = spark.createDataFrame([(*r, "mine", 1) for r in rows + broken], kind)  # clashing names
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    as_float = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert rows_of(codes.query(spark, str(tmp_path))) == plain_codes(as_float)
    df.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    assert codes.query(spark, str(tmp_path)).collect() == []


def test_codes_of_other_widths(spark):
    table = codes.integers(spark.createDataFrame([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1), (0, [1.0] * 3, 1), (3, [], 2)], "vec_id long, embedding array<double>, label int"))
    books = codes.fit(table)
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in codes.with_label_errors(codes.encode(table, books)).collect()}
    assert books.width == 4 and got == {0: (None, None, 0), 1: ("00000000", 0, 0), 2: (None, None, 0), 3: (None, None, 0)}
    assert codes.decode(codes.encode(table, books), books).where("vec_id = 1").first().vector == [1024.5 / 1024] * 4


@pytest.mark.parametrize("spread", [1, 3, 400, 2**27])
def test_tree_finds_the_nearest(spread):
    rng = np.random.default_rng(spread)
    e, q = (rng.integers(-spread, spread + 1, (n, 5)) for n in (256, 2000))
    number, distance = codes.Tree(e).nearest(q)
    d = ((q[:, None, :] - e[None, :, :]) ** 2).sum(axis=2)
    assert (number == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()


def test_tree_leaves_out_what_cannot_be_nearer():
    centres = np.repeat(np.arange(32) * 10_000, 8)[:, None] + np.random.default_rng(0).integers(0, 9, (256, 4))
    tree, seen = codes.Tree(centres), []
    verify = tree._verify
    tree._verify = lambda node, rows: seen.append(len(rows) * len(node.entries)) or verify(node, rows)
    tree.nearest(centres)
    assert sum(seen) < 256 * 256 / 3


# window panes


def plain_panes(clicks, batches=panes.BATCHES):
    """op12 as a loop over batches."""
    us = lambda t: (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    once = {}
    for c in clicks:
        if c.ts is not None:
            once.setdefault(c.click_id, c)
    dealt = [[] for _ in range(batches)]
    for i, c in once.items():
        d = us(c.arrived_at if c.arrived_at is not None else c.ts) // panes.DAY_US
        q = d % batches
        ev = us(c.ts) - (d - q) * panes.DAY_US
        cents = int(np.floor(100 * c.value + 0.5)) if c.value is not None and np.isfinite(c.value) else 0
        dealt[min(batches - 1, q + max(0, zlib.crc32(b"" if i is None else str(i).encode()) % 30 - 23))].append((i, c.kind or "none", ev, cents))
    out, open_panes, shown, w = [], {}, {}, None
    for b, rows in enumerate(dealt):
        reached = lambda hour, more, w=w: w is not None and w >= (hour + 1 + more) * panes.HOUR_US
        fresh = set()
        for i, kind, ev, cents in rows:
            key = (kind, ev // panes.HOUR_US)
            if reached(key[1], panes.CLOSED_HOURS):
                out.append((b, key[1], i, 1, cents, "late", kind))
            else:
                n, c = open_panes.get(key, (0, 0))
                open_panes[key] = (n + 1, c + cents)
                fresh.add(key)
        for key, total in list(open_panes.items()):
            if key in shown and key in fresh:
                out.extend([(b, key[1], -1, *shown[key], "retract", key[0]), (b, key[1], -1, *total, "replace", key[0])])
                shown[key] = total
            elif key not in shown and reached(key[1], panes.DUE_HOURS):
                out.append((b, key[1], -1, *total, "emit", key[0]))
                shown[key] = total
            elif key not in shown and b == batches - 1:
                out.append((b, key[1], -1, *total, "final", key[0]))
            if reached(key[1], panes.CLOSED_HOURS):
                del open_panes[key]
        w = max([ev for _, _, ev, _ in rows] + ([] if w is None else [w]), default=None)
    return sorted(out, key=repr)


CLICK = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, kind string, value double"


def test_panes_with_an_empty_batch(spark):
    """Batches 3 and 5 are empty; what is due meanwhile is published by them all the same."""
    base, rows = datetime(2024, 1, 1), []
    first = (base - datetime(1970, 1, 1)).days
    base -= timedelta(days=first % panes.BATCHES)
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 30 <= 23]
    for n, i in enumerate(ids[:600]):
        day = [0, 1, 2, 4, 6][n % 5]
        at = base + timedelta(days=day, hours=n % 24, seconds=n)
        rows.append((i, at - timedelta(hours=[0, 5, 20, 40, 70, 200][n % 6]), at, [None, "a", "b"][n % 3], [1.005, None, -2.5, float("nan")][n % 4]))
    rows += [rows[0], rows[0], (None, base, base, "a", 1.0), (None, base, base, "a", 1.0), (ids[700], None, base, "a", 1.0), (ids[701], base, None, "a", 0.125)]
    rows.append((ids[702], datetime(1, 1, 3), base, "a", 3.0))
    df = spark.createDataFrame(rows, CLICK).repartition(3)
    got = rows_of(panes.revisions(df.withColumn("batch", df.click_id).withColumn("record", df.kind)))
    assert got == plain_panes(df.collect())
    assert {r[5] for r in got} == {"late", "emit", "retract", "replace", "final"} and {r[0] for r in got} >= {3, 5}


def test_panes_of_nothing(spark):
    assert panes.revisions(spark.createDataFrame([], CLICK)).collect() == []


def test_panes_of_the_whole_table(spark):
    clicks = spark.read.parquet(f"{DIR}/clicks.parquet")
    assert rows_of(panes.query(spark, DIR)) == plain_panes(clicks.collect())


# languages


def plain_pooled(net, raw):
    """Mean probabilities of one text by steps of one byte."""
    k, out, labels = net.u.shape[2], np.zeros(len(net.langs)), []
    for at in range(0, len(raw), languages.WINDOW):
        win, states = raw[at : at + languages.WINDOW], []
        for d, order in ((0, range(len(win))), (1, reversed(range(len(win))))):
            h, own = np.zeros(k), {}
            for t in order:
                a, g = net.e[d][:, win[t]], net.u[d] @ h
                z, r = np.clip((a + g)[:k], 0, 1), np.clip((a + g)[k : 2 * k], 0, 1)
                c = np.tanh(a[2 * k :] + r * g[2 * k :])
                h = own[t] = c + z * (h - c)
            states.append(own)
        for t in range(len(win)):
            p = np.exp(net.v[0] @ states[0][t] + net.v[1] @ states[1][t] + net.bias)
            out += p / p.sum()
            labels.append(int(p.argmax()))
    return out / max(1, len(raw)), labels


def test_network_equals_plain_steps(monkeypatch):
    monkeypatch.setattr(languages, "BLOCK", 5)
    net = languages.Network.fresh(["a", "b", "c"])
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 63, 64, 65, 700, 0, 130, 5)]
    at = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    labels = np.zeros(len(data), np.int16)
    got = languages.pooled(net, data, at, labels)
    for i, raw in enumerate(texts):
        want, own = plain_pooled(net, raw)
        assert got[i] == pytest.approx(want, abs=1e-5) and labels[at[i] : at[i + 1]].tolist() == own


def test_gradient():
    """Backpropagation through time against differences of the loss."""
    net = languages.Network.fresh(["a", "b", "c"], hidden=4)
    net.e, net.u, net.v, net.bias = (w.astype(np.float64) for w in net.weights())
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 256, (9, 6)), rng.integers(0, 3, 6)
    _, grads = languages.gradients(net, x, y)
    for w, g in zip(net.weights(), grads, strict=True):
        for i in [np.unravel_index(j, w.shape) for j in np.argsort(-np.abs(g), axis=None)[:: max(1, w.size // 25)][:25]]:
            kept, ends = w[i], []
            for step in (1e-5, -1e-5):
                w[i] = kept + step
                ends.append(languages.gradients(net, x, y)[0])
            w[i] = kept
            assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(g[i], abs=1e-6)


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = languages.fit(docs)
    rows = languages.predict(docs, net).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    tested = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in tested]) > 0.97
    again = languages.fit(docs.repartition(5))
    assert all((a == b).all() for a, b in zip(net.weights(), again.weights(), strict=True))


def test_languages_of_odd_rows(spark):
    en, de = "the water and the thing that they were having ", "über die straße und der schöne große baum "
    rows = [(i, (en, de)[i % 2] * (1 + i % 5), ("en", "de")[i % 2]) for i in range(200)]
    odd = [(500, None, "en"), (501, "", "en"), (502, "12 :-) 34", None), (None, en, None), (503, de * 3000, None), (503, de * 3000, None), (504, "é", None)]
    kind = "doc_id long, text string, lang string, score double, held_out string"
    df = spark.createDataFrame([(*r, 9.0, "x") for r in rows + odd], kind)
    net = languages.fit(df, steps=120)
    got = [(r.doc_id, r.lang_pred, r.score) for r in languages.predict(df, net).collect()]
    by = {i: (lang, s) for i, lang, s in got}
    assert len(got) == len(rows) + len(odd) and by[500] == by[501] == by[502] == ("und", 0.0)
    assert by[503][0] == "de" and by[None][0] == "en" and by[504][0] in ("en", "de")
    mixed = spark.createDataFrame([(1, en * 4 + de * 4)], "doc_id long, text string")
    found = languages.spans(mixed, net).first().spans
    raw = len((en * 4 + de * 4).encode())
    assert found[0].start == 0 and found[-1].end == raw and all(a.end == b.start and a.lang != b.lang for a, b in zip(found, found[1:], strict=False))
    assert sum(s.end - s.start for s in found if s.lang == "de" and s.start >= len(en) * 4) > 0.8 * len((de * 4).encode())
    empty = df.limit(0)
    none = languages.fit(empty)
    assert none.langs == [] and languages.predict(empty, none).collect() == [] and {r.lang_pred for r in languages.predict(df, none).collect()} == {"und"}
    one = languages.fit(df.where("lang = 'de'"))
    assert {(r.lang_pred, r.score) for r in languages.predict(df.where("doc_id = 503"), one).collect()} == {("de", 1.0)}
