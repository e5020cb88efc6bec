import random

import numpy as np
import pytest

from quillspark.llm import edit_counts, pieces, token_records, toxicity


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(pieces.model_path())


def every(model, part):
    """All segmentations of a part, by brute force."""
    if not part:
        return [(0.0, [])]
    out = []
    for size in range(1, min(model.longest, len(part)) + 1):
        p = part[:size]
        s = model.score[model.ids[p]] if p in model.ids else model.fallback if size == 1 else None
        if s is not None:
            out += [(s + t, [*model._ids_of(p), *rest]) for t, rest in every(model, part[size:])]
    return out


@pytest.mark.parametrize("text", ["a", "Hello", " a b", "x  y", "né🙂", "the cat", "a\nb", "▁", "aaaa"])
def test_nbest_against_all_segmentations(model, text):
    got, want = model.nbest(text), sorted(every(model, model.normalize(text)), key=lambda x: -x[0])
    assert [s for s, _ in got] == [s for s, _ in want[: model.n]]
    for s, ids in got:
        assert (s, ids) in want
    assert len({tuple(i) for _, i in got}) == len(got)


def test_lockstep_equals_single_search(model):
    rng = random.Random(1)
    parts = ["▁" + "".join(rng.choice("abethinrs🙂éß.") for _ in range(rng.randint(1, 14))) for _ in range(300)] + ["▁", "▁▁▁▁", "▁▁▁word"]
    model.clear()
    model._learn(list(dict.fromkeys(parts)))
    for p in parts:
        c = model.codes[p]
        found = [(model.scores[c, k], model.flat[model.at[c, k] : model.at[c, k] + model.len[c, k]].tolist()) for k in range(model.n) if model.scores[c, k] > -np.inf]
        assert found == [(s, [i for x in how for i in model._ids_of(x)]) for s, how in model.search(p)]


def test_parts_give_the_whole_lattices_paths(model):
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice(["the", "x", "1", "23", ".", ",", "-", "\n", " ", "  ", "é", "²", "()", "'s", "🙂", "я", "_", "utf8"]) for _ in range(30))
        got = model.nbest(text)
        assert [s for s, _ in got] == [s for s, _ in model.search(model.normalize(text))]
        assert model.decode(np.array(got[0][1])) == text


def test_tied_and_long_parts(model):
    """Texts whose paths tie, and long parts, take time and memory in proportion to their length."""
    import tracemalloc

    peaks = []
    for n in (5_000, 20_000):
        tracemalloc.start()
        found = model.search("x" * n)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert len(found) == model.n and all("".join(p) == "x" * n for _, p in found)
        assert len({tuple(p) for _, p in found}) == model.n and [s for s, _ in found] == sorted((s for s, _ in found), reverse=True)
    assert peaks[1] < 6 * peaks[0] < 6 * 40_000_000
    ids, scores, _, _ = model.encode("x" * 20_000)
    assert model.decode(ids) == "x" * 20_000 and scores == [s for s, _ in model.search(model.normalize("x" * 20_000))]


@pytest.mark.parametrize("text", ["", " ", "Hello  world\n\ttabs ", "naïve ﬁ ½ 你好 🙂", "a" * 200, "x\x00y", "  lead"])
def test_round_trip(model, text):
    for _, ids in model.nbest(text):
        assert model.decode(np.array(ids, dtype=np.int64)) == text


def test_encode_decode_frames(spark):
    rows = [(1, "Hello world"), (2, None), (2, ""), (None, "né 🙂"), (5, "long " * 2000)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, ids int")
    enc = pieces.encode(docs, n=3)
    got = sorted(map(tuple, pieces.decode(enc).collect()), key=str)
    assert got == sorted([(i, t or "") for i, t in rows], key=str)
    assert all(len(r.nbest) <= 3 and r.nbest[0].ids == r.ids for r in enc.collect())
    assert all(r.round_trip for r in pieces.digest(docs).collect())
    for r in pieces.tokens(docs).collect():
        whole = [r.ids] + [[*r.ids[: c[0].start], *(x for k, y in enumerate(c) for x in [*y.ids, *r.ids[y.stop : c[k + 1].start if k + 1 < len(c) else None]])] for c in r.others]
        assert whole == [ids for _, ids in pieces.segmenter(pieces.model_path()).nbest(dict((i or 0, t) for i, t in rows[:2] + rows[3:]).get(r.doc_id or 0) or "")] or r.doc_id == 2
    assert pieces.digest(docs.limit(0)).count() == pieces.tokens(docs.limit(0)).count() == pieces.encode(docs.limit(0)).count() == 0


def test_edits_equal_full_count():
    encoder = token_records.Encoder(token_records.tokenizer_path())
    rng = random.Random(3)
    alphabet = ["a", "bc", " ", "  ", "\n", "é", "1", "!", "'s", "🙂", "　"]
    for leaf in (1, 8, 512):
        counter = edit_counts.Counter(encoder, leaf)
        for _ in range(60):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80)))
            root = counter.build(text)
            for _ in range(12):
                place, cut, ins = rng.randint(0, 90), rng.choice([0, 0, 1, 5, 40]), "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 3])))
                at = min(place, len(text))
                text = text[:at] + ins + text[at + cut :]
                root = counter.edit(root, place, cut, ins)
                assert "".join(x.text for x in counter.texts(root)) == text
                assert (root.tokens if root else 0) == len(encoder(text))


def test_edits_touch_little():
    counter = edit_counts.Counter(token_records.Encoder(token_records.tokenizer_path()))
    root = counter.build("some words here " * 10_000)
    counter.encoded = 0
    counter.edit(root, 80_000, 3, "new")
    assert counter.encoded < 3 * edit_counts.LEAF


def test_edit_frames(spark):
    docs = spark.createDataFrame([(1, "a b c", [(2, 1, "xx")]), (2, None, None), (3, "q", [(None, None, None), None])], "doc_id long, text string, edits array<struct<pos: long, del: long, ins: string>>")
    got = {r.doc_id: r for r in edit_counts.count(docs).collect()}
    assert got[2].n_tokens_edited == 0 and got[1].n_chars_edited == 6 and got[3].n_tokens == got[3].n_tokens_edited == 1
    assert edit_counts.count(docs.limit(0)).count() == 0


def test_gradient():
    rng = np.random.default_rng(0)
    row, col, grade = rng.integers(0, 30, 200), rng.integers(0, 7, 200), rng.integers(0, 3, 30)
    x = rng.normal(size=9)
    value, grad = toxicity._objective(x, row, col, grade, 7, 0.5)
    for i in range(9):
        e = np.zeros(9)
        e[i] = 1e-5
        up, down = (toxicity._objective(x + s * e, row, col, grade, 7, 0.5)[0] for s in (1, -1))
        assert abs((up - down) / 2e-5 - grad[i]) < 1e-4


def test_held_out_toxicity(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    train = labels.where("doc_id % 4 <> 0")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, train)).collect()}
    test = [(got[r.doc_id].toxic, r.toxic == 1) for r in labels.where("doc_id % 4 = 0").collect()]
    caught, wrong = sum(a and b for a, b in test) / sum(b for _, b in test), sum(a and not b for a, b in test) / sum(not b for _, b in test)
    print("caught", caught, "wrong", wrong)
    assert caught > 0.9 and wrong < 0.02


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, "bad bad"), (1, "bad bad"), (2, None), (None, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None, 1), (2, 1, None), (9, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, labels))
    assert out.count() == 4 and not any(r.toxic for r in out.collect())
    assert toxicity.score(docs.limit(0), toxicity.Model()).count() == 0


def plain_features(text):
    """A text's features by plain loops over its bytes: the hash of each word and of each beginning, by how often it is there."""
    import re
    from collections import Counter

    import pyarrow as pa

    from quillspark.llm.words import mix, words_of

    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = Counter()
    for w in re.findall(r"[0-9a-z\x80-\U0010ffff]+", lower):
        found[int(next(iter(words_of(pa.array([w]), lower=True)))[4][0])] += 1
        raw = w.encode()
        for k in toxicity.STEMS:
            if len(raw) >= k:
                found[int(mix(np.array([k << 56 | int.from_bytes(raw[:k], "little")], dtype=np.uint64))[0])] += 1
    out = set(found)
    for least in (2, 4):
        out |= {int(mix(np.array([f], dtype=np.uint64) + np.uint64(least))[0]) for f, n in found.items() if n >= least}
    return out


def test_toxicity_query_against_plain_scoring(spark):
    """Every whole document of the query, by a loop over its features and the written-out formula."""
    import math

    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(docs, labels)
    weight = dict(zip(model.words.tolist(), model.weights.tolist()))
    assert len(weight) > 10
    got = {r.doc_id: r for r in toxicity.query(spark, d).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        margin = sum(weight.get(f, 0.0) for f in plain_features(text))
        upto = [0.0, *(1 / (1 + math.exp(-max(-500, min(500, t - margin)))) for t in model.thresholds), 1.0]
        p = [b - a for a, b in zip(upto, upto[1:])]
        assert got[i].severity == pytest.approx(sum(k * x for k, x in enumerate(p)), abs=1e-9)
        assert got[i].p_toxic == pytest.approx(1 - p[0], abs=1e-9) and got[i].grade == max(range(3), key=lambda k: p[k])


def test_grades_come_from_the_other_half():
    """Toxic documents with more signs that the other half knows have the higher grade."""
    words, rng = np.arange(20, dtype=np.uint64), np.random.default_rng(0)
    toxic = np.arange(200) % 4 < 2
    docs = [np.append(rng.choice(np.arange(4, 20), 6, replace=False), ([0, 1, 2, 3] if i % 8 < 4 else [i % 2]) if t else []).astype(np.int64) for i, t in enumerate(toxic)]
    grade = toxicity.grades_of(words, docs, toxic)
    assert (grade[~toxic] == 0).all() and (grade[toxic] > 0).all()
    strong = np.arange(200) % 8 < 4
    assert np.mean(grade[toxic & strong] == 2) > 0.9 and np.mean(grade[toxic & ~strong] == 1) > 0.9


def test_toxicity_on_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 0


def test_kept_pieces_are_bounded_by_their_characters(monkeypatch):
    """Long runs that never come back are let go again, and results stay right."""
    from quillspark.llm import pieces, token_records

    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(97, 123, 2000))) + " end" for _ in range(60)]
    encoder = token_records.Encoder(token_records.tokenizer_path(), units=30_000)
    most = 0
    for t in texts:
        assert encoder(t).tolist() == encoder.tok.encode(t, add_special_tokens=False).ids
        most = max(most, encoder.letters + encoder.used)
    assert most <= 30_000 + 2 * 2100
    monkeypatch.setattr(pieces, "UNITS", 30_000)
    model, plain = pieces.Pieces(pieces.model_path(), 2), pieces.Pieces(pieces.model_path(), 2)
    most = 0
    for t in texts[:12]:
        plain.clear()
        assert model.encode(t)[0].tolist() == plain.encode(t)[0].tolist()
        most = max(most, model.letters + model.used)
    assert most <= 30_000 + 4 * 2100
