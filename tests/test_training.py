import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import augment, evaluate, prepare, split, train


def test_threshold(spark):
    df = spark.createDataFrame([(s, y) for s, y in zip([0.1, 0.2, 0.3, 0.4, 0.8, 0.9], [0, 0, 0, 0, 1, 1])], "score double, target int")
    t = evaluate.human_threshold(df, 0.25)
    assert t["strong"] == np.nextafter(0.3, 1) and t["empirical_calibration_fpr"] == 0.25 and t["minimum_resolvable_fpr"] == 0.2
    with pytest.raises(ValueError):
        evaluate.human_threshold(df.where("target = 1"), 0.1)


def brute(rows, cut):
    s, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    pred = s >= cut
    tp, fp = (pred & (y == 1)).sum(), (pred & (y == 0)).sum()
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    ap, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        r, p = (s[y == 1] >= t).mean(), (y[s >= t] == 1).mean()
        ap, last = ap + (r - last) * p, r
    edges, ece = np.linspace(0, 1, 11), 0.0
    for i in range(10):
        m = (s >= edges[i]) & ((s < edges[i + 1]) if i < 9 else (s <= 1))
        if m.any():
            ece += m.mean() * abs(s[m].mean() - y[m].mean())
    return {"precision": tp / max(tp + fp, 1), "recall": tp / (y == 1).sum(), "false_positive_rate": fp / (y == 0).sum(), "roc_auc": auc, "average_precision": ap, "brier": ((s - y) ** 2).mean(), "expected_calibration_error": ece}


def test_metrics_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(float(s), int(y)) for s, y in zip(rng.choice([0, 0.1, 0.2, 0.3, 0.30000000000000004, 0.5, 0.7, 1.0], 200), rng.integers(0, 2, 200))]
    got = evaluate.binary_metrics(spark.createDataFrame(rows, "score double, target int"), [], 0.5).first().asDict()
    for k, v in brute(rows, 0.5).items():
        assert got[k] == pytest.approx(v, abs=1e-12), k
    assert got["f1"] == pytest.approx(2 * got["precision"] * got["recall"] / (got["precision"] + got["recall"]))
    one = evaluate.binary_metrics(spark.createDataFrame([(0.5, 1)], "score double, target int"), [], 0.4).first()
    assert one.roc_auc is None and one.false_positive_rate is None and one.precision == 1
    assert evaluate.binary_metrics(spark.createDataFrame([(0.5, 2)], "score double, target int"), [], 0.4).count() == 0


def test_slices(spark):
    df = spark.createDataFrame([(0.9, 1, "x", 10), (0.2, 0, "", 30), (0.6, 2, None, 130), (0.8, 2, "x", 10)], "score double, target int, platform string, words int")
    got = {(r.dimension, r.value): r for r in evaluate.slice_report(df, 0.7).collect()}
    assert got["platform", "unknown"].n == 1 and got["platform", "x"].mixed_n == 1 and got["length", "120+"].n is None
    assert got["generator", "unknown"].mixed_median_signal == pytest.approx(0.7) and got["generator", "unknown"].mixed_share_at_or_above_strong == 0.5


def test_group_split(spark):
    df = spark.createDataFrame([(f"s{i}", f"t{i}-{j}", i % 2, "post") for i in range(30) for j in range(2)], "source_id string, text string, target int, kind string")
    parts, about = split.split(df, seed=3)
    a = split.audit(parts, about)
    assert a["method"] == "group-shuffle" and set(a["group_overlap"].values()) == {0}
    assert (a["n_train"], a["n_calibration"], a["n_test"]) == (36, 12, 12)
    again = split.split(df.repartition(5), seed=3)[0]
    assert sorted(map(str, parts.select("text", "part").collect())) == sorted(map(str, again.select("text", "part").collect()))
    for bad in ((0, 0.2), (0.5, 0.3)):
        with pytest.raises(ValueError):
            split.split(df, test_size=bad[0], calibration_size=bad[1])


def test_stratified_split(spark):
    df = spark.createDataFrame([(f"s{i}", f"t{i}", i % 2, "post") for i in range(180)], "source_id string, text string, target int, kind string")
    parts, about = split.split(df)
    got = {(r.part, r.target): r["count"] for r in parts.groupBy("part", "target").count().collect()}
    assert about["method"] == "stratified-random" and got == {("test", 0): 18, ("test", 1): 18, ("calibration", 0): 18, ("calibration", 1): 18, ("train", 0): 54, ("train", 1): 54}


def test_labels(spark):
    df = spark.createDataFrame([("human",), ("AI_generated",), ("human-polished",), ("2",), ("maybe",), (None,)], "authorship string")
    assert [r.target for r in prepare.normalize_rows(df, strict=False).collect()] == [0, 1, 2, 2, None, None]
    with pytest.raises(Exception, match="no label"):
        prepare.normalize_rows(df).collect()
    numbers = spark.createDataFrame([(0,), (1,), (2,)], "label int")
    assert [r.target for r in prepare.normalize_rows(numbers).collect()] == [0, 1, 2]
    flags = spark.createDataFrame([(True,), (False,)], "label boolean")
    assert [r.target for r in prepare.normalize_rows(flags).collect()] == [1, 0]


def test_platforms_and_kinds(spark):
    df = spark.createDataFrame([("Twitter ", "Replies"), ("old.reddit.com", None), ("", "x"), ("Mastodon", "comment")], "p string, k string")
    got = df.select(prepare.platform_of(F.col("p")), prepare.kind_of(F.coalesce("k", F.lit("post")))).collect()
    assert [tuple(r) for r in got] == [("x", "comment"), ("reddit", "post"), ("unknown", "post"), ("mastodon", "comment")]


def test_import(spark, tmp_path):
    from quillspark.sources.readers import read_records

    (tmp_path / "a.csv").write_text("content,class,network\nhello there,real,x\n,fake,x\nbye,,x\nagain,fake,reddit\n")
    rows = prepare.import_records(read_records(spark, str(tmp_path / "a.csv"))).orderBy("text").collect()
    assert [(r.text, r.authorship, r.platform, r.kind, r.attack) for r in rows] == [("again", "ai", "reddit", "post", "none"), ("hello there", "human", "x", "post", "none")]
    (tmp_path / "b.json").write_text('{"data": [{"text": "a", "label": "0", "id": 7}]}')
    r = prepare.import_records(read_records(spark, str(tmp_path / "b.json"))).first()
    assert (r.source_id, r.authorship) == ("7", "human")
    (tmp_path / "c.jsonl").write_text('{"text": "a", "label": "1.0"}\n\n')
    bad = prepare.import_records(read_records(spark, str(tmp_path / "c.jsonl")), strict=False)
    assert bad.count() == 0


def test_variants(spark):
    df = spark.createDataFrame([(1, "Hello, WORLD! Something: Interesting; Happens? Now THEN Again", "s1"), (2, None, "s2")], "n int, text string, source_id string")
    got = {(r.n, r.attack): r.text for r in augment.variants(df).collect()}
    assert len(got) == 8 and got[1, "punctuation-drop"] == "Hello WORLD Something Interesting Happens Now THEN Again"
    assert got[1, "case-variation"] == "hello, WORLD! Something: Interesting; Happens? Now THEN again"
    typo = got[1, "single-typo"]
    assert typo == "Hello, WORLD! Something: Interesting; Happens? Now THEN Again"  # no word of seven letters stands alone
    plain = spark.createDataFrame([("wonderful short", "s")], "text string, source_id string")
    assert {r.attack: r.text for r in augment.variants(plain).collect()}["single-typo"] == "wondreful short"
    assert {r.text for r in augment.variants(plain.withColumn("text", F.lit(""))).collect()} == {""}


def test_end_to_end(spark):
    human = "I fixed the gate number {} after work and it still squeaks a bit, sorry!"
    ai = "Here are the key takeaways {}: moreover, leverage a robust strategic framework to unlock scalable outcomes."
    rows = [(t.format(i), a, "x", "post", f"{a}-{i}") for i in range(90) for t, a in ((human, "human"), (ai, "ai"))]
    df = spark.createDataFrame(rows, "text string, authorship string, platform string, kind string, source_id string")
    weights, report = train.train_all(prepare.normalize_rows(df), min_total=100, target_fpr=0.1)
    model, out = weights["models"]["x:post"], report["models"]["x:post"]
    assert set(weights["models"]) == {"x:post", "default"} and len(model["charNgramWeights"]) == 128 and model["calibration"]["method"] == "held-out-sigmoid"
    assert out["split"]["n_test"] == 36 and out["test"]["roc_auc"] > 0.99 and report["skipped_models"]["x:comment"]["n_total"] == 0
    from quillspark.functions import models as md
    from quillspark.operators.analyze import analyze

    md.as_json(weights)
    md.as_json(report)
    text = ai.format(7)
    one = spark.createDataFrame([(1, text, "x", "post")], "id int, text string, platform string, kind string")
    r = analyze(one, "id", weights).first()
    by_hand = model["intercept"] + sum(w * r.features[k] for k, w in model["weights"].items()) + float(np.dot(model["charNgramWeights"], r.char_ngrams))
    score = 1 / (1 + np.exp(-(model["calibration"]["slope"] * by_hand + model["calibration"]["intercept"])))
    assert r.calibrated and r.signal == pytest.approx(score, abs=1e-10) and r.signal > 0.5


def test_fit_matches_newton(spark):
    rng = np.random.default_rng(0)
    x, n = rng.normal(size=(120, 3)), 120
    y = (x[:, 0] + rng.normal(size=n) > 0.4).astype(int)
    df = spark.createDataFrame([(r.tolist(), int(t)) for r, t in zip(x, y)], "inputs array<double>, target int")
    w, b = train.fit(df, balanced=True)
    weight, beta, z = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum()))), np.zeros(4), np.c_[x, np.ones(n)]
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ beta))
        g = z.T @ (weight * (p - y)) + np.r_[beta[:3], 0]
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([1, 1, 1, 0])
        beta -= np.linalg.solve(h, g)
    assert np.allclose([*w, b], beta, atol=1e-5)


def test_fit_many_equals_single_fits(spark):
    """All models in one go, against Newton's method for each on its own rows."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        x = rng.normal(size=5)
        own = [m for m, keep in (("a", i % 2), ("b", i % 3 == 0), ("all", True)) if keep]
        rows.append((x.tolist(), int(x[0] + rng.normal() > 0.3 * (i % 2)), own))
    df = spark.createDataFrame(rows, "inputs array<double>, target int, models array<string>").repartition(5)
    for balanced in (True, False):
        got = train.fit_many(df, balanced)
        assert set(got) == {"a", "b", "all"}
        for name, (w, b) in got.items():
            x, y = (np.array([r[k] for r in rows if name in r[2]]) for k in (0, 1))
            n, z, beta = len(y), np.c_[x, np.ones(len(y))], np.zeros(6)
            weight = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum()))) if balanced else np.ones(n)
            for _ in range(40):
                p = 1 / (1 + np.exp(-z @ beta))
                g = z.T @ (weight * (p - y)) + np.r_[beta[:5], 0]
                beta -= np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([1, 1, 1, 1, 1, 0]), g)
            assert np.allclose([*w, b], beta, atol=1e-9)
    with pytest.raises(ValueError, match="one class"):
        train.fit_many(df.where("target = 1"))
    assert train.fit_many(df.limit(0)) == {}


def test_models_are_trained_as_each_by_itself(spark):
    """One run over two platforms gives what a run over each gives."""
    rng = np.random.default_rng(5)
    words = "gate hinge after work squeaks leverage robust moreover unlock scalable we they was has just".split()
    rows = [(" ".join(rng.choice(words, 12)) + ("!" if i % 2 else "."), ["human", "ai"][int(rng.random() < 0.3 + 0.4 * (i % 2))], ["x", "reddit"][i % 3 == 0], "post", f"s{i // 2}") for i in range(480)]
    df = prepare.normalize_rows(spark.createDataFrame(rows, "text string, authorship string, platform string, kind string, source_id string"))
    both, report = train.train_all(df, min_total=60, target_fpr=0.2)
    assert set(both["models"]) == {"x:post", "reddit:post", "default"} and set(report["skipped_models"]) == {"linkedin:post", "linkedin:comment", "reddit:comment", "x:comment"}
    alone = train.train_one(train.matrix(df.where("platform = 'x'")), min_total=60, target_fpr=0.2)
    model, other = both["models"]["x:post"], alone["model"]
    assert np.allclose(model["charNgramWeights"], other["charNgramWeights"], atol=1e-8) and model["thresholds"]["strong"] == pytest.approx(other["thresholds"]["strong"], abs=1e-8)
    assert report["models"]["x:post"]["split"] == alone["report"]["split"] and report["models"]["x:post"]["split"]["group_overlap"] == {"train_calibration": 0, "train_test": 0, "calibration_test": 0}
    assert [{k: v for k, v in r.items() if k in ("dimension", "value", "n")} for r in report["models"]["x:post"]["slices"]] == [{k: v for k, v in r.items() if k in ("dimension", "value", "n")} for r in alone["report"]["slices"]]


def test_strata_split_each_model(spark):
    rows = [(f"t{i}", i % 2, "post", f"s{i}", m) for i in range(100) for m in (("a", "b") if i % 4 else ("a",))]
    df = spark.createDataFrame(rows, "text string, target int, kind string, source_id string, model string")
    parts, about = split.split_each(df)
    got = {(r.model, r.part, r.target): r["count"] for r in parts.groupBy("model", "part", "target").count().collect()}
    assert {k: a["method"] for k, a in about.items()} == {"a": "stratified-random", "b": "stratified-random"}
    assert [got["a", "test", t] for t in (0, 1)] == [10, 10] and [got["b", "test", t] for t in (0, 1)] == [5, 10]
    seen = split.audit_each(parts, about)
    assert seen["a"]["n_train"] + seen["a"]["n_calibration"] + seen["a"]["n_test"] == 100 and "group_overlap" not in seen["b"]


def test_rows_are_numbered_by_place(spark, tmp_path):
    """Files by path, records by place, blank lines not counted; whatever the splits and partitions."""
    from quillspark.sources import readers

    texts = [f"row {i} " + "x" * (i % 50) for i in range(400)]
    for f in range(4):
        (tmp_path / f"{f}.jsonl").write_text("".join(f'{{"text": "{t}", "label": "human"}}\n' + "\n" * (i % 3 == 0) for i, t in enumerate(texts[100 * f : 100 * f + 100])))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = readers.numbered(readers.read_jsonl(spark, str(tmp_path / "*.jsonl"))).repartition(6).collect()
            assert sorted((r.row, r.text) for r in got) == list(enumerate(texts))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "c.csv").write_text("text,label\na,human\n,ai\n\"b\nc\",ai\n")
    rows = prepare.import_records(readers.numbered(readers.read_records(spark, str(tmp_path / "c.csv"))), row="row")
    assert sorted((r.source_id, r.text) for r in rows.collect()) == [("row-0", "a"), ("row-2", "b\nc")]


def test_rejected_rows_are_kept_apart(spark, tmp_path):
    rows = [("a", "Human"), ("", "ai"), (None, "ai"), ("b", None), ("c", "perhaps"), ("d", "fake"), ("d", "fake")]
    out = prepare.sort_out(spark.createDataFrame(rows, "text string, label string"), str(tmp_path / "out"))
    assert sorted((r.text, r.authorship) for r in out.kept.collect()) == [("a", "human"), ("d", "ai"), ("d", "ai")]
    assert sorted((r.text or "", r.label or "", r.reason) for r in out.rejected.collect()) == [("", "ai", "no text"), ("", "ai", "no text"), ("b", "", "no label"), ("c", "perhaps", "unknown label")]
    assert out.counts == {"rows": 7, "kept": 3, "no text": 2, "no label": 1, "unknown label": 1}


def test_close_scores_spread_over_tasks(spark):
    """Scores within a millionth of each other do not meet in one task, and ranks stay exact."""
    rng = np.random.default_rng(3)
    rows = [(0.5 + float(s) * 1e-9, int(y)) for s, y in zip(rng.integers(0, 900, 3000), rng.integers(0, 2, 3000))]
    df = spark.createDataFrame(rows, "score double, target int")
    got = evaluate.binary_metrics(df, [], 0.5).first()
    want = brute(rows, 0.5)
    assert got.roc_auc == pytest.approx(want["roc_auc"], abs=1e-12) and got.average_precision == pytest.approx(want["average_precision"], abs=1e-9)
    ties = df.groupBy(F.lit(1).alias("k"), F.col("score").alias("s")).agg(F.count(F.lit(1)).alias("c"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together
    try:
        place = ties.repartitionByRange("k", "s").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in place) <= 0.6 * ties.count()
    assert evaluate.medians(df.withColumn("k", F.lit("a")), ["k"]).first().median == pytest.approx(float(np.median([r[0] for r in rows])), abs=1e-15)
