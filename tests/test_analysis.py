import pytest
from pyspark.sql import functions as F

from quillspark.functions import models as md
from quillspark.operators import cues, scoring, segments
from quillspark.operators.analyze import analyze

BUS = " ".join([
    "I tried this last Tuesday after the bus was late, and honestly the first attempt was a mess. The cable slipped, I dropped a screw, and my neighbor laughed at the noise.",
    "Here are the key takeaways. First, leverage a robust strategic framework. Moreover, it is important to unlock scalable outcomes. In conclusion, these actionable steps elevate the journey.",
    "Back in my kitchen I changed the bracket, used the old wrench, and finally got it working. It still rattles sometimes, so I would not call the result perfect.",
])
PATTERNED = " ".join([
    "Two years apart. Two different data pipelines. The exact same result — to the millisecond.",
    "Here's what made it worth examining: the later run followed a completely different path.",
    "Result: one section improved — another habit remained unchanged.",
    "The first record tells you the ceiling moved. The tied record tells you exactly where the ceiling is.",
])
SHELF = "I rebuilt the shelf on Tuesday after measuring it wrong twice. The drill slipped, the dog barked at me, and I borrowed a square from my neighbor before dinner. It still leans a little, but the books finally fit."
ALERT = """As an AI language model, here are the key takeaways:
    First, build a robust framework. First, build a robust framework. First, build a robust framework.
    Result: robust — scalable. Outcome: clear — repeatable.
    Moreover, the lesson is clear. In conclusion, the lesson is clear."""
GATE = "I fixed the back gate after work on Tuesday. The hinge still squeaks, but the latch finally closes and the dog cannot nose it open anymore."


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        ("agree", "Great point. I agree!", "x", "post"), ("bus", BUS, "reddit", "post"), ("patterned", PATTERNED, "linkedin", "post"), ("shelf", SHELF, "linkedin", "post"),
        ("alert", ALERT, "linkedin", "post"), ("gate", GATE, "linkedin", "comment"), ("none", None, None, None), ("cjk", "你好世界", "x", "post"),
    ]
    df = spark.createDataFrame(data, "id string, text string, platform string, kind string")
    return {r.id: r for r in analyze(df, "id").collect()}


def ids(r):
    return [f.id for f in r.cues.families]


def test_known_texts(rows):
    assert rows["agree"].label.level == "cue-none" and rows["agree"].label.text == "0/6 cue families" and rows["agree"].cues.coverage.level == "short"
    bus = rows["bus"]
    assert bus.evidence.level != "insufficient" and len(bus.segments) >= 2 and "formulaic-framing" in ids(bus)
    assert "not proof" in bus.disclaimer and not bus.calibrated and bus.label.text == f"{len(bus.cues.families)}/6 cue families"
    assert all(len(f.detail) > 10 for f in bus.cues.families)
    assert rows["patterned"].label.level == "cue-multiple" and {"parallel-rhythm", "structured-presentation"} <= set(ids(rows["patterned"]))
    assert rows["shelf"].label.level == "cue-none" and rows["patterned"].cues.points > rows["shelf"].cues.points


def test_tone(rows):
    assert rows["gate"].cues.tone == "clear" and rows["patterned"].cues.tone == "caution" and rows["alert"].cues.tone == "alert"
    assert ids(rows["alert"])[0] == "self-disclosure" and rows["alert"].cues.families[0].points == 3


def test_odd_rows(rows):
    assert rows["none"].evidence.level == "insufficient" and rows["none"].platform == "unknown" and rows["none"].signal == 0.5
    assert rows["cjk"].evidence.reasons == ["non-Latin or mixed-script text"]


def test_calibrated_models(spark):
    bundle = {"models": {"x:post": {"intercept": 3, "weights": {"mattr25": 1.0}, "calibration": {"slope": 0, "intercept": 0}, "thresholds": {"moderate": 0.4, "strong": 0.45}}}}
    df = spark.createDataFrame([(1, SHELF, "x", "post"), (2, SHELF, "reddit", "post")], "id int, text string, platform string, kind string")
    out = {r.id: r for r in analyze(df, "id", bundle).collect()}
    assert out[1].calibrated and out[1].signal == 0.5 and out[1].label.level in ("moderate", "strong")
    assert not out[2].calibrated and out[2].signal == 0.5 and out[2].logit == 0
    strict = {r.id: r for r in analyze(df, "id", bundle, "conservative").collect()}
    assert strict[1].thresholds.moderate == pytest.approx(0.46)


def test_score_is_the_weighted_sum(spark, rows):
    r = rows["bus"]
    m = md.DEFAULT_BUNDLE["models"]["reddit:post"]
    logit = m["intercept"] + sum(w * r.features[k] for k, w in m["weights"].items())
    assert r.logit == pytest.approx(logit, abs=1e-12)
    sizes = [x.contribution for x in r.positive_drivers]
    assert sizes == sorted(sizes, reverse=True) and len(sizes) <= 4 and min(sizes) > 0.01


def test_character_weights(spark):
    bundle = {"models": {"default": {"intercept": 0.5, "weights": {}, "charNgramWeights": [0.1] * 128}}}
    df = spark.createDataFrame([(1, "some words to score", "x", "post")], "id int, text string, platform string, kind string")
    r = analyze(df, "id", bundle).first()
    assert r.logit == pytest.approx(0.5 + 0.1 * sum(r.char_ngrams)) and r.model_key == "x:post"


def test_hidden(spark):
    df = spark.createDataFrame([("short", False, "cue-none"), ("standard", False, "cue-one"), ("long", True, "insufficient")], "c string, calibrated boolean, l string")
    df = df.select("calibrated", F.struct(F.struct(F.col("c").alias("level")).alias("coverage")).alias("cues"), F.struct(F.col("l").alias("level")).alias("label"))
    assert [r[0] for r in df.select(scoring.hidden(True, False)).collect()] == [True, False, True]
    assert [r[0] for r in df.select(scoring.hidden(False, True)).collect()] == [True, False, False]


@pytest.mark.parametrize("lengths,want", [([20, 10, 20, 5], 2), ([30, 14], 1), ([30, 15], 2), ([10], 0), ([28] * 12, 8)])
def test_segments(spark, lengths, want):
    text = " ".join(" ".join(["word"] * n) + "." for n in lengths)
    got = spark.createDataFrame([(text,)], "t string").select(segments.split(F.col("t")).alias("s")).first().s
    assert len(got) == want
    if lengths == [30, 14]:
        assert got[0].count("word") == 44


def test_mixed(spark):
    pick = lambda lo, hi: spark.range(1).select(segments.mixed(F.lit(lo), F.lit(hi), F.lit(0.5), F.lit(0.7))).first()[0]
    assert pick(0.45, 0.71) and not pick(0.5, 0.76) and pick(0.1, 0.48) and not pick(0.6, 0.9)


@pytest.mark.parametrize("lengths,want", [([3, 12, 13, 1, 2, 12], 3), ([], 0), ([13], 0)])
def test_short_run(spark, lengths, want):
    assert spark.createDataFrame([(lengths,)], "n array<int>").select(cues.short_run(F.col("n"))).first()[0] == want


def test_bundles():
    assert set(md.for_platform(md.DEFAULT_BUNDLE, "x")["models"]) == {"x:post", "x:comment"}
    with pytest.raises(ValueError):
        md.exported({"models": {"a": {"weights": {}}}})
    key, model = md.exported({"models": {"b": {"calibration": {"slope": 1}, "thresholds": {"strong": 1}}, "a": {"calibration": {"slope": 1}, "thresholds": {"strong": 2}}}})
    assert key == "a" and md.published({}, key, model, "f")["metadata"]["calibrated"]
    with pytest.raises(ValueError):
        md.as_json({"x": float("nan")})
