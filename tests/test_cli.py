import json

import pytest

from quillspark import cli
from quillspark.operators import train


def test_prepare_and_augment(spark, tmp_path):
    (tmp_path / "a.csv").write_text("words,class,network\nHello, there are wonderful things,real,x\n,fake,x\n".replace("Hello, there", "Hello there"))
    cli.main(["prepare", str(tmp_path / "a.csv"), str(tmp_path / "p.jsonl"), "--text-field", "words", "--kind", "comment"], spark)
    r = spark.read.json(str(tmp_path / "p.jsonl")).collect()
    assert [(x.text, x.authorship, x.platform, x.kind) for x in r] == [("Hello there are wonderful things", "human", "x", "comment")]
    cli.main(["augment", str(tmp_path / "p.jsonl"), str(tmp_path / "v.jsonl")], spark)
    assert spark.read.json(str(tmp_path / "v.jsonl")).count() == 4


def test_train_and_export(spark, tmp_path, monkeypatch):
    """What training gives goes to three files, and a model of them into a bundle."""
    model = {"intercept": 0.5, "weights": {"mattr25": 1.0}, "charNgramWeights": None, "calibration": {"slope": 1.0, "intercept": 0.0, "method": "held-out-sigmoid"}, "thresholds": {"strong": 0.7, "moderate": 0.5}}
    seen = {}

    def fake(records, **options):
        seen.update(options, n=records.count())
        return {"models": {"x:post": model}}, {"models": {}, "skipped_models": {}}

    monkeypatch.setattr(train, "train_all", fake)
    (tmp_path / "r.jsonl").write_text('{"text": "a", "authorship": "human"}\n{"text": "b", "authorship": "ai"}\n')
    cli.main(["train", str(tmp_path / "r.jsonl"), str(tmp_path / "out"), "--min-total", "2", "--unbalanced"], spark)
    assert seen["n"] == 2 and seen["min_total"] == 2 and not seen["balanced"] and seen["target_fpr"] == 0.01
    assert json.loads((tmp_path / "out/thresholds.json").read_text()) == {"models": {"x:post": {"strong": 0.7, "moderate": 0.5}}}
    cli.main(["export", str(tmp_path / "out/weights.json"), str(tmp_path / "bundle.json"), "--as", "linkedin:post"], spark)
    bundle = json.loads((tmp_path / "bundle.json").read_text())
    assert bundle["models"]["linkedin:post"]["thresholds"]["strong"] == 0.7 and len(bundle["models"]) == 6
    with pytest.raises(SystemExit):
        cli.main(["export"], spark)


def test_training_for_real(spark, tmp_path):
    """Records of a file to three files of a model that was trained, and its rejected rows beside them."""
    lines = [json.dumps({"text": t.format(i), "label": a, "platform": "x", "source_id": f"{a}-{i}"}) for i in range(60) for t, a in (("I fixed gate {} and it still squeaks, sorry!", "human"), ("Moreover, leverage a robust plan {} to unlock outcomes.", "ai"))]
    (tmp_path / "a.jsonl").write_text("\n".join([*lines, '{"text": "odd", "label": "perhaps"}', '{"label": "ai"}']) + "\n")
    cli.main(["prepare", str(tmp_path / "a.jsonl"), str(tmp_path / "p"), "--rejected", str(tmp_path / "r")], spark)
    assert sorted((x.reason, x.source_id) for x in spark.read.json(str(tmp_path / "r")).collect()) == [("no text", "row-121"), ("unknown label", "row-120")]
    cli.main(["train", str(tmp_path / "p"), str(tmp_path / "out"), "--min-total", "60", "--target-fpr", "0.2"], spark)
    files = {n: json.loads((tmp_path / f"out/{n}.json").read_text()) for n in ("weights", "thresholds", "report")}
    assert set(files["weights"]["models"]) == set(files["thresholds"]["models"]) == {"x:post", "default"}
    about = files["report"]["models"]["x:post"]
    assert about["test"]["roc_auc"] > 0.99 and about["calibration"]["n"] == about["split"]["n_calibration"] and files["report"]["skipped_models"]["x:comment"]["n_total"] == 0
