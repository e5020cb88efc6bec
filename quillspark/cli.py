"""Command lines: ``python -m quillspark.cli prepare|augment|train|export``.

Paths may lie on any store that Spark reaches. Records are read by kind of file and written as JSON lines; weights,
cutoffs and report are JSON files with sorted keys and no NaN.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from quillspark.functions import models as md
from quillspark.operators import augment, prepare, train
from quillspark.sources import readers


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="quillspark")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("prepare", help="records of any tabular file to the training schema")
    p.add_argument("source")
    p.add_argument("target")
    for field in prepare.FALLBACKS:
        p.add_argument(f"--{field.replace('_', '-')}-field", dest=field, help=f"column of {field}")
    p.add_argument("--platform", dest="all_platform", help="the platform of every record")
    p.add_argument("--kind", dest="all_kind", help="the kind of every record")
    p.add_argument("--rejected", help="folder of the records that are left out, with reasons; without it an unknown label is an error")
    p = commands.add_parser("augment", help="each record and its three surface variants")
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("--seed", type=int, default=augment.SEED)
    p = commands.add_parser("train", help="models, cutoffs and report of training records")
    p.add_argument("source")
    p.add_argument("target", help="folder of weights.json, thresholds.json and report.json")
    p.add_argument("--seed", type=int, default=1337)
    p.add_argument("--target-fpr", type=float, default=train.TARGET_FPR)
    p.add_argument("--min-total", type=int, default=train.MIN_TOTAL)
    p.add_argument("--test-size", type=float, default=0.2)
    p.add_argument("--calibration-size", type=float, default=0.2)
    p.add_argument("--group-field", dest="group", default="source_id")
    p.add_argument("--unbalanced", action="store_true", help="classes weigh what they hold")
    p = commands.add_parser("export", help="put a trained model into a bundle")
    p.add_argument("weights")
    p.add_argument("target", help="the bundle that is written")
    p.add_argument("--bundle", help="the bundle to start from; without it the shipped one")
    p.add_argument("--thresholds")
    p.add_argument("--model", default="", help="key of the model; without it default, else the first")
    p.add_argument("--as", dest="name", default="", help="key that it gets in the bundle")
    return parser


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = _parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("quillspark").getOrCreate()
    load = lambda path: json.loads(readers.read_text(spark, path))
    if a.command == "prepare":
        fields = {f: getattr(a, f) for f in prepare.FALLBACKS if getattr(a, f)}
        rows = readers.numbered(readers.read_records(spark, a.source)) if readers.is_scan(a.source) else readers.read_records(spark, a.source)
        options = {"fields": fields, "platform": a.all_platform, "kind": a.all_kind, "row": "row" if readers.is_scan(a.source) else None}
        if a.rejected:
            found = prepare.sort_out(rows, readers.scratch(spark, "imported"), **options)
            readers.write_jsonl(found.kept, a.target)
            readers.write_jsonl(found.rejected, a.rejected)
            print(json.dumps(found.counts))
        else:
            readers.write_jsonl(prepare.import_records(rows, **options), a.target)
    elif a.command == "augment":
        readers.write_jsonl(augment.variants(readers.read_records(spark, a.source), seed=a.seed), a.target)
    elif a.command == "train":
        records = prepare.normalize_rows(readers.numbered(readers.read_jsonl(spark, a.source)), row="row").drop("row")
        weights, report = train.train_all(records, seed=a.seed, target_fpr=a.target_fpr, min_total=a.min_total, test_size=a.test_size, calibration_size=a.calibration_size, group=a.group, balanced=not a.unbalanced)
        cuts = {"models": {k: m["thresholds"] for k, m in weights["models"].items()}}
        for name, value in (("weights", weights), ("thresholds", cuts), ("report", report)):
            readers.write_text(spark, f"{a.target.rstrip('/')}/{name}.json", md.as_json(value))
    else:
        key, model = md.exported(load(a.weights), a.model, load(a.thresholds) if a.thresholds else None)
        bundle = load(a.bundle) if a.bundle else md.DEFAULT_BUNDLE
        readers.write_text(spark, a.target, md.as_json(md.published(bundle, a.name or key, model, a.weights)))


if __name__ == "__main__":
    main()
