"""The pipeline's stages, each held on its own input against SQL, brute force or an exact round trip."""

import sys
from datetime import datetime

import numpy as np
import pytest

import corpus_pipeline
from quillspark.llm import line_dedup, minhash, mixing, pieces, quality, registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [docs]
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / "t.parquet")
        f(spark, out[-1], DIR).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def sql(query, docs):
    import duckdb

    con = duckdb.connect()
    frame = docs.select("doc_id", "text").toPandas()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(frame.itertuples(index=False, name=None)))
    return con.execute(query).fetchall()


def test_columns(stages):
    for s in stages[:-1]:
        assert s.columns == stages[0].columns


def test_quality_stage(stages):
    kept = {r.doc_id for r in quality.judge(stages[0]).where("kept").collect()}
    assert {r.doc_id for r in stages[1].collect()} == kept and 100 < len(kept) < 200


def test_line_stage(stages):
    import hashlib

    want = {r[0]: r[3] for r in sql(line_dedup.ORACLE, stages[1])}
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in stages[2].collect()} == want


def test_near_stage(stages):
    want = {r[0] for r in sql(minhash.oracle(5), stages[2]) if r[3]}
    assert {r.doc_id for r in stages[3].collect()} == want


def test_mixing_stage(stages):
    taken = {r.doc_id: r.taken for r in mixing.takings(stages[3]).collect()}
    got = {r.doc_id: r.n for r in stages[4].selectExpr("doc_id", r"regexp_count(text, '[^\\x20\\x09-\\x0D]+') AS n").groupBy("doc_id").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert got == {i: n for i, n in taken.items() if n}


def test_last_stage(stages):
    model = pieces.Pieces(pieces.model_path())
    texts = sorted((r.doc_id, r.text) for r in stages[4].collect())
    rows = sorted((r.doc_id, model.decode(np.array(r.ids, dtype=np.int64))) for r in stages[5].collect())
    assert rows == texts
    assert all(r.n_pieces == len(r.ids) and r.scores == sorted(r.scores, reverse=True) for r in stages[5].collect())


def test_run_chains_its_stages(spark, monkeypatch):
    """Each stage gets what the one before it wrote, and the folder of the tables."""
    seen = []

    def stage(name, keep):
        def f(session, docs, sf_dir):
            seen.append((name, docs.count(), sf_dir))
            return docs.where(keep)

        return name, f

    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("a", "doc_id >= 10"), stage("b", "doc_id >= 50"), stage("c", "doc_id < 60")])
    assert corpus_pipeline.run(spark, DIR).count() == 10
    assert seen == [("a", 200, DIR), ("b", 190, DIR), ("c", 150, DIR)]


def test_registered():
    names = set(registry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names - {"pipeline"}} == {f"op{i}" for i in range(1, 14)}
    assert "corpus_pipeline" in sys.modules and corpus_pipeline.ORACLE_SQL is None


def odd_rows():
    """Nulls in any column, empty, blank and very long texts, ties and repeated rows."""
    clean = " ".join(f"word{i} and{i % 7} thing{i % 13}" for i in range(40))
    return [
        (1, clean, "en", "a", len(clean)), (1, clean, "en", "a", len(clean)), (2, clean, None, None, None), (None, clean + " end", "en", "a", 5), (3, None, "en", "a", None), (4, "", "en", None, 0), (5, " \n\t", None, "a", 3),
        (6, "x" * 30_000, "en", "a", 30_000), (7, " ".join(f"w{i}" for i in range(20_000)), "en", "b", 1), (8, "line one is long enough to count here\n" * 3, "en", "a", 1), (9, "一二三 四五六 \U0001f600 " * 60, "zh", "c", 1),
    ]


@pytest.mark.parametrize("rows", [[], odd_rows()], ids=["empty", "odd"])
def test_run_on_odd_tables(spark, tmp_path, rows):
    """The whole pipeline and every operator's query over an empty table and over odd rows."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (7, 0, 1)] if rows else [], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    vectors = [(1, [0.5] * 8, 1), (1, [0.5] * 8, 1), (None, [0.25] * 8, None), (2, None, 1), (3, [None] * 8, 2)]
    spark.createDataFrame(vectors if rows else [], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    clicks = [(1, datetime(2024, 1, 3), datetime(2024, 1, 4), "a", 1.0), (1, datetime(2024, 1, 3), datetime(2024, 1, 4), "a", 1.0), (2, None, None, None, None), (None, datetime(2024, 1, 3), None, None, None)]
    spark.createDataFrame(clicks if rows else [], "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, kind string, value double").coalesce(1).write.parquet(f"{tmp_path}/clicks.parquet")
    for name, query in registry.queries().items():
        got = query(spark, str(tmp_path)).collect()
        if name == "op11_vector_codes":
            assert sorted(str(r.vec_id) for r in got) == (["1", "1", "None"] if rows else [])
        elif name == "op12_window_panes":
            assert sorted((r.record, r.kind, r.n_rows, r.cents) for r in got if r.record in ("emit", "final")) == ([("final", "a", 1, 100), ("final", "none", 1, 0)] if rows else [])
        elif name == "pipeline":
            assert bool(got) == bool(rows) and {r.doc_id for r in got} <= {i for i, *_ in rows}
        else:
            assert sorted(r.doc_id if r.doc_id is not None else -1 for r in got) == sorted(i if i is not None else -1 for i, *_ in rows), name
