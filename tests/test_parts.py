"""Tables of one row group are dealt to parts of one size, whatever their own."""

import pytest
from pyspark.sql import functions as F

from quillspark.plans import flows, registry
from quillspark.sources import readers

QUERIES = ("language_support", "markup", "phrase_hits", "char_profiles", "calibrated_scores", "cue_rubric", "cue_counts", "analysis", "calibrated_analysis", "typing_errors", "trained")


@pytest.fixture
def tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "PART", 1 << 12, raising=False)
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.md5(F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(32).cast("long").alias("n_chars"))
    rows.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    rows.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", QUERIES)
def test_documents_are_dealt_to_parts(spark, tables, name):
    df = flows._records(spark, tables) if name == "trained" else registry.queries()[name](spark, tables)
    assert df.rdd.getNumPartitions() >= 20


def test_parts_are_of_one_size(spark, tables):
    df = readers.read_table(spark, f"{tables}/documents.parquet")
    sizes = [r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 4000 and len(sizes) >= 20 and max(sizes) <= 3 * 4000 / len(sizes)
