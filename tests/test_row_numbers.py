"""Splits in which ``row_numbers`` reads its files."""

import pytest
from pyspark.sql import functions as F

from quillspark.plans import flows
from quillspark.sources import readers


class Seen(Exception):
    pass


@pytest.mark.parametrize("n", [2_000, 100_000])
def test_splits_do_not_grow_with_the_files(spark, tmp_path, monkeypatch, n):
    spark.range(n).select(F.col("id").alias("doc_id"), F.lit("some source").alias("source")).write.parquet(str(tmp_path / "documents.parquet"))

    def numbered(rows, name="row"):
        raise Seen(rows.rdd.getNumPartitions())

    monkeypatch.setattr(readers, "numbered", numbered)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    with pytest.raises(Seen) as seen:
        flows.row_numbers(spark, str(tmp_path))
    assert 5 < seen.value.args[0] <= 64 + 5
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
