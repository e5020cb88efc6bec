"""Registered queries against their SQL, and against plain loops where there is none."""

import glob
import os

import duckdb
import pytest

from quillspark.plans import flows, registry, streams, style

DIR = "/root/testdata/sf0.001"
#: Held by other tests or by the driver alone, since they take long.
SLOW = {"trained"}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(rows):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted((set(style.queries()) | set(flows.queries()) | set(streams.queries()) | {"document_fingerprints", "augmented", "page_texts", "group_split", "cue_counts"}) - SLOW))
def test_query_equals_its_sql(spark, con, name):
    df = registry.queries()[name](spark, DIR)
    want = con.execute(registry.oracle_sql()[name])
    at = [d[0] for d in want.description]
    assert sorted(at) == sorted(df.columns)
    got = plain(tuple(r[c] for c in at) for r in df.collect())
    assert got == plain(want.fetchall()) and got


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())
