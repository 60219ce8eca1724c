"""The registry of queries."""

from __future__ import annotations

import importlib

import duckdb
import pytest

entry = importlib.import_module("__spark_entry__")
DATA = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    try:
        df = entry.entry(spark)
    except Exception as e:  # noqa: BLE001
        pytest.skip(f"no test data: {e}")
    assert df.columns == ["sample_desc", "cleaned", "matched", "macro", "micro"]


@pytest.mark.parametrize("name", ["p1_found", "p5_found", "permutation_match", "full_term_cascade", "retained_components"])
def test_query_equals_sql(spark, name):
    import glob
    import os

    con = duckdb.connect()
    files = glob.glob(f"{DATA}/*.parquet")
    if not files:
        pytest.skip("no test data")
    for p in files:
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert got == sorted(map(tuple, want), key=repr)
