"""Queries of a version read the line items once, whatever is derived from them."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_upserted_edges_derive_all_from_one_table(spark):
    out = entry.queries()["upserted_edges"](spark, DATA)
    assert out.inputFiles() and not any("lineitem" in f for f in out.inputFiles())
    db = duckdb.connect()
    for name in os.listdir(DATA):
        db.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    assert sorted(map(tuple, out.collect())) == sorted(db.execute(entry.oracle_sql()["upserted_edges"]).fetchall())
