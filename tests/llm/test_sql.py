"""Operators that SQL expresses against their SQL in another engine."""

import glob
import os

import duckdb
import pytest

from tracewright.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    frame, other = QUERIES[name](spark, SF), c.sql(ORACLE_SQL[name])
    columns = sorted(frame.columns)
    assert columns == sorted(other.columns)
    at = [other.columns.index(x) for x in columns]
    assert sorted(repr([r[x] for x in columns]) for r in frame.collect()) == sorted(repr([r[i] for i in at]) for r in other.fetchall())
