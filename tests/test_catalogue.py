"""Every query of the catalogue against its SQL on the smallest test tables."""

import math
from pathlib import Path

import pytest

from pinfold.queries import catalogue

duckdb = pytest.importorskip("duckdb")
SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in SF.glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con


def plain(value):
    return ("nan" if math.isnan(value) else repr(value)) if isinstance(value, float) else repr(value)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_same_rows_as_sql(spark, tables, name):
    df = catalogue.QUERIES[name](spark, str(SF))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    rel = tables.sql(catalogue.SQL[name])
    order = sorted(df.columns)
    assert sorted(rel.columns) == order
    ours = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    theirs = sorted(tuple(plain(r[rel.columns.index(c)]) for c in order) for r in rel.fetchall())
    assert ours == theirs


def test_scans_read_only_what_they_need(spark):
    plan = catalogue.QUERIES["topk_common"](spark, str(SF))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_type:string>" in plan
    plan = catalogue.QUERIES["replace_partition"](spark, str(SF))._jdf.queryExecution().executedPlan().toString()
    assert "c_acctbal" not in plan
