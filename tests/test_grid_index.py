import random

import pytest

from pinfold.operators import grid_index as G
from pinfold.operators.cells import distance_pairs

SCHEMA = "row_id long, rel int, name string, lat double, lon double"


def pins(spark, n, seed=1, hot=0):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(3), f"n{i % 9}", 40 + rng.random() * 2, -75 - rng.random() * 2) for i in range(n)]
    rows += [(n + i, 1, "hot", 40.5, -75.5 + i * 1e-6) for i in range(hot)]
    return spark.createDataFrame([*rows, (-1, 1, "nowhere", None, None), (-2, None, "no key", 40.5, -75.5)], SCHEMA)


@pytest.fixture
def sort_merge(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def listed(df):
    return sorted(df.select("row_id", "r_row_id", "dist_m").collect())


@pytest.mark.parametrize("hot_rows", [G.HOT_ROWS, 7])
def test_same_pairs_as_without_the_index(spark, tmp_path, hot_rows):
    left, right = pins(spark, 300, 2), pins(spark, 2000, 3, hot=60)
    index = G.write_grid_index(right, str(tmp_path / "grid"), keys=("rel",), buckets=6, hot_rows=hot_rows)
    assert (spark.read.parquet(f"{index.path}/hot").count() > 0) == (hot_rows == 7)
    want = listed(distance_pairs(left, right, 3000.0, ["rel"]))
    assert want and listed(G.indexed_pairs(left, index, 3000.0)) == want
    again = G.open_grid_index(spark, index.path)
    assert again.table != index.table and listed(G.indexed_pairs(left, again, 3000.0)) == want
    assert again.rows(spark).count() == 2061


def test_the_stored_side_is_not_shuffled(spark, tmp_path, sort_merge):
    index = G.write_grid_index(pins(spark, 2000, 3), str(tmp_path / "grid"), keys=("rel",), buckets=6)
    plan = G.indexed_pairs(pins(spark, 100, 2), index, 3000.0)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    # the one side that is dealt by cells to meet the stored one
    assert plan.count("Exchange hashpartitioning(grid_cell") >= 1
    assert "Exchange hashpartitioning(r_grid_cell" not in plan


def test_a_viewport_skips_what_lies_outside(spark, tmp_path, sort_merge, monkeypatch):
    monkeypatch.setattr(G, "GROUP_BYTES", 1 << 14)
    monkeypatch.setattr(G, "PAGE_ROWS", 100)
    p = pins(spark, 20_000, 5)
    index = G.write_grid_index(p, str(tmp_path / "grid"), buckets=4)
    got = G.in_view(spark, index, 40.5, 40.6, -75.6, -75.5)
    want = p.where("lat between 40.5 and 40.6 and lon between -75.6 and -75.5")
    rows = got.collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, want.collect()), key=str) and rows
    scan = got._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    got._jdf.queryExecution().toRdd().count()
    assert 0 < scan.metrics().apply("numOutputRows").value() < 5000
    around = G.in_view(spark, index, 40.0, 41.0, 179.0, -76.5)
    assert around.count() == p.where("lat between 40 and 41 and lon <= -76.5").count() > 0


def test_codes_grow_with_either_axis(spark):
    cells = [(r, c) for r in (-5, 0, 3, 9000) for c in (-18000, -1, 0, 7)]
    df = spark.createDataFrame(cells, "a long, b long")
    got = {(r.a, r.b): r.z for r in df.select("a", "b", G.curve(df.a, df.b).alias("z")).collect()}
    assert len(set(got.values())) == len(cells)
    for (a, b), z in got.items():
        assert all(z <= w for (c, d), w in got.items() if c >= a and d >= b)


def test_empty_table(spark, tmp_path):
    index = G.write_grid_index(pins(spark, 1).limit(0), str(tmp_path / "grid"), keys=("rel",), buckets=3)
    assert G.indexed_pairs(pins(spark, 5), index, 3000.0).count() == 0
    assert G.in_view(spark, index, 0, 90, -180, 180).count() == 0
