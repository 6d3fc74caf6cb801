import math
import random

import pytest
from pyspark.sql import functions as F

from pinfold.operators.cells import distance_pairs, nearest, without_near
from pinfold.operators.components import connected_components
from pinfold.operators.dedupe import best_of, near_clusters
from pinfold.operators.polygons import assign, containing, edges_of, geojson_polygons
from pinfold.operators.rollup import at_focus, gap_report, label_of, levels, upper_median
from pinfold.operators.sampling import fill_quota, spread_sample
from pinfold.plans import moves as M

PIN = "row_id long, name string, rel int, lat double, lon double"


def metres(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371000 * math.asin(min(1, math.sqrt(x)))


@pytest.mark.parametrize("lat", [0.0, 40.0, 71.0, -65.0])
def test_cell_join_equals_brute_force(spark, lat):
    rng = random.Random(lat)
    rows = [(i, "n", rng.randint(0, 1), lat + rng.uniform(-0.05, 0.05), rng.uniform(-0.1, 0.1)) for i in range(150)] + [(900, "x", 0, None, 1.0), (901, "x", 0, lat, None)]
    df = spark.createDataFrame(rows, PIN)
    got = {(r.row_id, r.r_row_id) for r in distance_pairs(df, df, 1500.0, ["rel"]).collect()}
    real = [r for r in rows if None not in r]
    want = {(a[0], b[0]) for a in real for b in real if a[2] == b[2] and metres(a[3], a[4], b[3], b[4]) <= 1500}
    assert got == want
    best = {r.row_id: r.r_row_id for r in nearest(distance_pairs(df, df, 1500.0).where("row_id <> r_row_id")).collect()}
    for a in real:
        near = sorted((round(metres(a[3], a[4], b[3], b[4]), 3), b[0]) for b in real if b[0] != a[0])
        assert best.get(a[0]) == (near[0][1] if near[0][0] <= 1500 else None)


def test_adjacent_cells_find_fewer(spark):
    df = spark.createDataFrame([(1, "a", 0, 60.0, 10.0), (2, "b", 0, 60.0, 10.017)], PIN)
    assert distance_pairs(df, df, 1000.0).where("row_id < r_row_id").count() == 1
    df = spark.createDataFrame([(1, "a", 0, 60.0, 10.0), (2, "b", 0, 60.0, 10.0255)], PIN)
    assert distance_pairs(df, df, 2000.0).where("row_id < r_row_id").count() == 1
    assert distance_pairs(df, df, 2000.0, neighbourhood="3x3").where("row_id < r_row_id").count() == 0


def test_gap_fill_is_idempotent(spark):
    a = spark.createDataFrame([(1, "a", 0, 40.0, -75.0)], PIN)
    b = spark.createDataFrame([(11, "x", 0, 40.001, -75.0), (12, "y", 1, 40.001, -75.0), (13, "z", 0, 40.1, -75.0)], PIN)
    gaps = without_near(b, a, 250.0, ["rel"])
    assert sorted(r.row_id for r in gaps.collect()) == [12, 13]
    assert without_near(b, a.unionByName(gaps), 250.0, ["rel"]).count() == 0


def test_components_against_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(300)] + [(k, k + 1) for k in range(1000, 1120)] + [(5000, 6000 + k) for k in range(200)] + [(7, 7), (None, 3), (3, None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if None not in (a, b) and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_chain_of_ten_is_one_cluster(spark):
    rows = [(i, "n", 0, 40.0 + i * 0.0008, -75.0) for i in range(10)] + [(50, "n", 0, 40.5, -75.0), (51, "n", 1, 40.0, -75.0)]
    got = {r.row_id: r.component for r in near_clusters(spark.createDataFrame(rows, PIN), 100.0, ["rel"]).collect()}
    assert got == {**dict.fromkeys(range(10), 0), 50: 50, 51: 51}


def test_best_of_prefers_the_earlier_row(spark):
    df = spark.createDataFrame([(3, "k", 5), (1, "k", 5), (2, "k", 4), (9, None, 1)], "row_id long, k string, s int")
    assert sorted((r.row_id, r.k) for r in best_of(df, ["k"], F.col("s")).collect()) == [(1, "k"), (9, None)]


SQUARE = [[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0], [0.0, 0.0]], [[0.5, 0.5], [1.5, 0.5], [1.5, 1.5], [0.5, 1.5], [0.5, 0.5]]]


def test_points_in_polygons(spark):
    polys = spark.createDataFrame([("b", SQUARE), ("c", [[[2.0, 0.0], [3.0, 0.0], [3.0, 2.0], [2.0, 2.0], [2.0, 0.0]], [[0.0, 0.0], [1.0, 1.0], [0.0, 0.0]]])], "poly_id string, rings array<array<array<double>>>")
    points = [(1, 0.25, 0.25), (2, 1.0, 1.0), (3, 1.0, 2.0), (4, 1.0, 2.5), (5, 5.0, 5.0), (6, 2.0, 0.3), (7, 0.5, 1.0), (8, -0.01, 1.0), (9, None, 1.0)]
    df = spark.createDataFrame(points, "row_id long, lat double, lon double")
    got = {r.row_id: r.poly_id for r in containing(df, edges_of(polys)).collect()}
    assert got == {1: "b", 3: "b", 4: "c", 6: "b", 7: "b"}
    full = {r.row_id: (r.poly_id, r.how) for r in assign(df, edges_of(polys), 0.05).collect()}
    assert full[8] == ("b", "near") and full[2] == (None, None) and full[5] == (None, None) and full[9] == (None, None)
    text = '{"features": [{"properties": {"id": "1", "s": "KY", "c": "X"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0,0],[1,0],[1,1],[0,0]]]]}}]}'
    p = geojson_polygons(spark, spark.createDataFrame([(text,)], "value string")).first()
    assert (p.poly_id, p.state, p.rings) == ("1", "KY", [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]])


def test_roll_ups_and_reports(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "z")], "s string, c string")
    rolled = levels(df, "s", "c", {"n": F.count("*")})
    pick = lambda **k: at_focus(rolled, "s", "c", **k).first().n
    assert (pick(), pick(state="a"), pick(state="a", county="x")) == (4, 3, 2)
    m = spark.createDataFrame([("a", 3), ("b", 1)], "k string, n long")
    c = spark.createDataFrame([("a", 4), ("c", 2)], "k string, n long")
    got = {r.k: (r.mapped, r.census, r.gap, r.pct) for r in gap_report(m, c, ["k"]).collect()}
    assert got == {"a": (3, 4, 1, 25.0), "b": (1, 0, -1, None), "c": (0, 2, 2, 100.0)}
    rows = spark.createDataFrame([("k", "first", 1), ("k", "last", 2)], "key string, label string, row_id long")
    assert label_of(rows, "key", "label", "row_id", True).first().label == "last" and label_of(rows, "key", "label", "row_id", False).first().label == "first"
    med = spark.createDataFrame([("a", float(v)) for v in (5, 1, 1, 9)] + [("b", 2.0), ("c", None)], "k string, v double")
    assert {r.k: r.upper_median for r in upper_median(med, ["k"], "v").collect()} == {"a": 5.0, "b": 2.0}


def test_quota_and_samples(spark):
    pins = spark.createDataFrame([(i, "n", 0, 40.0, -75.0, "a") for i in range(3)] + [(9, "n", 0, 40.0, -75.0, "b")], PIN + ", county string")
    needs = spark.createDataFrame([("a", 0, 7), ("b", 0, 1), ("c", 0, 5), ("a", 1, 2)], "county string, rel int, need long")
    rows = fill_quota(pins, needs, ["county", "rel"]).orderBy("county", "slot").collect()
    assert [(r.county, r.slot, r.source_id, r.synthetic) for r in rows] == [("a", 1, 0, False), ("a", 2, 1, False), ("a", 3, 2, False), ("a", 4, 0, True), ("a", 5, 1, True), ("a", 6, 2, True), ("a", 7, 0, True), ("b", 1, 9, False)]
    df = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(90)], "row_id long, s string")
    one, two = (sorted(r.row_id for r in spread_sample(df.repartition(k), "s", 10, 3).collect()) for k in (1, 5))
    assert one == two and len(one) == 10


def test_plans(spark):
    rows = spark.createDataFrame([(1, "a", 0, 40.0, -75.0), (2, "b", 0, 40.1, -75.1), (3, "c", 0, 40.2, -75.2), (4, "d", 0, 40.3, -75.3)], PIN)
    plan = spark.createDataFrame([(1, "a", 41.0, -75.0), (2, "b", 41.0, -75.0), (3, "c", 40.3, -75.3), (4, "d", 42.0, -75.0)], "row_id long, name string, new_lat double, new_lon double")
    g = {r.row_id: r.blocked for r in M.guard_occupied(M.guard_unique(plan), rows).collect()}
    assert g == {1: "shared_destination", 2: "shared_destination", 3: "occupied", 4: None}
    near = {r.row_id: r.blocked for r in M.guard_near(M.guard_unique(plan), rows).collect()}
    assert near[3] == "near_occupied" and near[4] is None
    moved = {r.row_id: (r.lat, r.moved) for r in M.apply_moves(rows, plan.where("row_id = 4")).collect()}
    assert moved[4] == (42.0, True) and moved[1] == (40.0, False)
    assert M.apply_drops(rows, plan.where("row_id > 2")).count() == 2
    specs = spark.createDataFrame([(1, "a", 4000000, -7500000), (2, "zz", 4010000, -7510000), (3, "q", 1, 1)], "plan_id long, name string, p_lat long, p_lon long")
    assert sorted((r.plan_id, r.row_id) for r in M.match_plan(specs, rows).collect()) == [(1, 1), (2, 2), (3, None)]


def test_ledger_adds_up(spark):
    rows = spark.createDataFrame([(i, "n", i % 2, 40.0 + i, -75.0) for i in range(10)], PIN)
    dropped = M.apply_drops(rows, rows.where("row_id < 3"))
    book = M.ledger([("read", rows), ("dropped", dropped)]).orderBy("step").collect()
    assert book[0].n - 3 == book[1].n == 7


def test_spread_ranks_and_only_partners(spark):
    from pyspark.sql import Window

    from pinfold.operators.cells import only_partner
    from pinfold.operators.ranking import spread_rank

    rng = random.Random(8)
    df = spark.createDataFrame([(rng.choice("abbbbb"), i, rng.randint(0, 5)) for i in range(500)], "k string, row_id long, x int").withColumn("run", F.floor(F.col("row_id") / 7))
    ours = spread_rank(df, ["k"], ["run"], ["row_id"], "nth").select("k", "row_id", "nth")
    theirs = df.select("k", "row_id", F.row_number().over(Window.partitionBy("k").orderBy("row_id")).cast("long").alias("nth"))
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, theirs.collect()))
    pairs = spark.createDataFrame([(1, 5), (2, 5), (2, 6)], "row_id long, r_row_id long")
    assert [tuple(r) for r in only_partner(pairs).collect()] == [(1, 5)]
