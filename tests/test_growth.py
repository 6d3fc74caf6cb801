"""What a row meets does not grow with the table, and the results are those of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from pinfold.functions import text as T
from pinfold.operators import cells as C
from pinfold.operators import covering as K
from pinfold.operators import dedupe, name_pairs, pair_counts
from pinfold.operators import polygons as G
from pinfold.operators import review as V
from pinfold.plans import moves as M
from pinfold.queries import places

PIN = "row_id long, name string, rel int, state string, lat double, lon double"
NAMES = ("Grace Bible Church", "Zion Temple North", "Bible Church Grace", "Hope Chapel", "Zion")


@pytest.fixture(scope="module")
def dense(spark):
    rng = random.Random(5)
    row = lambda i: (i, rng.choice(NAMES), rng.randint(0, 1), "PA", 40 + rng.randint(0, 900) / 1e5, -75 + rng.randint(0, 900) / 1e5)
    left, right = [row(i) for i in range(80)], [row(1000 + i) for i in range(1500)]
    left += [(90, "Zion", 0, "PA", 40.02, -75.0), (91, "Zion", 0, "PA", None, -75.0), (92, "Zion", 1, "PA", 41.0, -75.0)]
    return spark.createDataFrame(left, PIN).cache(), spark.createDataFrame(right, PIN).cache()


@pytest.fixture
def met(monkeypatch):
    """Pairs that distance joins give, in all."""
    seen, plain = [], C.distance_pairs

    def counted(*args, **options):
        out = plain(*args, **options)
        seen.append(out.count())
        return out

    for module in (C, V, dedupe):
        monkeypatch.setattr(module, "distance_pairs", counted)
    return seen


def listed(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_nearest_looks_no_farther_than_it_must(dense, met):
    left, right = dense
    got = listed(C.nearest_within(left, right, 2500.0, ["rel"]), "row_id", "r_row_id", "dist_m")
    few, every = sum(met), C.distance_pairs(left, right, 2500.0, ["rel"])
    assert got == listed(C.nearest(every), "row_id", "r_row_id", "dist_m")
    assert few * 10 < every.count()


def test_nearest_beyond_a_distance(dense):
    left, right = dense
    want = C.nearest(C.distance_pairs(left, right, 2500.0).where("dist_m >= 250"))
    assert listed(C.nearest_within(left, right, 2500.0, low_m=250.0), "row_id", "r_row_id") == listed(want, "row_id", "r_row_id")


def test_nearest_in_a_window(dense, met, monkeypatch):
    left, right = (df.select("row_id", "lat", "lon") for df in dense)
    plain, whole = C.cell_window_pairs, []
    monkeypatch.setattr(C, "cell_window_pairs", lambda mine, *rest: whole.append(mine.count()) or plain(mine, *rest))
    got = listed(C.nearest_in_window(left, right, 2, 50.0), "row_id", "r_row_id", "dist_m")
    assert got == listed(C.nearest(plain(left, right, 2, 50.0)), "row_id", "r_row_id", "dist_m")
    assert whole[0] <= 2


def test_pairs_are_counted_in_blocks(dense, monkeypatch):
    monkeypatch.setattr(pair_counts, "BLOCK", 200)
    right = dense[1].unionByName(dense[0])
    for low in (0.0, 250.0):
        p = C.distance_pairs(right, right, 1000.0, ["rel"]).where(f"row_id < r_row_id and dist_m >= {low}")
        near = "abs(floor(lat * 100) - floor(r_lat * 100)) <= 1 and abs(floor(lon * 100) - floor(r_lon * 100)) <= 1"
        assert tuple(pair_counts.count_pairs(right, low, 1000.0, ["rel"]).first()) == tuple(p.agg(F.count("*"), F.count_if(F.expr(near))).first())


def test_dealt_rows_are_never_broadcast(dense):
    # the file of a table says nothing of the rows it is dealt to: 221 for each at 6 km
    left, right = dense
    plan = C.distance_pairs(left.limit(3), right, 6000.0, ["rel"])._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_evidence_of_scorecards_is_never_broadcast(spark, dense, monkeypatch):
    # its files are small however many rows they hold, and the driver would hold these
    left, right = dense
    edges = spark.createDataFrame([("land", -76.0, 39.0, -76.0, 42.0), ("land", -74.0, 39.0, -74.0, 42.0)], "poly_id string, x1 double, y1 double, x2 double, y2 double")
    plans, plain = [], V.materialise
    told = lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString())
    monkeypatch.setattr(V, "materialise", lambda df, label: told(df) or plain(df, label))
    told(V.scorecard(left, right, right, edges, edges.where("false")))
    told(places.scorecard(spark, "/root/testdata/sf0.001"))
    joins = [line for p in plans for line in p.splitlines() if "Join [row_id" in line]
    assert len(joins) > 6 and [line for line in joins if "SortMergeJoin" not in line] == []


def test_names_meet_before_rows_do(dense, met, monkeypatch):
    left, right = (df.withColumn("t", T.tokens_b("name")) for df in dense)
    every = C.distance_pairs(left, right, 2500.0, ["rel"]).where(T.name_match("t", "r_t"))
    want = {r.row_id: min(r.n, 2) for r in every.groupBy("row_id").agg(F.count("*").alias("n")).collect()}
    for most in (1 << 20, 0):
        monkeypatch.setattr(name_pairs, "EVERY_NAME", most)
        met.clear()
        hits = C.nearest_within(*name_pairs.matching_names(left.drop("name"), right.drop("name"), 2500.0, T.name_match("t", "r_t")), 2500.0, ["rel", "t"], enough=2)
        assert {r.row_id: min(r.hits, 2) for r in hits.collect()} == want
        assert sum(met) * 4 < every.count()


def test_the_first_by_id(dense, met):
    left, right = dense
    got = listed(C.first_within(left, right, 2500.0), "row_id", "r_row_id")
    few, every = sum(met), C.distance_pairs(left, right, 2500.0)
    assert got == listed(every.groupBy("row_id").agg(F.min("r_row_id").alias("r_row_id")), "row_id", "r_row_id")
    assert few * 4 < every.count()


def test_blocked_moves_are_not_looked_at(dense, monkeypatch):
    left, right = dense
    looked, plain = [], M.nearest_within
    monkeypatch.setattr(M, "nearest_within", lambda ends, *rest, **options: looked.append(ends.count()) or plain(ends, *rest, **options))
    plan = left.where("lat is not null").select("row_id", "name", F.col("lat").alias("new_lat"), F.col("lon").alias("new_lon"), F.when(F.col("row_id") > 3, "x").alias("blocked"))
    out = {r.row_id: r.blocked for r in M.guard_near(plan, right, 300.0).collect()}
    assert looked == [4] and {out[k] for k in range(4)} == {"near_occupied"} and out[80 - 1] == "x"


def test_cells_are_connected_not_rows(dense, monkeypatch):
    given, plain = [], dedupe.connected_components
    monkeypatch.setattr(dedupe, "connected_components", lambda edges, **options: given.append(edges.count()) or plain(edges, **options))
    right = dense[1]
    got = {r.row_id: r.component for r in dedupe.near_clusters(right, 300.0, ["rel"]).collect()}
    links = C.distance_pairs(right, right, 300.0, ["rel"]).where("row_id < r_row_id").select(F.col("row_id").alias("src"), F.col("r_row_id").alias("dst"))
    want = {r.node: r.component for r in plain(links).collect()}
    assert got == {k: want.get(k, k) for k in got} and len(got) == 1500
    assert given[0] < 500 < links.count()


@pytest.fixture(scope="module")
def crossing(spark):
    """A ring whose edges cross each other everywhere, and points."""
    rng = random.Random(3)
    ends = [(rng.uniform(0, 0.2), rng.uniform(0, 0.2)) for _ in range(400)]
    edges = [("r", *a, *b) for a, b in zip(ends, [*ends[1:], ends[0]])]
    points = [(i, rng.uniform(0, 0.2), rng.uniform(0, 0.2)) for i in range(300)]
    return spark.createDataFrame(points, "row_id long, lat double, lon double"), spark.createDataFrame(edges, "poly_id string, x1 double, y1 double, x2 double, y2 double")


def test_crossing_edges_are_not_split_for_ever(crossing, monkeypatch):
    points, edges = crossing
    monkeypatch.setattr(K, "SPREAD", 4)
    cover = K.prepare(edges)
    assert cover.selectExpr("sum(size(edges))").first()[0] <= 400 * 4 * 8
    assert cover.selectExpr("max(size(edges))").first()[0] > K.MANY
    assert listed(K.containing_prepared(points, cover), "row_id", "poly_id") == listed(G.containing(points, edges), "row_id", "poly_id")


def test_borders_meet_in_blocks(crossing, monkeypatch):
    points, edges = crossing
    met, plain = [], G.arrow_map
    monkeypatch.setattr(G, "arrow_map", lambda df, *rest: met.append(df.count()) or plain(df, *rest))
    got = {r.row_id: r.deg for r in G.nearest_border(points, edges, 0.02).collect()}
    lines = [r[1:] for r in edges.collect()]
    for r in points.collect():
        best = 9.0
        for x1, y1, x2, y2 in lines:
            t = max(0.0, min(1.0, ((r.lon - x1) * (x2 - x1) + (r.lat - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
            best = min(best, ((r.lon - x1 - t * (x2 - x1)) ** 2 + (r.lat - y1 - t * (y2 - y1)) ** 2) ** 0.5)
        assert got.get(r.row_id, 9.0) == pytest.approx(best) or best >= 0.02
    assert sum(met) < 4000
