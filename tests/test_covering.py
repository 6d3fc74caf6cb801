import math
import random

import pytest

from pinfold.operators import covering as K
from pinfold.operators import polygons as G


def ring(rng, cx, cy, r, n):
    """A star around a centre, sometimes with a horizontal and a vertical side."""
    pts = [[cx + r * rng.uniform(0.3, 1) * math.cos(2 * math.pi * k / n), cy + r * rng.uniform(0.3, 1) * math.sin(2 * math.pi * k / n)] for k in range(n)]
    pts[1][1], pts[n // 2][0] = pts[0][1], pts[n // 2 - 1][0]
    return [*pts, pts[0]]


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(8)
    polys = [(f"p{k:02}", [ring(rng, rng.uniform(-3, 3), rng.uniform(-3, 3), rng.choice([0.05, 0.4, 1.5]), rng.choice([5, 40, 300]))]) for k in range(14)]
    polys.append(("box", [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]], [[0.25, 0.25], [0.5, 0.25], [0.5, 0.5], [0.25, 0.5], [0.25, 0.25]]]))
    edges = G.edges_of(spark.createDataFrame(polys, "poly_id string, rings array<array<array<double>>>"))
    pts = [(i, rng.uniform(-4, 4), rng.uniform(-4, 4)) for i in range(3000)]
    corners = [p for _, rings in polys for r in rings for p in r]
    pts += [(5000 + i, p[1], p[0]) for i, p in enumerate(corners)]
    pts += [(9000 + i, 0.1 * (i % 11), 0.1 * (i // 11)) for i in range(121)] + [(9999, None, 1.0), (9998, 2.0, None)]
    return spark.createDataFrame(pts, "row_id long, lat double, lon double"), edges


def test_same_rows_as_without_the_covering(world):
    points, edges = world
    want = sorted(map(tuple, G.containing(points, edges).collect()))
    assert len(want) > 800
    for most in (4, 8):
        assert sorted(map(tuple, K.containing_prepared(points, K.prepare(edges, most)).collect())) == want


def test_points_meet_few_edges(world):
    points, edges = world
    cover = K.prepare(edges)
    assert cover.selectExpr("max(size(edges))").first()[0] <= K.MOST_EDGES
    met = K.met_cells(points, cover).groupBy("row_id", "poly_id").count()
    # one cell of a polygon at most, so eight edges of it at most
    assert met.selectExpr("max(count)").first()[0] == 1
    inner = cover.where("size(edges) = 0").count()
    assert inner > 200 and cover.where("size(edges) = 0 and not odd").count() == 0


def test_no_polygon_and_no_point(world):
    points, edges = world
    assert K.containing_prepared(points, K.prepare(edges.limit(0))).count() == 0
    assert K.containing_prepared(points.limit(0), K.prepare(edges)).count() == 0
    # a polygon without an area touches only what lies on it
    flat = points.sparkSession.createDataFrame([("f", 0.1, 0.1, 0.2, 0.1), ("f", 0.2, 0.1, 0.1, 0.1)], "poly_id string, x1 double, y1 double, x2 double, y2 double")
    got = K.containing_prepared(points, K.prepare(flat)).collect()
    assert sorted(r.row_id for r in got) == sorted(r.row_id for r in G.containing(points, flat).collect())


def test_nearest_border_against_brute_force(world):
    points, edges = world
    rows, segments = points.collect(), edges.collect()

    def distance(p, e):
        dx, dy = e.x2 - e.x1, e.y2 - e.y1
        t = 0 if dx == dy == 0 else max(0, min(1, ((p.lon - e.x1) * dx + (p.lat - e.y1) * dy) / (dx * dx + dy * dy)))
        return math.hypot(p.lon - e.x1 - t * dx, p.lat - e.y1 - t * dy)

    some = [p for p in rows if p.lat is not None and p.lon is not None][::23]
    want = {}
    for p in some:
        near = min((math.floor(distance(p, e) * 1e9 + 0.5), e.poly_id, distance(p, e)) for e in segments)
        if near[2] < 0.3:
            want[p.row_id] = near[1:]
    for reach in (0.3,):
        got = {r.row_id: (r.poly_id, r.deg) for r in G.nearest_border(points.where(points.row_id.isin([p.row_id for p in some])), edges, reach).collect()}
        assert got.keys() == want.keys() and len(got) > 40
        assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in got)


def test_borders_meet_points_by_both_axes(world, monkeypatch):
    points, edges = world
    plans = []
    real = G.materialise
    monkeypatch.setattr(G, "materialise", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, label))
    G.nearest_border(points, edges, 0.1).count()
    joins = [line for plan in plans for line in plan.splitlines() if "Join" in line and "cy" in line]
    assert joins and all("cx" in line for line in joins)
    assert not any("NestedLoop" in plan or "Cartesian" in plan for plan in plans)


def test_a_long_edge_is_dealt_along_its_way(spark):
    e = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 1.0), ("b", 0.0, 0.5, 1.0, 0.5), ("c", 0.5, 0.0, 0.5, 1.0)], "poly_id string, x1 double, y1 double, x2 double, y2 double")
    n = {r.poly_id: r["count"] for r in G._dealt(e, 0.01).groupBy("poly_id").count().collect()}
    assert n["a"] <= 420 and n["b"] <= 210 and n["c"] <= 210
