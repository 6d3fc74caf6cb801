import random

import pytest

from pinfold.functions import rules as R
from pinfold.functions.present import STATE_CODES, state_code
from pinfold.operators import report as P
from pinfold.operators import review as V
from pinfold.operators.dedupe import near_clusters
from pinfold.operators.polygons import canary, containing, edges_of, geojson_polygons, within_tolerance
from pinfold.operators.rollup import census_cube, upper_median
from pinfold.operators.sampling import far_and_random, first_rows, quota_sample
from pinfold.operators.token_sets import similar_sets
from pyspark.sql import functions as F

PIN = "row_id long, name string, rel int, lat double, lon double, state string"


def pins(spark, rows):
    return spark.createDataFrame(rows, PIN)


def test_candidates_literal_cases(spark):
    mapped = pins(spark, [(5, "Grace Bible Fellowship", 0, 40.0, -75.0, "PA"), (3, "Grace Bible Fellowship", 0, 40.001, -75.0, "PA"), (9, "The Inc", 0, 41.0, -75.0, "PA"), (8, "Hope Lutheran Church", 0, 42.0, -75.0, "PA")])
    got = V.match_candidates(
        pins(spark, [
            (1, "Grace Bible Fellowshp", 0, 40.0, -75.0, "PA"), (2, "Riverside Cemetery", 0, 40.0, -75.0, "PA"), (3, "Grace Church", 0, None, -75.0, "PA"),
            (4, "LLC Inc", 0, 41.0, -75.0, "PA"), (5, "Zion Chapel", 0, 42.0004, -75.0, "PA"), (6, "Hope Lutheran Church", 0, 42.01, -75.0, "PA"),
        ]), mapped,
    ).orderBy("row_id").collect()
    # the first similar row by id, not the nearest; a differently named neighbour is appended
    assert [(r.action, r.other) for r in got] == [("MATCH_EXISTING", 3), ("FILTER_DROP", None), ("GEOCODE_FAIL", None), (got[3].action, got[3].other), ("APPEND_CANDIDATE", None), ("APPEND_CANDIDATE", None)]
    empty = V.match_candidates(pins(spark, [(1, "The", 0, 41.0, -75.0, "PA")]), pins(spark, [(7, "Inc", 0, 41.0, -75.0, "PA")])).first()
    assert empty.action in ("STACK_DUP", "APPEND_CANDIDATE")


def test_scorecard_buckets_and_blocked_snaps(spark):
    square = [[[-80.0, 39.0], [-74.0, 39.0], [-74.0, 43.0], [-80.0, 43.0], [-80.0, 39.0]]]
    lake = [[[-75.2, 40.4], [-75.1, 40.4], [-75.1, 40.5], [-75.2, 40.5], [-75.2, 40.4]]]
    shapes = spark.createDataFrame([("land", square), ("lake", lake)], "poly_id string, rings array<array<array<double>>>")
    e = edges_of(shapes)
    gaps = pins(spark, [
        (1, "Acme Realty LLC", 0, 40.0, -75.0, "PA"),  # junk
        (2, "Saint Paul Lutheran", 0, 40.1, -75.0, "PA"),  # twin of the directory
        (3, "Any Hall", 0, 40.2, -75.0, "PA"),  # on a building
        (4, "Mount Zion Gospel", 0, 40.3, -75.0, "PA"),  # one building of the name nearby
        (5, "Grace Gospel Hall", 0, 41.3, -75.0, "PA"), (6, "Grace Gospel Hall", 0, 41.3, -75.05, "PA"),  # both to one building
        (7, "Lonely Hall", 0, 40.45, -75.15, "PA"), (8, "Sea Hall", 0, 35.0, -75.0, "PA"), (9, "Rural Hall", 0, 42.0, -75.0, "PA"),
    ])
    directory = pins(spark, [(100, "St Paul Lutheran", 0, 40.105, -75.0, "PA")])
    areas = pins(spark, [(200, "Other", 0, 40.2003, -75.0, "PA"), (201, "Mount Zion Gospel", 0, 40.35, -75.0, "PA"), (202, "Grace Gospel Hall", 0, 41.35, -75.0, "PA")])
    got = {r.row_id: (r.bucket, r.detail) for r in V.scorecard(gaps, directory, areas, e.where("poly_id = 'land'"), e.where("poly_id = 'lake'")).collect()}
    assert got[1][0] == "name_junk" and got[2] == ("hifld_dupe", "100") and got[3] == ("on_building", "200") and got[4] == ("local_snap", "201")
    assert got[5] == got[6] == ("rural_expected", "shared_destination")
    assert got[7] == ("impossible", "in-lake") and got[8] == ("impossible", "not-on-land") and got[9] == ("rural_expected", None)
    assert len(got) == 9


def test_reports_orders_and_rendering(spark):
    r = spark.createDataFrame([("1", "a", 1, 9, 8, ""), ("2", "a", 5, 2, -3, "x"), ("3", "b", 0, 8, 8, "wards")], "fips string, rel string, mapped int, census int, gap int, note string")
    assert [x.fips for x in P.by_gap(P.report_filter(r)).collect()] == ["1", "3", "2"] and P.by_gap(r, over=True).first().fips == "2"
    assert P.report_filter(r, rel="a", least_gap=4).count() == 1 and P.report_filter(r, without_note="wards").count() == 2
    totals = {x.rel: x for x in P.gap_totals(r, "rel").collect()}
    assert (totals["a"].positive_gap, totals["a"].difference) == (8, 5)
    assert {x.rel: x.counts for x in P.nested_counts(r, "rel", "note").collect()} == {"a": {"": 1, "x": 1}, "b": {"wards": 1}}
    text = P.markdown_report("Gaps", {"rows": 3}, {"All": r.select("fips", "note").orderBy("fips")}, most=2)
    assert text == "# Gaps\n\n* rows: 3\n\n## All\n\n| fips | note |\n| --- | --- |\n| 1 |  |\n| 2 | x |\n\nThe first 2 rows.\n"
    meta = P.noted({"source": "s"}, r, "rel", "twins", " - twins")
    assert meta == {"source": "s - twins", "n": 3, "by": {"a": 2, "b": 1}} and P.noted(meta, r, "rel", "twins", " - twins")["source"] == "s - twins"
    moves = spark.createDataFrame([(1, "b", "PA", 5.0), (2, "A", "PA", 9.0), (3, "c", "AL", 9.0)], "row_id long, name string, state string, move_m double")
    assert [x.row_id for x in P.by_move(moves).collect()] == [3, 2, 1] and [x.row_id for x in P.by_state_and_name(moves).collect()] == [3, 2, 1]


def test_samples_and_cube(spark):
    df = spark.range(200).selectExpr("id as row_id", "id % 3 as b", "id % 7 as s", "cast(id as double) as m")
    picked = far_and_random(df, "m", 10, 10, 5).collect()
    assert {r.row_id for r in picked if r.pick == "far"} == set(range(190, 200)) and len({r.row_id for r in picked}) == 20
    assert [r.row_id for r in first_rows(df.orderBy("m", ascending=False), 3).collect()] == [0, 1, 2]
    assert [r.b for r in quota_sample(df, "b", {0: 4, 2: 2}, "s", 1).orderBy("b").collect()] == [0] * 4 + [2] * 2
    assert quota_sample(df, "b", {}, "s", 1).count() == 0
    groups = spark.createDataFrame([("1001.0", "AL", 0, 4), ("01001", "AL", 1, 2), ("abc", "AL", 0, 9), ("2001", None, 0, 1), ("2001", "AK", 0, 0)], "fips string, state string, pos int, n long")
    got = {(r.level, r.key): r.counts for r in census_cube(groups, 2).collect()}
    assert got == {("county", "01001"): [4, 2], ("county", "02001"): [1, 0], ("state", "AL"): [4, 2], ("country", ""): [5, 2]}


def test_medians_of_skewed_values_and_texts(spark):
    rng = random.Random(2)
    values = [rng.random() for _ in range(3000)] + [1e300, -1e300]
    df = spark.createDataFrame([("k", v, f"t{v:.6f}") for v in values] + [("one", 5.0, "x"), ("none", None, None)], "k string, v double, t string")
    got = {r.k: (r.upper_median, r.n) for r in upper_median(df, ["k"], "v").collect()}
    assert got == {"k": (sorted(values)[1501], 3002), "one": (5.0, 1)}
    assert {r.k: r.upper_median for r in upper_median(df, ["k"], "t").collect()}["k"] == sorted(f"t{v:.6f}" for v in values)[1501]


def test_dense_places_and_token_joins_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "n", 0, 40.0, -75.0, "PA") for i in range(300)] + [(300 + i, "n", 0, 40 + rng.random() * 0.004, -75 + rng.random() * 0.02, "PA") for i in range(120)] + [(900, "n", 0, None, None, "PA")]
    got = {r.row_id: r.component for r in near_clusters(pins(spark, rows), 100.0, ["rel"]).collect()}
    group = {r[0]: r[0] for r in rows}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    flat = [r for r in rows if r[3] is not None]
    for a in flat:
        for b in flat:
            if a[0] < b[0] and ((a[3] - b[3]) * 111194.93) ** 2 + ((a[4] - b[4]) * 111194.93 * 0.76604) ** 2 <= 100.0**2:
                p, q = find(a[0]), find(b[0])
                group[max(p, q)] = min(p, q)
    assert sum(got[r[0]] != find(r[0]) for r in rows) <= 2  # pairs at the very edge of the radius
    sets = spark.createDataFrame([(f"n{i}", sorted({f"T{rng.randint(0, 12)}" for _ in range(rng.randint(1, 6))})) for i in range(60)], "name string, t array<string>")
    data = {r.name: set(r.t) for r in sets.collect()}
    want = set()
    for a, s in data.items():
        for b, u in data.items():
            if a < b and (len(s & u) / len(s | u) >= 0.5 or len(s) >= 2 and len(u) >= 2 and (s <= u or u <= s)):
                want.add((a, b))
    assert {(r.name, r.r_name) for r in similar_sets(sets, "name", "t", 0.5).collect()} == want


def test_collections_empty_rings_tolerance_and_canary(spark):
    square = "[[[0,0],[2,0],[2,2],[0,2],[0,0]]]"
    text = (
        '{"features":[{"properties":{"id":"c","s":"S","c":"C"},"geometry":{"type":"GeometryCollection","geometries":[{"type":"Polygon","coordinates":%s},{"type":"Point","coordinates":[1,1]},'
        '{"type":"MultiPolygon","coordinates":[[[[5,5],[6,5],[6,6],[5,5]]]]}]}},{"properties":{"id":"flat"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[2,0],[0,0]]]}}]}' % square
    )
    shapes = geojson_polygons(spark, spark.createDataFrame([(text,)], "value string"))
    assert [(r.poly_id, len(r.rings)) for r in shapes.collect()] == [("c", 2)]
    e = edges_of(shapes)
    points = pins(spark, [(1, "", 0, 1.0, 1.0, ""), (2, "", 0, 1.0, 2.00005, ""), (3, "", 0, 1.0, 2.1, ""), (4, "", 0, 5.2, 5.5, "")])
    assert sorted(r.row_id for r in containing(points, e).collect()) == [1, 4] and sorted(r.row_id for r in within_tolerance(points, e).collect()) == [1, 2, 4]
    canary(e, 1.0, 1.0, "c")
    with pytest.raises(ValueError):
        canary(e, 9.0, 9.0, "c")


def test_rules_and_state_codes(spark):
    df = spark.createDataFrame([("", "jewish", "Old Abbey"), ("Paris", "jewish", "x"), (None, "muslim", None)], "city string, rel string, name string")
    assert [(r.o, r.k) for r in df.select(R.provenance("city", "rel").alias("o"), R.landmark("name").alias("k")).collect()] == [("gap", True), ("directory", False), (None, False)]
    assert STATE_CODES["Delaware"] == "DE" and STATE_CODES["District of Columbia"] == "DC" and len(STATE_CODES) == 51
    assert df.select(state_code(F.lit("district-of-columbia")).alias("c")).first().c == "DC"
    rows = spark.createDataFrame([(1, "GRACE CHURCH", "", 40.123456, -75.0, "PA", "NEW YORK"), (2, "Shop", "", 40.0, -75.0, "PA", ""), (3, "Grace", "X20", 0.0, 0.0, "PA", "")], "row_id long, name string, code string, lat double, lon double, state string, city string")
    got = R.baked(rows).orderBy("row_id").collect()
    assert (got[0].name, got[0].lat, got[0].city) == ("Grace Church", 40.12346, "New York") and [r["class"] for r in got] == ["christian", "unclassified", "skipped"]


def test_medians_of_hot_keys_ties_and_odd_numbers(spark):
    rng = random.Random(7)
    rows = [("hot", float(rng.randint(0, 5000)), i) for i in range(40_000)] + [("ties", 2.0, i) for i in range(999)] + [("ties", 1.0, i) for i in range(5)]
    rows += [("nan", float("nan"), i) for i in range(6)] + [("nan", 1.0, 1), ("inf", float("-inf"), 1), ("inf", float("inf"), 2), (None, 3.0, 5), (None, 1.0, 4)]
    df = spark.createDataFrame(rows, "k string, v double, i int").repartition(7)
    got = {r.k: (str(r.upper_median), r.n) for r in upper_median(df, ["k"], "v").collect()}
    for k in {r[0] for r in rows}:
        values = sorted((r[1] for r in rows if r[0] == k), key=lambda v: (v != v, v))
        assert got[k] == (str(values[len(values) // 2]), len(values))
    ties = sorted(r[2] for r in rows if r[0] == "ties")
    assert {r.k: r.upper_median for r in upper_median(df, ["k"], "i").collect()}["ties"] == ties[len(ties) // 2]


def test_scorecard_is_planned_once(spark, monkeypatch):
    plans = []
    for name in ("materialise",):
        real = getattr(V, name)
        monkeypatch.setattr(V, name, lambda df, label, real=real: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, label))
    rows = [(i, f"Hall {i % 3} of Zion", 0, 40 + i * 0.01, -75.0, "PA") for i in range(40)]
    square = spark.createDataFrame([("land", [[[-80.0, 39.0], [-74.0, 39.0], [-74.0, 43.0], [-80.0, 43.0], [-80.0, 39.0]]])], "poly_id string, rings array<array<array<double>>>")
    out = V.scorecard(pins(spark, rows), pins(spark, rows[:9]), pins(spark, rows[20:]), edges_of(square), edges_of(square).limit(0))
    assert len({r.row_id for r in out.collect()}) == 40
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    # final and initial plans are both told; either half is below the bound
    assert len(plans) == 4 and sum(p.count("Exchange ") for p in plans) / 2 < 60
