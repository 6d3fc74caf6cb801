"""Queries on pins: matching, duplicates, plans, polygons, roll-ups, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pinfold.functions import rules as R
from pinfold.functions import text as T
from pinfold.functions.geo import cell, coord_key, haversine_m, rounded, zoom_size
from pinfold.functions.hashing import hash01
from pinfold.functions.rules import drop_reason, first_of, near_score, stack_score
from pinfold.operators.cells import distance_pairs, nearest, nearest_in_window, nearest_within, without_near
from pinfold.operators.dedupe import best_of, near_dedupe
from pinfold.operators.name_pairs import matching_names
from pinfold.operators.pair_counts import count_pairs
from pinfold.operators.polygons import assign, containing, edges_of, ring_stats
from pinfold.operators.rollup import count_vectors, gap_report, levels, vector_total
from pinfold.operators.sampling import click_stack, fill_quota
from pinfold.plans import moves as M
from pinfold.queries.names import _REASON, sql_says, sql_tokens
from pinfold.queries.pins import edges_sql, hav, nation_edges_sql, nation_rings, pins, pins_sql, polygons, round_sql
from pinfold.runtime import materialise, shuffled, table

C, S = pins_sql(), pins_sql("supplier")


# roll-ups ---------------------------------------------------------------------------------


def rollup_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered pins, rolled up to all, regions and nations."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    p = pins(spark, sf_dir).where("rel in (0, 1, 2, 4)").join(n.select(F.col("n_name").alias("state"), F.col("r_name").alias("region")), "state")
    return levels(p, "region", "state", {"n": F.count("*"), "classes": F.count_distinct("rel")})


ROLLUP_FOCUS = f"""
WITH p AS (SELECT p.*, r_name AS region FROM {C} p JOIN nation ON n_name = state JOIN region ON r_regionkey = n_regionkey WHERE rel IN (0, 1, 2, 4))
SELECT CASE WHEN grouping(region) = 1 THEN 0 WHEN grouping(state) = 1 THEN 1 ELSE 2 END AS level, region, state, count(*) AS n, count(DISTINCT rel) AS classes
FROM p GROUP BY GROUPING SETS ((), (region), (region, state))"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).selectExpr("lpad(cast(c_nationkey as string), 5, '0') AS fips", "cast(substring(o_orderpriority, 1, 1) as int) - 1 AS pos", "cast(1 as bigint) AS amount")
    return count_vectors(j, ["fips"], "pos", 5, "amount")


def census_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("fips", *[F.element_at("counts", i + 1).alias(f"c{i}") for i in range(5)]).orderBy("fips")


_V = "(SELECT lpad(c_nationkey::VARCHAR, 5, '0') AS fips, " + ", ".join(f"count(*) FILTER (left(o_orderpriority, 1) = '{i + 1}') AS c{i}" for i in range(5)) + " FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)"
CENSUS_VECTORS = f"SELECT * FROM {_V}"


def vector_subset_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_total(_vectors(spark, sf_dir), [1, 3]).select("fips", "total")


VECTOR_SUBSET_TOTAL = f"SELECT fips, c1 + c3 AS total FROM {_V} WHERE c1 + c3 > 0"


def viewport_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pins(spark, sf_dir).where(F.col("lat").between(40.05, 40.12) & F.col("lon").between(-74.95, -74.8) & F.col("rel").isin(0, 3, 5))
    return p.select("row_id", "rel", cell("lat", 5.0).alias("ci"), cell("lon", 5.0).alias("cj"))


VIEWPORT = f"SELECT row_id, rel, floor(lat * 5e0)::BIGINT AS ci, floor(lon * 5e0)::BIGINT AS cj FROM {C} WHERE lat BETWEEN 40.05e0 AND 40.12e0 AND lon BETWEEN -74.95e0 AND -74.8e0 AND rel IN (0, 3, 5)"


def _nation_counts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = table(spark, sf_dir, "nation")
    mapped = pins(spark, sf_dir).where("rel <> 4").groupBy("state").agg(F.count("*").alias("n"))
    counted = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("state")).agg((F.count("*") * 16).alias("n"))
    return mapped, counted


def county_gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = gap_report(*_nation_counts(spark, sf_dir), ["state"])
    note = first_of([((F.col("state") == "NATION_8") & (F.col("gap") > 5), "lds-wards-vs-buildings")], "")
    return r.withColumn("note", note).withColumn("positive", F.greatest("gap", F.lit(0)))


_GAPS = f"""(SELECT state, coalesce(m.n, 0) AS mapped, coalesce(c.n, 0) AS census, coalesce(c.n, 0) - coalesce(m.n, 0) AS gap,
  floor((coalesce(c.n, 0) - coalesce(m.n, 0)) * 1000e0 / nullif(coalesce(c.n, 0), 0) + 0.5) / 10e0 AS pct
FROM (SELECT state, count(*) AS n FROM {C} WHERE rel <> 4 GROUP BY 1) m
FULL JOIN (SELECT n_name AS state, count(*) * 16 AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) c USING (state))"""
COUNTY_GAP = f"SELECT *, CASE WHEN state = 'NATION_8' AND gap > 5 THEN 'lds-wards-vs-buildings' ELSE '' END AS note, greatest(gap, 0) AS positive FROM {_GAPS}"


def top_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gap_report(*_nation_counts(spark, sf_dir), ["state"]).where("gap > 0").orderBy(F.desc("gap"), "state").limit(5)


TOP_GAP = f"SELECT * FROM {_GAPS} WHERE gap > 0 ORDER BY gap DESC, state LIMIT 5"


# distance joins ---------------------------------------------------------------------------


def grid_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = (pins(spark, sf_dir, side).select("row_id", "rel", "lat", "lon") for side in ("supplier", "customer"))
    return nearest_within(s, c, 1000.0, ["rel"]).select("row_id", F.col("r_row_id").alias("other"), rounded("dist_m", 3).alias("m"))


_PAIR = lambda a, b, r, more="": f"""(SELECT a.row_id, a.name, b.row_id AS other, b.name AS o_name, a.state, b.state AS o_state, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS m, a.lat, a.lon, b.lat AS o_lat, b.lon AS o_lon
  FROM {a} a JOIN {b} b ON a.rel = b.rel AND abs(a.lat - b.lat) <= {r / 111000} {more} WHERE {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= {r}e0)"""  # noqa: E731
_MM = "floor(m * 1000 + 0.5)"
GRID_NEAREST = f"SELECT row_id, other, {round_sql('m', 3)} AS m FROM {_PAIR(S, C, 1000)} QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY {_MM}, other) = 1"


def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory pins, and the external pins that have none of their class within 250 m and
    whose name is kept, rolled up by state."""
    c, s = pins(spark, sf_dir), pins(spark, sf_dir, "supplier")
    gaps = without_near(s, c, 250.0, ["rel"]).where(drop_reason("name").isNull())
    every = c.withColumn("origin", F.lit("directory")).unionByName(gaps.withColumn("origin", F.lit("gap")))
    return levels(every, "state", "origin", {"n": F.count("*")})


GAP_FILL = f"""
WITH g AS (SELECT * FROM {S} s WHERE NOT EXISTS (SELECT 1 FROM {C} c WHERE c.rel = s.rel AND abs(c.lat - s.lat) <= 0.003 AND {hav('s.lat', 's.lon', 'c.lat', 'c.lon')} <= 250e0) AND {_REASON} IS NULL),
e AS (SELECT state, 'directory' AS origin FROM {C} UNION ALL SELECT state, 'gap' FROM g)
SELECT CASE WHEN grouping(state) = 1 THEN 0 WHEN grouping(origin) = 1 THEN 1 ELSE 2 END AS level, state, origin, count(*) AS n FROM e GROUP BY GROUPING SETS ((), (state), (state, origin))"""


def band_dupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a class 250 to 1000 m apart, by both neighbourhoods, and those alike by name."""
    c = pins(spark, sf_dir).select("row_id", T.tokens_a("name").alias("t"), "rel", "lat", "lon")
    every = count_pairs(c, 250.0, 1000.0, ["rel"]).select("pairs", "adjacent")
    mine, other = matching_names(c, c, 1000.0, (T.jaccard("t", "r_t") >= 0.7) | (F.col("t") == F.col("r_t")))
    met = distance_pairs(mine, other, 1000.0, ["rel", "t"]).where((F.col("row_id") < F.col("r_row_id")) & (F.col("dist_m") >= 250.0))
    adjacent = (F.abs(cell("lat", 100.0) - cell("r_lat", 100.0)) <= 1) & (F.abs(cell("lon", 100.0) - cell("r_lon", 100.0)) <= 1)
    both = every.crossJoin(met.agg(F.count("*").alias("alike"), F.count_if(adjacent).alias("alike_adjacent")))
    return both.select(F.inline(F.array(F.struct(F.lit("radius").alias("mode"), "pairs", "alike"), F.struct(F.lit("3x3").alias("mode"), F.col("adjacent").alias("pairs"), F.col("alike_adjacent").alias("alike")))))


_TA, _TB = sql_tokens("name", T.SAME_A, T.STOP_A), sql_tokens("o_name", T.SAME_A, T.STOP_A)
BAND_DUPE = f"""
WITH p AS (SELECT *, {_TA} AS ta, {_TB} AS tb FROM {_PAIR(C, C, 1000, 'AND a.row_id < b.row_id')} WHERE m >= 250e0),
q AS (SELECT *, (len(ta) > 0 AND len(tb) > 0 AND len(list_intersect(ta, tb))::DOUBLE / len(list_distinct(list_concat(ta, tb))) >= 0.7e0) OR ta = tb AS alike,
  abs(floor(lat * 100e0) - floor(o_lat * 100e0)) <= 1 AND abs(floor(lon * 100e0) - floor(o_lon * 100e0)) <= 1 AS adjacent FROM p)
SELECT 'radius' AS mode, count(*) AS pairs, count(*) FILTER (alike) AS alike FROM q UNION ALL SELECT '3x3', count(*) FILTER (adjacent), count(*) FILTER (adjacent AND alike) FROM q"""


def nearest_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = nearest_in_window(pins(spark, sf_dir, "supplier").select("row_id", "lat", "lon"), pins(spark, sf_dir).select("row_id", "lat", "lon"), 2, 50.0)
    return p.select("row_id", F.col("r_row_id").alias("other"), rounded("dist_m", 3).alias("m"))


NEAREST_WINDOW = f"""
WITH p AS (SELECT a.row_id, b.row_id AS other, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS m FROM {S} a JOIN {C} b
  ON abs(floor(a.lat * 50e0) - floor(b.lat * 50e0)) <= 2 AND abs(floor(a.lon * 50e0) - floor(b.lon * 50e0)) <= 2)
SELECT row_id, other, {round_sql('m', 3)} AS m FROM p QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY {_MM}, other) = 1"""


def shared_token_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = (pins(spark, sf_dir, side).select("row_id", "rel", F.explode(T.tokens_c("name")).alias("token"), "lat", "lon") for side in ("supplier", "customer"))
    # rows that share several tokens meet once for each, which changes no nearest
    return nearest_within(s, c, 2000.0, ["rel", "token"]).select("row_id", F.col("r_row_id").alias("other"), rounded("dist_m", 0).cast("long").alias("m"))


def _tc(name: str) -> str:
    return f"list_filter(regexp_extract_all(lower({name}), '[a-z0-9'']+'), lambda x: length(x) >= 3 AND x NOT IN ({', '.join(chr(39) + s + chr(39) for s in T.STOP_C)}))"


SHARED_TOKEN = f"""SELECT row_id, other, floor(m + 0.5)::BIGINT AS m FROM {_PAIR(S, C, 2000)} WHERE list_has_any({_tc('name')}, {_tc('o_name')})
QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY {_MM}, other) = 1"""


# unique matches ---------------------------------------------------------------------------


def unique_name_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External pins whose state and tokens exactly one directory pin has."""
    c, s = pins(spark, sf_dir), pins(spark, sf_dir, "supplier")
    key = lambda d: d.withColumn("key", F.array_join(T.tokens_a("name"), " ")).where("key <> ''")
    other = key(c).groupBy("state", "key").agg(F.count("*").alias("n"), F.min("row_id").alias("other")).where("n = 1")
    return key(s).join(other, ["state", "key"]).select("row_id", "other", "key")


_KEY = f"array_to_string({sql_tokens('name', T.SAME_A, T.STOP_A)}, ' ')"
UNIQUE_NAME = f"""
WITH c AS (SELECT state, {_KEY} AS key, min(row_id) AS other FROM {C} GROUP BY 1, 2 HAVING count(*) = 1)
SELECT s.row_id, c.other, c.key FROM (SELECT *, {_KEY} AS key FROM {S}) s JOIN c ON c.state = s.state AND c.key = s.key WHERE c.key <> ''"""


def local_unique_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snap: one same-named pin of the state at 1.5 to 10 km; review: none, but one farther."""
    c, s = pins(spark, sf_dir), pins(spark, sf_dir, "supplier")
    key = lambda d: d.withColumn("key", F.array_join(T.tokens_a("name"), " ")).where("key <> ''").select("row_id", "state", "key", "lat", "lon")
    o = key(c)
    met = key(s).join(o.select("state", "key", *[F.col(x).alias(f"r_{x}") for x in ("row_id", "lat", "lon")]), ["state", "key"])

    met = met.withColumn("m", haversine_m("lat", "lon", "r_lat", "r_lon")).where("m >= 1500")
    g = met.groupBy("row_id").agg(F.count_if(F.col("m") <= 10000).alias("near"), F.count("*").alias("n"), F.min(F.when(F.col("m") <= 10000, F.col("r_row_id"))).alias("snap"), F.min("r_row_id").alias("far"))
    return g.select("row_id", first_of([(F.col("near") == 1, "snap"), ((F.col("near") == 0) & (F.col("n") == 1), "review")], "none").alias("action"), F.when(F.col("near") == 1, F.col("snap")).when((F.col("near") == 0) & (F.col("n") == 1), F.col("far")).alias("other"))


LOCAL_UNIQUE = f"""
WITH p AS (SELECT a.row_id, b.row_id AS other, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS m FROM (SELECT *, {_KEY} AS key FROM {S}) a JOIN (SELECT *, {_KEY} AS key FROM {C}) b ON a.state = b.state AND a.key = b.key AND a.key <> ''),
g AS (SELECT row_id, count(*) FILTER (m <= 10000) AS near, count(*) AS n, min(other) FILTER (m <= 10000) AS snap, min(other) AS far FROM p WHERE m >= 1500 GROUP BY 1)
SELECT row_id, CASE WHEN near = 1 THEN 'snap' WHEN near = 0 AND n = 1 THEN 'review' ELSE 'none' END AS action, CASE WHEN near = 1 THEN snap WHEN near = 0 AND n = 1 THEN far END AS other FROM g"""


def fuzzy_snap_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why an external pin does or does not snap to the one matching pin within 1.5 km."""
    s = pins(spark, sf_dir, "supplier").withColumn("t", T.tokens_b("name"))
    mine, c = matching_names(s.select("row_id", "t", "rel", "lat", "lon"), pins(spark, sf_dir).select("row_id", T.tokens_b("name").alias("t"), "rel", "lat", "lon"), 1500.0, T.name_match("t", "r_t"))
    hits = nearest_within(mine, c, 1500.0, ["rel", "t"], enough=2).select("row_id", "hits", F.col("dist_m").alias("m"))
    reason = first_of([(F.size("t") < 2, "few_tokens"), (R.says("name", R.ADMIN_PINS), "admin_name"), (F.col("hits").isNull(), "no_match"), (F.col("hits") > 1, "not_unique"), (F.col("m") < 15, "already_there")], "snap")
    return s.join(hits, "row_id", "left").select("row_id", reason.alias("reason"))


_B1, _B2 = sql_tokens("name", T.SAME_B, T.STOP_B), sql_tokens("o_name", T.SAME_B, T.STOP_B)
FUZZY_SNAP = f"""
WITH p AS (SELECT *, {_B1} AS t, {_B2} AS o FROM {_PAIR(S, C, 1500)}),
h AS (SELECT row_id, count(*) AS hits, min(m) AS m FROM p WHERE len(t) >= 2 AND len(o) >= 2 AND (len(list_intersect(t, o))::DOUBLE / len(list_distinct(list_concat(t, o))) >= 0.8e0
  OR len(list_intersect(t, o)) = len(t) OR len(list_intersect(t, o)) = len(o)) GROUP BY 1)
SELECT s.row_id, CASE WHEN len({_B1}) < 2 THEN 'few_tokens' WHEN {sql_says('name', R.ADMIN_PINS)} THEN 'admin_name' WHEN hits IS NULL THEN 'no_match' WHEN hits > 1 THEN 'not_unique' WHEN m < 15 THEN 'already_there' ELSE 'snap' END AS reason
FROM {S} s LEFT JOIN h ON h.row_id = s.row_id"""


def exact_coord_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pins of orders joined to customers of the same 5-decimal place, the same name first."""
    a = pins(spark, sf_dir).select("row_id", "name", coord_key("lat").alias("la"), coord_key("lon").alias("lo"))
    b = pins(spark, sf_dir).select(F.col("row_id").alias("other"), F.upper("name").alias("o_name"), coord_key("lat").alias("la"), coord_key("lon").alias("lo"), "rel").where("rel <> 1")
    met = a.join(b, ["la", "lo"])
    best = met.groupBy("row_id", "la", "lo").agg(F.min_by("other", F.struct((F.upper("name") != F.col("o_name")).alias("ne"), F.col("other"))).alias("other"))
    return best


EXACT_COORD = f"""
WITH p AS (SELECT *, floor(lat * 100000e0 + 0.5)::BIGINT AS la, floor(lon * 100000e0 + 0.5)::BIGINT AS lo FROM {C})
SELECT a.row_id, a.la, a.lo, arg_min(b.row_id, (upper(a.name) <> upper(b.name))::BIGINT * 1000000000000 + b.row_id) AS other FROM p a JOIN p b ON a.la = b.la AND a.lo = b.lo AND b.rel <> 1 GROUP BY 1, 2, 3"""


# plans ------------------------------------------------------------------------------------


def plan_apply_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan to drop all junk names, misnamed in one class and misplaced in another,
    matched and applied; class -1 counts what the plan means but is not there."""
    p = pins(spark, sf_dir)
    name = F.when(F.col("rel") == 1, "other").otherwise(F.col("name"))
    lon = coord_key("lon") + F.when(F.col("rel") == 5, 1).otherwise(0)
    plan = p.where(drop_reason("name").isNotNull()).select(F.col("row_id").alias("plan_id"), name.alias("name"), coord_key("lat").alias("p_lat"), lon.alias("p_lon"))
    hit = M.match_plan(plan, p)
    kept = M.apply_drops(p, hit.where("row_id is not null"))
    missed = hit.where("row_id is null").agg(F.lit(-1).alias("rel"), F.count("*").alias("n"), F.sum("plan_id").alias("ids"))
    return kept.groupBy("rel").agg(F.count("*").alias("n"), F.sum("row_id").alias("ids")).unionByName(missed)


PLAN_DROP = f"""
WITH p AS (SELECT *, floor(lat * 100000e0 + 0.5)::BIGINT AS la, floor(lon * 100000e0 + 0.5)::BIGINT AS lo FROM {C}),
plan AS (SELECT row_id AS plan_id, CASE WHEN rel = 1 THEN 'other' ELSE name END AS name, la, lo + CASE WHEN rel = 5 THEN 1 ELSE 0 END AS lo FROM p WHERE {_REASON} IS NOT NULL),
m AS (SELECT plan_id, p.row_id, plan.name = p.name AS eq, max((plan.name = p.name)::INT) OVER (PARTITION BY plan_id) AS best FROM plan LEFT JOIN p ON p.la = plan.la AND p.lo = plan.lo),
h AS (SELECT * FROM m WHERE row_id IS NULL OR eq OR best = 0)
SELECT rel, count(*) AS n, sum(row_id)::BIGINT AS ids FROM p WHERE row_id NOT IN (SELECT row_id FROM h WHERE row_id IS NOT NULL) GROUP BY rel
UNION ALL SELECT -1, count(*), sum(plan_id)::BIGINT FROM h WHERE row_id IS NULL"""


def plan_apply_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every directory pin moves to the nearest external pin of its class within 1.5 km;
    moves are guarded, then applied."""
    p, s = pins(spark, sf_dir), pins(spark, sf_dir, "supplier")
    ends = s.select("row_id", "rel", "lat", "lon", F.col("lat").alias("new_lat"), F.col("lon").alias("new_lon"))
    near = nearest_within(p.select("row_id", "rel", "lat", "lon"), ends, 1500.0, ["rel"])
    plan = near.select("row_id", F.col("r_new_lat").alias("new_lat"), F.col("r_new_lon").alias("new_lon")).join(shuffled(p.select("row_id", "name")), "row_id")
    guarded = materialise(M.guard_near(M.guard_occupied(M.guard_unique(plan), p), p, 60.0), "guarded-moves")
    moved = M.apply_moves(p, guarded.where("blocked is null"))
    what = F.coalesce("blocked", F.when(F.col("moved"), "moved"), F.lit("still"))
    return moved.join(guarded.select("row_id", "blocked"), "row_id", "left").groupBy(what.alias("what")).agg(F.count("*").alias("n"), F.sum(coord_key("lat")).alias("lat_sum"))


PLAN_MOVE = f"""
WITH p AS (SELECT * FROM {C}),
plan AS (SELECT other AS row_id, o_name AS name, lat AS new_lat, lon AS new_lon FROM {_PAIR(S, C, 1500)} QUALIFY row_number() OVER (PARTITION BY other ORDER BY {_MM}, row_id) = 1),
d AS (SELECT *, floor(new_lat * 100000e0 + 0.5)::BIGINT AS dla, floor(new_lon * 100000e0 + 0.5)::BIGINT AS dlo FROM plan),
g AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY dla, dlo) > 1 THEN 'shared_destination'
   WHEN EXISTS (SELECT 1 FROM p WHERE floor(p.lat * 100000e0 + 0.5) = dla AND floor(p.lon * 100000e0 + 0.5) = dlo AND p.name <> d.name) THEN 'occupied'
   WHEN EXISTS (SELECT 1 FROM p WHERE p.row_id <> d.row_id AND abs(p.lat - new_lat) < 0.001 AND {hav('new_lat', 'new_lon', 'p.lat', 'p.lon')} <= 60e0) THEN 'near_occupied' END AS blocked FROM d)
SELECT coalesce(g.blocked, CASE WHEN g.row_id IS NOT NULL THEN 'moved' END, 'still') AS what, count(*) AS n,
  sum(floor(CASE WHEN g.row_id IS NOT NULL AND g.blocked IS NULL THEN new_lat ELSE p.lat END * 100000e0 + 0.5)::BIGINT)::BIGINT AS lat_sum
FROM p LEFT JOIN g ON g.row_id = p.row_id GROUP BY 1"""


def twin_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External pins within 1 km of a directory pin of the class that matches by name."""
    s, c = (pins(spark, sf_dir, side).select("row_id", T.tokens_b("name").alias("t"), "rel", "lat", "lon") for side in ("supplier", "customer"))
    mine, c = matching_names(s, c, 1000.0, T.jaccard("t", "r_t") >= 0.3)
    return nearest_within(mine, c, 1000.0, ["rel", "t"]).select("row_id")


TWIN_DROP = f"SELECT DISTINCT row_id FROM (SELECT *, {_B1} AS t, {_B2} AS o FROM {_PAIR(S, C, 1000)}) WHERE len(t) > 0 AND len(o) > 0 AND len(list_intersect(t, o))::DOUBLE / len(list_distinct(list_concat(t, o))) >= 0.3e0"


SPECS = ((0, "P0 Baptist Church", 40.0, -75.0), (1, "P1 Elementary School", 40.08, -74.9), (2, "P2 Masjid", 40.1, -74.85), (4, "P3 Temple Beth", 40.15, -74.95))


def spec_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest pin of the class within 3 km of each literal spec."""
    specs = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(r).alias("rel"), F.lit(n).alias("name"), F.lit(a).alias("lat"), F.lit(o).alias("lon")) for r, n, a, o in SPECS]))).withColumn("row_id", F.col("rel").cast("long"))
    return nearest(distance_pairs(specs, pins(spark, sf_dir).select("row_id", "rel", "lat", "lon"), 3000.0, ["rel"])).select(F.col("row_id").alias("spec"), F.col("r_row_id").alias("other"))


_SPECS = "(SELECT * FROM (VALUES " + ", ".join(f"({r}, {a}e0, {o}e0)" for r, _, a, o in SPECS) + ") v(rel, lat, lon))"
SPEC_LOOKUP = f"""WITH p AS (SELECT s.rel::BIGINT AS spec, c.row_id AS other, {hav('s.lat', 's.lon', 'c.lat', 'c.lon')} AS m FROM {_SPECS} s JOIN {C} c ON s.rel = c.rel)
SELECT spec, other FROM p WHERE m <= 3000 QUALIFY row_number() OVER (PARTITION BY spec ORDER BY {_MM}, other) = 1"""


def candidate_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action for each external pin: filter, match with the first similar pin within 500 m,
    or append."""
    s = pins(spark, sf_dir, "supplier").withColumn("reason", drop_reason("name"))
    p = distance_pairs(s.where("reason is null"), pins(spark, sf_dir).select("row_id", "name", "rel", "lat", "lon"), 500.0)
    alike = T.jaccard(F.split(F.lower("name"), " "), F.split(F.lower("r_name"), " ")) >= 0.3
    first = p.where(alike).groupBy("row_id").agg(F.min("r_row_id").alias("other"))
    act = F.when(F.col("reason").isNotNull(), "FILTER_DROP").when(F.col("other").isNotNull(), "MATCH_EXISTING").otherwise("APPEND_CANDIDATE")
    return s.join(first, "row_id", "left").select("row_id", act.alias("action"), "other", "reason")


CANDIDATE_MATCH = f"""
WITH s AS (SELECT *, {_REASON} AS reason FROM {S}),
p AS (SELECT s.row_id, c.row_id AS other, string_split(lower(s.name), ' ') AS t, string_split(lower(c.name), ' ') AS o FROM s JOIN {C} c ON abs(s.lat - c.lat) <= 0.006 AND {hav('s.lat', 's.lon', 'c.lat', 'c.lon')} <= 500e0 WHERE reason IS NULL),
f AS (SELECT row_id, min(other) AS other FROM p WHERE len(list_intersect(list_distinct(t), list_distinct(o)))::DOUBLE / len(list_distinct(list_concat(t, o))) >= 0.3e0 GROUP BY 1)
SELECT s.row_id, CASE WHEN reason IS NOT NULL THEN 'FILTER_DROP' WHEN other IS NOT NULL THEN 'MATCH_EXISTING' ELSE 'APPEND_CANDIDATE' END AS action, other, reason FROM s LEFT JOIN f ON f.row_id = s.row_id"""


# duplicates -------------------------------------------------------------------------------


def stack_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best pin of each 200th-of-a-degree stack of a class."""
    p = pins(spark, sf_dir).withColumn("a", cell("lat", 200.0)).withColumn("o", cell("lon", 200.0))
    score = stack_score("name", F.col("row_id") % 3 != 0, F.when(F.col("row_id") % 2 == 0, "x").otherwise(""))
    return best_of(p, ["a", "o", "rel"], score).select("row_id", "a", "o", "rel")


_STACK = f"""(CASE WHEN {sql_says('name', R.STACK_FOR)} THEN 3 ELSE 0 END - CASE WHEN {sql_says('name', R.STACK_AGAINST)} THEN 5 ELSE 0 END - CASE WHEN length(name) > 70 THEN 2 ELSE 0 END) DESC,
  CASE WHEN row_id % 3 <> 0 THEN 2 ELSE 0 END DESC, CASE WHEN row_id % 2 = 0 THEN 1 ELSE 0 END DESC, length(name) DESC, row_id"""
STACK_COLLAPSE = f"""SELECT row_id, a, o, rel FROM (SELECT *, floor(lat * 200e0)::BIGINT AS a, floor(lon * 200e0)::BIGINT AS o FROM {C})
QUALIFY row_number() OVER (PARTITION BY a, o, rel ORDER BY {_STACK}) = 1"""


def near_dedupe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of pins of a class and segment within 500 m; the best of each stays."""
    score = near_score("name", F.col("row_id") % 3 != 0, F.lit("x"))
    return near_dedupe(pins(spark, sf_dir), 500.0, ["rel", "segment"], score).select("row_id", "component", "cluster_size")


NEAR_DEDUPE = f"""
WITH RECURSIVE p AS (SELECT * FROM {C}),
e AS (SELECT a.row_id AS u, b.row_id AS v FROM p a JOIN p b ON a.rel = b.rel AND a.segment = b.segment AND a.row_id <> b.row_id AND abs(a.lat - b.lat) <= 0.006 AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 500e0),
r AS (SELECT row_id AS u, row_id AS w FROM p UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.w),
c AS (SELECT u AS row_id, min(w) AS component FROM r GROUP BY 1),
s AS (SELECT p.row_id, component, count(*) OVER (PARTITION BY component) AS cluster_size,
  row_number() OVER (PARTITION BY component ORDER BY CASE WHEN {sql_says('name', R.NEAR_AGAINST)} THEN -3 ELSE 0 END DESC, CASE WHEN p.row_id % 3 <> 0 THEN 2 ELSE 0 END DESC, length(name) DESC, p.row_id) AS rk FROM p JOIN c ON c.row_id = p.row_id)
SELECT row_id, component, cluster_size FROM s WHERE rk = 1"""


def replace_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = pins(spark, sf_dir), pins(spark, sf_dir, "supplier")
    return M.replace_class(c, s.withColumn("rel", F.lit(2)), "rel", 2).groupBy("rel").agg(F.count("*").alias("n"), F.sum("row_id").alias("ids"))


REPLACE_PARTITION = f"SELECT rel, count(*) AS n, sum(row_id)::BIGINT AS ids FROM (SELECT rel, row_id FROM {C} WHERE rel <> 2 UNION ALL SELECT 2, row_id FROM {S}) GROUP BY rel"


def quota_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many pins for each class and state as suppliers times thirteen."""
    n = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    needs = n.groupBy(F.col("n_name").alias("state"), (F.col("s_nationkey") % 6).alias("rel")).agg((F.count("*") * 13).alias("need"))
    out = fill_quota(pins(spark, sf_dir), needs, ["state", "rel"])
    return out.select("state", "rel", "slot", "source_id", "synthetic", F.floor(hash01(F.concat_ws(":", "state", "rel"), F.col("slot")) * 1e9).cast("long").alias("h"))


_FNV = """list_reduce(list_concat([2166136261::HUGEINT], list_transform(string_split(k, ''), lambda c: ascii(c)::HUGEINT)), lambda a, c: (xor(a, c) * 16777619) % 4294967296::HUGEINT)"""
QUOTA_FILL = f"""
WITH p AS (SELECT *, row_number() OVER w AS nth, count(*) OVER (PARTITION BY state, rel) AS have FROM {C} WINDOW w AS (PARTITION BY state, rel ORDER BY row_id)),
n AS (SELECT n_name AS state, s_nationkey % 6 AS rel, count(*) * 13 AS need FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2),
r AS (SELECT p.state, p.rel, nth AS slot, row_id AS source_id, false AS synthetic FROM p JOIN n ON n.state = p.state AND n.rel = p.rel WHERE nth <= need
  UNION ALL SELECT state, rel, have + i + 1, row_id, true FROM (SELECT p.*, unnest(range(nth - 1, need - have, have)) AS i FROM p JOIN n ON n.state = p.state AND n.rel = p.rel WHERE need > have AND nth <= need - have)),
f AS (SELECT *, {_FNV.replace("string_split(k, '')", "string_split(state || ':' || rel::VARCHAR, '')")} AS h0 FROM r),
g AS (SELECT *, xor(h0, (slot + 2654435769)::HUGEINT % 4294967296) AS h1 FROM f), i AS (SELECT *, (xor(h1, h1 // 65536) * 2246822507) % 4294967296::HUGEINT AS h2 FROM g),
j AS (SELECT *, (xor(h2, h2 // 8192) * 3266489909) % 4294967296::HUGEINT AS h3 FROM i)
SELECT state, rel, slot, source_id, synthetic, floor(xor(h3, h3 // 65536)::DOUBLE / 4294967296e0 * 1e9)::BIGINT AS h FROM j"""


# polygons and the rest --------------------------------------------------------------------


def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containing(pins(spark, sf_dir), edges_of(polygons(spark)))


_INSIDE = """sum(((y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (CASE WHEN y2 = y1 THEN 1e0 ELSE y2 - y1 END) + x1)::INT) % 2 = 1
  OR max(((x2 - x1) * (lat - y1) = (lon - x1) * (y2 - y1) AND lon BETWEEN least(x1, x2) AND greatest(x1, x2) AND lat BETWEEN least(y1, y2) AND greatest(y1, y2))::INT) = 1"""
_IN = f"(SELECT row_id, min(poly_id) AS poly_id FROM (SELECT row_id, poly_id FROM {C} CROSS JOIN {edges_sql()} GROUP BY 1, 2 HAVING {_INSIDE}) GROUP BY 1)"
POINT_IN_POLYGON = f"SELECT * FROM {_IN}"


def polygon_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(pins(spark, sf_dir), edges_of(polygons(spark)), 0.02).select("row_id", "poly_id", "how")


_T = "greatest(0e0, least(1e0, ((lon-x1)*(x2-x1)+(lat-y1)*(y2-y1))/((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))))"
POLYGON_FALLBACK = f"""
WITH i AS (SELECT * FROM {_IN}), p AS (SELECT * FROM {C}),
d AS (SELECT row_id, poly_id, sqrt((lon-x1-t*(x2-x1))*(lon-x1-t*(x2-x1)) + (lat-y1-t*(y2-y1))*(lat-y1-t*(y2-y1))) AS deg FROM (SELECT p.row_id, e.*, lat, lon, {_T} AS t FROM p CROSS JOIN {edges_sql()} e WHERE p.row_id NOT IN (SELECT row_id FROM i))),
n AS (SELECT row_id, poly_id FROM d WHERE deg < 0.02 QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY floor(deg * 1e9 + 0.5), poly_id) = 1)
SELECT p.row_id, coalesce(i.poly_id, n.poly_id) AS poly_id, CASE WHEN i.poly_id IS NOT NULL THEN 'inside' WHEN n.poly_id IS NOT NULL THEN 'near' END AS how FROM p LEFT JOIN i ON i.row_id = p.row_id LEFT JOIN n ON n.row_id = p.row_id"""


def land_lake_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A and B are land, C is a lake: pins off the land or in the lake are impossible."""
    p, e = pins(spark, sf_dir), edges_of(polygons(spark))
    land = containing(p, e.where("poly_id <> 'C'")).select("row_id", F.lit(True).alias("land"))
    lake = containing(p, e.where("poly_id = 'C'")).select("row_id", F.lit(True).alias("lake"))
    j = p.join(land, "row_id", "left").join(lake, "row_id", "left")
    return j.groupBy("rel").agg(F.count("*").alias("n"), F.count_if(F.col("land").isNull() | F.col("lake").isNotNull()).alias("impossible"))


LAND_LAKE = f"""
WITH h AS (SELECT row_id, poly_id FROM {C} CROSS JOIN {edges_sql()} GROUP BY 1, 2 HAVING {_INSIDE})
SELECT rel, count(*) AS n, count(*) FILTER (NOT EXISTS (SELECT 1 FROM h WHERE h.row_id = p.row_id AND poly_id <> 'C') OR EXISTS (SELECT 1 FROM h WHERE h.row_id = p.row_id AND poly_id = 'C')) AS impossible FROM {C} p GROUP BY rel"""


def county_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a click selects: the nearest pin within 150 m of an external pin, else the
    polygon around it, else nothing."""
    s = pins(spark, sf_dir, "supplier")
    pin = nearest(distance_pairs(s, pins(spark, sf_dir).select("row_id", "lat", "lon"), 150.0)).select("row_id", F.col("r_row_id").alias("pin"))
    poly = containing(s, edges_of(polygons(spark)))
    return s.select("row_id").join(pin, "row_id", "left").join(poly, "row_id", "left").select("row_id", F.coalesce(F.col("pin").cast("string"), "poly_id", F.lit("clear")).alias("hit"))


COUNTY_HIT = f"""
WITH s AS (SELECT * FROM {S}), n AS (SELECT s.row_id, c.row_id AS pin, {hav('s.lat', 's.lon', 'c.lat', 'c.lon')} AS m FROM s JOIN {C} c ON abs(s.lat - c.lat) < 0.002),
b AS (SELECT row_id, pin FROM n WHERE m <= 150 QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY {_MM}, pin) = 1),
h AS (SELECT row_id, min(poly_id) AS poly_id FROM (SELECT row_id, poly_id FROM s CROSS JOIN {edges_sql()} GROUP BY 1, 2 HAVING {_INSIDE}) GROUP BY 1)
SELECT s.row_id, coalesce(pin::VARCHAR, poly_id, 'clear') AS hit FROM s LEFT JOIN b ON b.row_id = s.row_id LEFT JOIN h ON h.row_id = s.row_id"""


def click_stack_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pins tied for a click on a coarse screen of 20 pixels a degree."""
    p = pins(spark, sf_dir).withColumn("x", F.floor((F.col("lon") + 75.0) * 20)).withColumn("y", F.floor((F.col("lat") - 40.0) * 20)).withColumn("synthetic", F.col("row_id") % 4 == 0)
    return click_stack(p, 2.0, 1.0).select("row_id", "rel", "name", "nth")


CLICK_STACK = f"""
WITH p AS (SELECT *, pow(floor((lon + 75e0) * 20) - 2, 2) + pow(floor((lat - 40e0) * 20) - 1, 2) + CASE WHEN row_id % 4 = 0 THEN 36 ELSE 0 END AS d FROM {C}),
t AS (SELECT * FROM p WHERE d <= 576 QUALIFY d <= min(d) OVER () + 0.25), u AS (SELECT *, count(*) OVER (PARTITION BY rel) AS c FROM t)
SELECT row_id, rel, name, row_number() OVER (ORDER BY c, rel, name, row_id) AS nth FROM u"""


def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusive buckets of external pins, the first sign wins."""
    s = pins(spark, sf_dir, "supplier")
    c = pins(spark, sf_dir).select("row_id", "name", "rel", "lat", "lon")
    told = lambda df: df.select("row_id", T.tokens_a("name").alias("t"), "rel", "lat", "lon")
    mine, other = matching_names(told(s), told(c), 1000.0, T.jaccard("t", "r_t") >= 0.5)
    dupe = nearest_within(mine, other, 1000.0, ["rel", "t"], low_m=250.0).select("row_id", F.lit(True).alias("dupe"))
    lean = lambda df: df.select("row_id", "rel", "lat", "lon")
    built = nearest_within(lean(s), lean(c), 250.0, ["rel"]).where(F.col("dist_m") < 250.0).select("row_id", F.lit(True).alias("built"))
    land = containing(s, edges_of(polygons(spark))).select("row_id", F.lit(True).alias("land"))
    j = shuffled(s).join(dupe, "row_id", "left").join(shuffled(built), "row_id", "left").join(shuffled(land), "row_id", "left")
    bucket = first_of([(drop_reason("name").isNotNull(), "name_junk"), (F.col("dupe").isNotNull(), "hifld_dupe"), (F.col("built").isNotNull(), "on_building"), (F.col("land").isNull(), "impossible")], "rural_expected")
    return j.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum("row_id").alias("ids"))


SCORECARD = f"""
WITH p AS (SELECT *, {_TA} AS ta, {_TB} AS tb FROM {_PAIR(S, C, 1000)}), s AS (SELECT * FROM {S}),
l AS (SELECT DISTINCT row_id FROM (SELECT row_id, poly_id FROM s CROSS JOIN {edges_sql()} GROUP BY 1, 2 HAVING {_INSIDE})),
b AS (SELECT row_id, CASE WHEN {_REASON} IS NOT NULL THEN 'name_junk'
  WHEN row_id IN (SELECT row_id FROM p WHERE m >= 250 AND len(ta) > 0 AND len(tb) > 0 AND len(list_intersect(ta, tb))::DOUBLE / len(list_distinct(list_concat(ta, tb))) >= 0.5e0) THEN 'hifld_dupe'
  WHEN row_id IN (SELECT row_id FROM p WHERE m < 250) THEN 'on_building' WHEN row_id NOT IN (SELECT row_id FROM l) THEN 'impossible' ELSE 'rural_expected' END AS bucket FROM s)
SELECT bucket, count(*) AS n, sum(row_id)::BIGINT AS ids FROM b GROUP BY 1"""


def shape_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Middle and span of the ring of each nation."""
    r = ring_stats(nation_rings(spark, sf_dir))
    return r.select("poly_id", *[rounded(c, 6).alias(c) for c in ("lon", "lat", "dx", "dy")], F.col("n").cast("long").alias("n"))


SHAPE_STATS = f"""WITH v AS (SELECT poly_id, x1 AS x, y1 AS y FROM {nation_edges_sql()} UNION ALL SELECT state, lon, lat FROM {C} QUALIFY row_number() OVER (PARTITION BY state ORDER BY row_id) = 1 AND count(*) OVER (PARTITION BY state) >= 3)
SELECT poly_id, {round_sql('avg(x)', 6)} AS lon, {round_sql('avg(y)', 6)} AS lat, {round_sql('max(x) - min(x)', 6)} AS dx, {round_sql('max(y) - min(y)', 6)} AS dy, count(*) AS n FROM v GROUP BY 1"""


def zoom_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each directory pin at a zoom that goes by its number."""
    z = pins(spark, sf_dir).select("row_id", (F.col("row_id") % 81 / 4.0).alias("zoom"))
    return z.select("row_id", "zoom", rounded(zoom_size("zoom"), 6).alias("size"))


ZOOM_SIZE = f"""
WITH z AS (SELECT row_id, row_id % 81 / 4e0 AS zoom FROM {C}), s AS (SELECT row_id, zoom, CASE WHEN zoom <= 2 THEN 0.1e0 WHEN zoom <= 4 THEN 0.1e0 + 0.9e0 * ((zoom - 2) / 2e0) WHEN zoom <= 7 THEN 1e0 + 1.8e0 * ((zoom - 4) / 3e0)
  WHEN zoom <= 9 THEN 2.8e0 + 1e0 * ((zoom - 7) / 2e0) WHEN zoom <= 14 THEN 3.8e0 + 1.9e0 * ((zoom - 9) / 5e0) WHEN zoom <= 18 THEN 5.7e0 + 0.3e0 * ((zoom - 14) / 4e0) ELSE 6e0 END AS css FROM z)
SELECT row_id, zoom, {round_sql('CASE WHEN zoom >= 9 THEN greatest(3e0, css) ELSE css END', 6)} AS size FROM s"""


def audit_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = pins(spark, sf_dir)
    kept = c.where(drop_reason("name").isNull())
    best = best_of(kept.withColumn("a", cell("lat", 200.0)).withColumn("o", cell("lon", 200.0)), ["a", "o", "rel"], stack_score("name", F.lit(True), F.lit("x")))
    return M.ledger([("read", c), ("names", kept), ("stacks", best)], "rel")


AUDIT_LEDGER = f"""
WITH c AS (SELECT * FROM {C}), k AS (SELECT * FROM c WHERE {_REASON} IS NULL), b AS (SELECT DISTINCT floor(lat * 200e0), floor(lon * 200e0), rel FROM k)
SELECT 0 AS step, 'read' AS stage, rel::VARCHAR AS class, count(*) AS n FROM c GROUP BY rel UNION ALL SELECT 1, 'names', rel::VARCHAR, count(*) FROM k GROUP BY rel UNION ALL SELECT 2, 'stacks', rel::VARCHAR, count(*) FROM b GROUP BY rel"""

QUERIES = {
    "rollup_focus": rollup_focus, "census_vectors": census_vectors, "vector_subset_total": vector_subset_total, "viewport_filter": viewport_filter, "county_gap_report": county_gap_report,
    "top_gap": top_gap, "grid_nearest": grid_nearest, "gap_fill": gap_fill, "band_dupe": band_dupe, "nearest_window": nearest_window, "shared_token_nearest": shared_token_nearest,
    "unique_name_snap": unique_name_snap, "local_unique_snap": local_unique_snap, "fuzzy_snap_reasons": fuzzy_snap_reasons, "exact_coord_join": exact_coord_join,
    "plan_apply_drop": plan_apply_drop, "plan_apply_move": plan_apply_move, "twin_drop": twin_drop, "spec_lookup": spec_lookup, "candidate_match": candidate_match,
    "stack_collapse": stack_collapse, "near_dedupe": near_dedupe_query, "replace_partition": replace_partition, "quota_fill": quota_fill, "point_in_polygon": point_in_polygon,
    "polygon_fallback": polygon_fallback, "land_lake_flag": land_lake_flag, "county_hit": county_hit, "click_stack": click_stack_query, "scorecard": scorecard, "shape_stats": shape_stats,
    "zoom_size": zoom_sizes, "audit_ledger": audit_ledger,
}
SQL = {
    "rollup_focus": ROLLUP_FOCUS, "census_vectors": CENSUS_VECTORS, "vector_subset_total": VECTOR_SUBSET_TOTAL, "viewport_filter": VIEWPORT, "county_gap_report": COUNTY_GAP, "top_gap": TOP_GAP,
    "grid_nearest": GRID_NEAREST, "gap_fill": GAP_FILL, "band_dupe": BAND_DUPE, "nearest_window": NEAREST_WINDOW, "shared_token_nearest": SHARED_TOKEN, "unique_name_snap": UNIQUE_NAME,
    "local_unique_snap": LOCAL_UNIQUE, "fuzzy_snap_reasons": FUZZY_SNAP, "exact_coord_join": EXACT_COORD, "plan_apply_drop": PLAN_DROP, "plan_apply_move": PLAN_MOVE, "twin_drop": TWIN_DROP,
    "spec_lookup": SPEC_LOOKUP, "candidate_match": CANDIDATE_MATCH, "stack_collapse": STACK_COLLAPSE, "near_dedupe": NEAR_DEDUPE, "replace_partition": REPLACE_PARTITION, "quota_fill": QUOTA_FILL,
    "point_in_polygon": POINT_IN_POLYGON, "polygon_fallback": POLYGON_FALLBACK, "land_lake_flag": LAND_LAKE, "county_hit": COUNTY_HIT, "click_stack": CLICK_STACK, "scorecard": SCORECARD,
    "shape_stats": SHAPE_STATS, "zoom_size": ZOOM_SIZE, "audit_ledger": AUDIT_LEDGER,
}
