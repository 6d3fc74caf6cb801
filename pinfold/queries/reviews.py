"""Queries of the review operators and reports, row by row, with their SQL."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pinfold.functions import rules as R
from pinfold.functions import text as T
from pinfold.functions.geo import rounded
from pinfold.operators import report as P
from pinfold.operators import review as V
from pinfold.operators.cells import without_near
from pinfold.operators.polygons import edges_of
from pinfold.operators.rollup import census_cube, gap_report
from pinfold.operators.sampling import far_and_random, first_rows, quota_sample
from pinfold.plans import moves as M
from pinfold.queries.names import _REASON, sql_says, sql_tokens
from pinfold.queries.pins import SUFFIXES, edges_sql, hav, pins, pins_sql, polygons, round_sql
from pinfold.queries.places import _INSIDE
from pinfold.runtime import table
from pinfold.sources.web import parse_place_page, parse_points

C, S = pins_sql(), pins_sql("supplier")
#: The pins of the test tables lie far apart.
BAND = {"high_m": 6000.0}
_MM = "floor(m * 1000 + 0.5)"


def _near(a: str, b: str, reach: float, on: str = "a.rel = b.rel") -> str:
    """Pairs of two views within reach, as SQL."""
    m = hav("a.lat", "a.lon", "b.lat", "b.lon")
    return f"""(SELECT a.row_id, a.name, a.state, b.row_id AS other, b.name AS o_name, b.lat AS o_lat, b.lon AS o_lon, {m} AS m FROM {a} a JOIN {b} b ON {on} AND abs(a.lat - b.lat) <= {reach / 110000}
  WHERE {m} <= {reach}e0)"""


def _match(x: str, y: str) -> str:
    both = f"len(list_intersect({x}, {y}))"
    return f"(len({x}) >= 2 AND len({y}) >= 2 AND ({both}::DOUBLE / len(list_distinct(list_concat({x}, {y}))) >= 0.8e0 OR {both} = len({x}) OR {both} = len({y})))"


_A = lambda name: sql_tokens(name, T.SAME_A, T.STOP_A)
_B = lambda name: sql_tokens(name, T.SAME_B, T.STOP_B)
_ALIKE = "((len(ta) > 0 AND len(tb) > 0 AND len(list_intersect(ta, tb))::DOUBLE / len(list_distinct(list_concat(ta, tb))) >= 0.7e0) OR ta = tb)"
_DUPES = f"""(SELECT row_id, other, m FROM (SELECT *, {_A('name')} AS ta, {_A('o_name')} AS tb FROM {_near(S, C, 6000)} WHERE m >= 250e0) WHERE {_ALIKE}
  QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY {_MM}, other) = 1)"""


def band_dupe_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The duplicate of each external pin in the directory."""
    return V.band_dupes(pins(spark, sf_dir, "supplier"), pins(spark, sf_dir), **BAND).select("row_id", "other", rounded("dist_m", 3).alias("m"))


BAND_DUPE_PAIRS = f"SELECT row_id, other, {round_sql('m', 3)} AS m FROM {_DUPES}"


def local_snap_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where external pins go, with directory pins as the buildings."""
    out = V.local_snaps(pins(spark, sf_dir, "supplier"), pins(spark, sf_dir), near_m=10_000.0)
    return out.select("row_id", "action", "area", rounded("move_m", 1).alias("move_m"))


def _snaps(s: str, near: float, areas: str = C) -> str:
    m = hav("a.lat", "a.lon", "b.lat", "b.lon")
    return f"""(WITH a AS (SELECT *, {_A('name')} AS t FROM {s}), b AS (SELECT *, {_A('name')} AS t FROM {areas}),
  p AS (SELECT a.row_id, a.name, b.row_id AS area, b.lat AS new_lat, b.lon AS new_lon, {m} AS m, count(*) OVER (PARTITION BY a.row_id) AS every FROM a JOIN b ON a.state = b.state AND a.t = b.t WHERE len(a.t) >= 2),
  n AS (SELECT *, count(*) FILTER (m >= 1500 AND m <= {near}) OVER (PARTITION BY row_id) AS close FROM p)
  SELECT row_id, name, 'snap' AS action, area, new_lat, new_lon, m FROM n WHERE close = 1 AND m >= 1500 AND m <= {near}
  UNION ALL SELECT row_id, name, 'review', area, new_lat, new_lon, m FROM n WHERE every = 1 AND m > {near} AND m <= 100000)"""


LOCAL_SNAP_PLAN = f"SELECT row_id, action, area, {round_sql('m', 1)} AS move_m FROM {_snaps(S, 10000)}"


def scorecard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bucket of every external pin; polygons A and B are land, C is a lake."""
    e = edges_of(polygons(spark))
    return V.scorecard(pins(spark, sf_dir, "supplier"), pins(spark, sf_dir), pins(spark, sf_dir), e.where("poly_id <> 'C'"), e.where("poly_id = 'C'"), building_m=120.0, band=BAND, near_m=10_000.0)


def _scorecard_sql(near: str = C, snap: str = C) -> str:
    return f"""
WITH s AS (SELECT *, {_REASON} AS junk FROM {S}), c AS (SELECT * FROM {C}),
d AS (SELECT * FROM {_DUPES}), b AS (SELECT row_id, other FROM {_near(S, near, 120, 'true')} QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY {_MM}, other) = 1),
one AS (SELECT row_id, CASE WHEN junk IS NOT NULL THEN 'name_junk' WHEN d.other IS NOT NULL THEN 'hifld_dupe' WHEN b.other IS NOT NULL THEN 'on_building' END AS bucket,
  CASE WHEN junk IS NOT NULL THEN junk ELSE coalesce(d.other, b.other)::VARCHAR END AS detail FROM s LEFT JOIN d USING (row_id) LEFT JOIN b USING (row_id)),
q AS (SELECT x.*, floor(new_lat * 100000e0 + 0.5) AS dla, floor(new_lon * 100000e0 + 0.5) AS dlo FROM {_snaps(S, 10000, snap)} x JOIN one ON one.row_id = x.row_id AND bucket IS NULL WHERE action = 'snap'),
held AS (SELECT floor(lat * 100000e0 + 0.5) AS la, floor(lon * 100000e0 + 0.5) AS lo, name FROM c UNION SELECT floor(lat * 100000e0 + 0.5), floor(lon * 100000e0 + 0.5), name FROM s),
g AS (SELECT row_id, area, CASE WHEN count(*) OVER (PARTITION BY dla, dlo) > 1 THEN 'shared_destination' WHEN EXISTS (SELECT 1 FROM held WHERE la = dla AND lo = dlo AND held.name <> q.name) THEN 'occupied' END AS blocked FROM q),
h AS (SELECT row_id, bool_or(poly_id <> 'C') AS land, bool_or(poly_id = 'C') AS lake FROM (SELECT row_id, poly_id FROM s CROSS JOIN {edges_sql()} GROUP BY 1, 2 HAVING {_INSIDE}) GROUP BY 1)
SELECT one.row_id, coalesce(bucket, CASE WHEN g.row_id IS NOT NULL AND blocked IS NULL THEN 'local_snap' WHEN g.row_id IS NOT NULL THEN 'rural_expected' WHEN lake OR NOT coalesce(land, false) THEN 'impossible' ELSE 'rural_expected' END) AS bucket,
  CASE WHEN bucket IS NOT NULL THEN detail WHEN g.row_id IS NOT NULL THEN coalesce(blocked, area::VARCHAR) WHEN lake THEN 'in-lake' WHEN NOT coalesce(land, false) THEN 'not-on-land' END AS detail
FROM one LEFT JOIN g ON g.row_id = one.row_id LEFT JOIN h ON h.row_id = one.row_id"""


SCORECARD_ROWS = _scorecard_sql()


def scorecard_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scorecard where areas tell their spans, made of their numbers: grounds are no
    buildings to lie on, and large buildings none to snap to."""
    e, p = edges_of(polygons(spark)), pins(spark, sf_dir)
    areas = p.withColumn("span_m", (F.col("row_id") * 37 % 9000).cast("double"))
    return V.scorecard(pins(spark, sf_dir, "supplier"), p, areas, e.where("poly_id <> 'C'"), e.where("poly_id = 'C'"), building_m=120.0, band=BAND, near_m=10_000.0, snap_span_m=4000.0)


_SPAN = lambda most: f"(SELECT * FROM {C} WHERE row_id * 37 % 9000 <= {most})"
SCORECARD_SPANS = _scorecard_sql(_SPAN(5000), _SPAN(4000))


def fuzzy_snap_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each external pin goes within its state and class, or why it stays."""
    out = V.fuzzy_snaps(pins(spark, sf_dir, "supplier"), pins(spark, sf_dir), within_m=6000.0)
    return out.select("row_id", "reason", "other", rounded("new_lat", 5).alias("new_lat"), rounded("new_lon", 5).alias("new_lon"))


_FUZZY = f"""(WITH p AS (SELECT *, {_B('name')} AS t, {_B('o_name')} AS o FROM {_near(S, C, 6000, 'a.rel = b.rel AND a.state = b.state')}),
  h AS (SELECT row_id, count(*) AS hits, min(m) AS m, min(other) AS other, min(o_lat) AS new_lat, min(o_lon) AS new_lon FROM p WHERE {_match('t', 'o')} GROUP BY 1)
  SELECT s.row_id, s.name, h.*  EXCLUDE (row_id), CASE WHEN len({_B('name')}) < 2 THEN 'few_tokens' WHEN {sql_says('name', R.ADMIN_PINS)} THEN 'admin_name' WHEN hits IS NULL THEN 'no_match' WHEN hits > 1 THEN 'not_unique'
    WHEN m < 15 THEN 'already_there' ELSE 'snap' END AS reason FROM {S} s LEFT JOIN h ON h.row_id = s.row_id)"""
FUZZY_SNAP_PLAN = f"""SELECT row_id, reason, CASE WHEN reason = 'snap' THEN other END AS other, CASE WHEN reason = 'snap' THEN {round_sql('new_lat', 5)} END AS new_lat, CASE WHEN reason = 'snap' THEN {round_sql('new_lon', 5)} END AS new_lon FROM {_FUZZY}"""


def snap_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory pins that match a snapped external pin by name near where it goes."""
    s = pins(spark, sf_dir, "supplier")
    moves = V.fuzzy_snaps(s, pins(spark, sf_dir), within_m=6000.0).where("reason = 'snap'").join(s.select("row_id", "name"), "row_id")
    return V.twins_of(moves, pins(spark, sf_dir), within_m=2000.0)


SNAP_TWINS = f"""WITH f AS (SELECT * FROM {_FUZZY} WHERE reason = 'snap'), p AS (SELECT c.row_id, {_B('f.name')} AS t, {_B('c.name')} AS o, {hav('f.new_lat', 'f.new_lon', 'c.lat', 'c.lon')} AS m FROM f JOIN {C} c ON abs(c.lat - f.new_lat) <= 0.02)
SELECT DISTINCT row_id FROM p WHERE m <= 2000 AND {_match('t', 'o')}"""


def exact_spec_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External pins looked up by name, state and class in the directory."""
    return V.find_by_spec(pins(spark, sf_dir, "supplier"), pins(spark, sf_dir), 15_000.0).select("row_id", "other")


EXACT_SPEC = f"SELECT row_id, other FROM {_near(S, C, 15000, 'a.rel = b.rel AND a.state = b.state AND a.name = b.name')} QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY {_MM}, other) = 1"


def candidate_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each external pin; every ninth has no coordinates."""
    s = pins(spark, sf_dir, "supplier")
    s = s.withColumn("lat", F.when(F.col("row_id") % 9 != 0, F.col("lat")))
    return V.match_candidates(s, pins(spark, sf_dir), match_m=900.0)


def _similar_sql() -> str:
    """Pairs of the finitely many names of the pins that are similar.  SQL has no matching
    ratio, so the oracle is given that of Python's own library, on forms written down here
    once more: nothing of it is what the query runs."""
    every = sorted({f"P{k} {s}".strip() for k in range(7) for s in SUFFIXES})

    def plain(name: str) -> str:
        parts = re.sub(r"\W", " ", unicodedata.normalize("NFKC", name).lower()).split()
        while parts and parts[-1] in T.COMPANY:
            parts.pop()
        return " ".join(T.EXPAND.get(p, p) for p in parts)

    def alike(x: str, y: str) -> bool:
        s, t = set(x.split()), set(y.split())
        return bool(x and y) and (x == y or len(s & t) >= 0.85 * len(s | t) or SequenceMatcher(None, x, y).ratio() >= 0.92)

    forms = {n: plain(n) for n in every}
    like = [(a, b) for a in every for b in every if alike(forms[a], forms[b])]
    return "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in like) + ") sim(x, y)"


CANDIDATE_ACTIONS = f"""
WITH s AS (SELECT *, {_REASON} AS reason FROM {S}), sim AS (SELECT * FROM {_similar_sql()}),
f AS (SELECT row_id, min(other) AS hit FROM {_near(S, C, 900, 'true')} p JOIN sim ON x = p.name AND y = p.o_name WHERE row_id % 9 <> 0 GROUP BY 1)
SELECT s.row_id, CASE WHEN reason IS NOT NULL THEN 'FILTER_DROP' WHEN s.row_id % 9 = 0 THEN 'GEOCODE_FAIL' WHEN hit IS NOT NULL THEN 'MATCH_EXISTING' ELSE 'APPEND_CANDIDATE' END AS action,
  CASE WHEN reason IS NULL THEN hit END AS other, reason FROM s LEFT JOIN f ON f.row_id = s.row_id"""


def gap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The external pins that a gap fill adds, row by row."""
    return without_near(pins(spark, sf_dir, "supplier"), pins(spark, sf_dir), 250.0, ["rel"]).where(R.drop_reason("name").isNull()).select("row_id", "name", "state")


GAP_ROWS = f"SELECT row_id, name, state FROM {S} s WHERE {_REASON} IS NULL AND row_id NOT IN (SELECT row_id FROM {_near(S, C, 250)})"


def guarded_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snap plan of external pins with its guards, row by row."""
    s = pins(spark, sf_dir, "supplier")
    plan = V.local_snaps(s, pins(spark, sf_dir), near_m=10_000.0).where("action = 'snap'")
    return M.guard_near(M.guard_occupied(M.guard_unique(plan), pins(spark, sf_dir)), s, 300.0).select("row_id", "area", F.coalesce("blocked", F.lit("")).alias("blocked"))


GUARDED_MOVES = f"""
WITH q AS (SELECT *, floor(new_lat * 100000e0 + 0.5) AS dla, floor(new_lon * 100000e0 + 0.5) AS dlo FROM {_snaps(S, 10000)} WHERE action = 'snap')
SELECT row_id, area, CASE WHEN count(*) OVER (PARTITION BY dla, dlo) > 1 THEN 'shared_destination'
  WHEN EXISTS (SELECT 1 FROM {C} c WHERE floor(c.lat * 100000e0 + 0.5) = dla AND floor(c.lon * 100000e0 + 0.5) = dlo AND c.name <> q.name) THEN 'occupied'
  WHEN EXISTS (SELECT 1 FROM {S} s WHERE s.row_id <> q.row_id AND {hav('q.new_lat', 'q.new_lon', 's.lat', 's.lon')} <= 300e0) THEN 'near_occupied' ELSE '' END AS blocked FROM q"""


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted groups by class, some without a state, a code or a count."""
    return pins(spark, sf_dir).selectExpr(
        "if(row_id % 11 = 0, 'x', concat(fips, '.0')) AS fips", "if(row_id % 7 = 0, null, state) AS state", "rel AS pos", "cast(row_id % 5 as bigint) AS n"
    )


def census_cube_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count vectors by county, state and country."""
    return census_cube(_groups(spark, sf_dir), 6).select("level", "key", *[F.element_at("counts", i + 1).alias(f"c{i}") for i in range(6)])


_SUMS = ", ".join(f"coalesce(sum(n) FILTER (rel = {i}), 0)::BIGINT AS c{i}" for i in range(6))
CENSUS_CUBE = f"""
WITH g AS (SELECT fips, CASE WHEN row_id % 7 = 0 THEN '' ELSE state END AS state, rel, row_id % 5 AS n FROM {C} WHERE row_id % 11 <> 0 AND row_id % 5 > 0)
SELECT 'county' AS level, fips AS key, {_SUMS} FROM g GROUP BY fips UNION ALL SELECT 'state', state, {_SUMS} FROM g WHERE state <> '' GROUP BY state UNION ALL SELECT 'country', '', {_SUMS} FROM g"""


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = pins(spark, sf_dir).groupBy("fips", "rel").agg(F.count("*").alias("n"))
    counted = pins(spark, sf_dir, "supplier").groupBy("fips", "rel").agg((F.count("*") * 15).alias("n"))
    r = gap_report(mapped, counted, ["fips", "rel"])
    return r.withColumn("note", F.when(F.col("fips") == "00008", "wards").otherwise("")).withColumn("rel", F.col("rel").cast("string"))


_REPORT = f"""(SELECT fips, rel::VARCHAR AS rel, coalesce(m.n, 0) AS mapped, coalesce(c.n, 0) AS census, coalesce(c.n, 0) - coalesce(m.n, 0) AS gap, CASE WHEN fips = '00008' THEN 'wards' ELSE '' END AS note
  FROM (SELECT fips, rel, count(*) AS n FROM {C} GROUP BY 1, 2) m FULL JOIN (SELECT fips, rel, count(*) * 15 AS n FROM {S} GROUP BY 1, 2) c USING (fips, rel))"""


def filtered_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest shortfalls of a class, without those that a note explains."""
    r = P.report_filter(_report(spark, sf_dir), rel="2", least_gap=2, without_note="wards")
    return P.by_gap(r).select("fips", "rel", "gap")


FILTERED_REPORT = f"SELECT fips, rel, gap FROM {_REPORT} WHERE rel = '2' AND abs(gap) >= 2 AND note <> 'wards'"


def gap_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.gap_totals(_report(spark, sf_dir), "rel")


GAP_TOTALS = f"SELECT rel, sum(greatest(gap, 0))::BIGINT AS positive_gap, sum(mapped)::BIGINT AS mapped, sum(census)::BIGINT AS census, (sum(census) - sum(mapped))::BIGINT AS difference FROM {_REPORT} GROUP BY rel"


def nested_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of toxicity by quality as one map a row, written as JSON."""
    return P.nested_counts(table(spark, sf_dir, "labels"), "quality", "toxic").select("quality", F.to_json("counts").alias("counts"))


NESTED_MAP = "SELECT quality, '{' || string_agg('\"' || toxic || '\":' || n, ',' ORDER BY toxic) || '}' AS counts FROM (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2) GROUP BY 1"


def distinct_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different hosts of secure pages, in order."""
    return P.distinct_values(table(spark, sf_dir, "pages"), F.regexp_extract("url", "^https://([^/:?#]+)", 1), F.col("url").startswith("https://"), "host")


DISTINCT_HOSTS = "SELECT DISTINCT regexp_extract(url, '^https://([^/:?#]+)', 1) AS host FROM pages WHERE starts_with(url, 'https://')"


def bake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory rows as places, with counters of what is skipped or has no class."""
    p = pins(spark, sf_dir).withColumn("st", F.when(F.col("row_id") % 10 == 0, "ZZ").otherwise("PA"))
    return R.bake_counters(R.baked(p.select("row_id", F.upper("name").alias("name"), F.lit("").alias("code"), "lat", "lon", F.col("st").alias("state"), F.col("segment").alias("city"))))


_CLASS = "CASE " + f"WHEN {sql_says('u', R.SKIPPED)} THEN NULL WHEN {sql_says('u', R.SCHOOLS)} AND NOT {sql_says('u', R.WORSHIP)} THEN NULL " + " ".join(f"WHEN {sql_says('u', w)} THEN '{c}'" for c, w in R.BY_NAME) + f" WHEN {sql_says('u', R.CHRISTIAN)} THEN 'christian' END"
BAKE = f"""
WITH b AS (SELECT *, CASE WHEN row_id % 10 = 0 THEN 'skipped' ELSE coalesce({_CLASS}, 'unclassified') END AS class FROM (SELECT *, upper(name) AS u FROM {C}))
SELECT class, count(*) AS n FROM b GROUP BY class"""


def unclassified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first forty directory names that have no class."""
    p = pins(spark, sf_dir).where(R.directory_class("name", F.lit("")).isNull())
    return first_rows(p, 40).select("row_id", "name")


UNCLASSIFIED = f"SELECT row_id, name FROM (SELECT *, name AS u FROM {C}) WHERE {_CLASS} IS NULL ORDER BY row_id LIMIT 40"


def review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten farthest moves and ten others of the snap plan."""
    plan = V.local_snaps(pins(spark, sf_dir, "supplier"), pins(spark, sf_dir), near_m=10_000.0).withColumn("mm", F.floor(F.col("move_m") * 1000 + 0.5))
    return far_and_random(plan, "mm", 10, 10, 5).select("row_id", "pick")


REVIEW_SAMPLE = f"""
WITH p AS (SELECT row_id, {_MM} AS mm FROM {_snaps(S, 10000)}), f AS (SELECT row_id FROM p ORDER BY mm DESC, row_id LIMIT 10)
SELECT row_id, 'far' AS pick FROM f UNION ALL
(SELECT row_id, 'random' FROM p WHERE row_id NOT IN (SELECT row_id FROM f) ORDER BY ((row_id + 5) % 2147483648) * 2654435761 % 4294967296, row_id LIMIT 10)"""


def quota_sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of two languages by their quotas, spread over sources."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "lang", "source")
    return quota_sample(d, "lang", {"en": 12, "fr": 5}, "source", 3).select("row_id", "lang", "source", "turn")


def _quota(lang: str, n: int) -> str:
    return f"""(SELECT row_id, lang, source, turn FROM (SELECT doc_id AS row_id, lang, source, row_number() OVER (PARTITION BY source ORDER BY ((doc_id + 3) % 2147483648) * 2654435761 % 4294967296, doc_id) AS turn FROM documents WHERE lang = '{lang}') ORDER BY turn, source LIMIT {n})"""


QUOTA_SAMPLE = f"SELECT * FROM {_quota('en', 12)} UNION ALL SELECT * FROM {_quota('fr', 5)}"


#: A page about a place, made of the columns of a pin.
_PAGE = (
    "concat('<html><title>x | y</title><h1 class=\"t\">', name, ' - The Convention site</h1>', if(row_id % 3 = 0, concat('<div class=\"church_meeting_addy\">', row_id, ' Main <b>Street</b><br/>Town, KY 4', lpad(row_id % 10000, 4, '0'), '</div>'),"
    " if(row_id % 3 = 1, concat('<p>', row_id, ' Old Mill Rd, Town, KY 40001-1234</p>'), '<p>PO Box 77<br>Town KY 40002</p>')),"
    " '<div class=\"marker\" data-lat=\"', cast(floor(lat * 1000) / 1000 as string), '\" data-lng=\"', cast(ceil(lon * 1000) / 1000 as string), '\"></div>')"
)


def place_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of the pages that are made of external pins."""
    pages = pins(spark, sf_dir, "supplier").selectExpr("row_id", "'u' AS url", f"{_PAGE} AS html")
    return parse_place_page(pages, "url", "html").select("row_id", "name", "address", "zip", "lat", "lon")


PLACE_PAGES = f"""
SELECT row_id, name, CASE row_id % 3 WHEN 0 THEN row_id || ' Main Street , Town, KY 4' || lpad((row_id % 10000)::VARCHAR, 4, '0') WHEN 1 THEN row_id || ' Old Mill Rd, Town, KY 40001-1234' ELSE 'PO Box 77 Town KY 40002' END AS address,
  CASE row_id % 3 WHEN 0 THEN '4' || lpad((row_id % 10000)::VARCHAR, 4, '0') WHEN 1 THEN '40001' ELSE '40002' END AS zip, floor(lat * 1000) / 1000 AS lat, ceil(lon * 1000) / 1000 AS lon FROM {S}"""


def page_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points out of the scripts of pages, one page a state; every eighth lies at sea."""
    p = pins(spark, sf_dir).withColumn("x", F.when(F.col("row_id") % 8 == 0, F.lit(-20.0)).otherwise(F.ceil(F.col("lon") * 1000) / 1000))
    point = F.format_string('{"lat":%.3f,"lng":%.3f,"name":"%s","slug":"s%d"}', F.floor(F.col("lat") * 1000) / 1000, "x", "name", "row_id")
    pages = p.groupBy("state").agg(F.concat_ws(",", F.collect_list(point)).alias("html"))
    pattern = r'\{"lat":(-?[\d.]+),"lng":(-?[\d.]+),"name":"([^"]*)","slug":"([^"]*)"\}'
    return parse_points(pages, "html", pattern).select("state", "slug", "name", "lat", "lon")


PAGE_POINTS = f"SELECT state, 's' || row_id AS slug, name, floor(lat * 1000) / 1000 AS lat, ceil(lon * 1000) / 1000 AS lon FROM {C} WHERE row_id % 8 <> 0"


def land_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a pin can't lie where it does, row by row."""
    e = edges_of(polygons(spark))
    return V.off_land(pins(spark, sf_dir), e.where("poly_id <> 'C'"), e.where("poly_id = 'C'"))


LAND_ROWS = f"""
WITH h AS (SELECT row_id, bool_or(poly_id <> 'C') AS land, bool_or(poly_id = 'C') AS lake FROM (SELECT row_id, poly_id FROM {C} CROSS JOIN {edges_sql()} GROUP BY 1, 2 HAVING {_INSIDE}) GROUP BY 1)
SELECT c.row_id, CASE WHEN lake THEN 'in-lake' WHEN NOT coalesce(land, false) THEN 'not-on-land' END AS why FROM {C} c LEFT JOIN h ON h.row_id = c.row_id"""


def provenance_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a pin comes from, and whether its name is a landmark's, by a made-up city."""
    p = pins(spark, sf_dir).withColumn("religion", F.element_at(F.array(*[F.lit(r) for r in R.RELIGIONS]), (F.col("rel") + 1).cast("int")))
    city = F.when(F.col("row_id") % 3 == 0, F.lit(" ")).otherwise(F.col("segment"))
    return p.select("row_id", R.provenance(city, "religion").alias("origin"), R.landmark(F.concat("name", F.when(F.col("row_id") % 4 == 0, F.lit(" Shrine")).otherwise(""))).alias("landmark"))


PROVENANCE = f"SELECT row_id, CASE WHEN rel = 2 THEN NULL WHEN row_id % 3 = 0 THEN 'gap' ELSE 'directory' END AS origin, row_id % 4 = 0 AS landmark FROM {C}"


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of a region in any case of letters, as the outline of a focus."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    shapes = n.select(F.col("n_nationkey").cast("string").alias("poly_id"), F.col("r_name").alias("state"), F.col("n_name").alias("county"))
    one = P.in_outline(shapes, county_id="3").unionByName(P.in_outline(shapes, state="AMERICA", county="nation_6"))
    return one.unionByName(P.in_outline(shapes, state="ASIA")).groupBy("poly_id", "state", "county").agg(F.count("*").alias("n"))


OUTLINES = """WITH o AS (SELECT n_nationkey::VARCHAR AS poly_id, r_name AS state, n_name AS county FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT poly_id, state, county, (poly_id = '3')::BIGINT + (state = 'AMERICA' AND lower(county) = 'nation_6')::BIGINT + (state = 'ASIA')::BIGINT AS n FROM o WHERE poly_id = '3' OR (state = 'AMERICA' AND lower(county) = 'nation_6') OR state = 'ASIA'"""

QUERIES = {
    "band_dupe_pairs": band_dupe_pairs, "local_snap_plan": local_snap_plan, "scorecard_rows": scorecard_rows, "scorecard_spans": scorecard_spans, "fuzzy_snap_plan": fuzzy_snap_plan, "snap_twins": snap_twins, "exact_spec_lookup": exact_spec_lookup,
    "candidate_actions": candidate_actions, "gap_rows": gap_rows, "guarded_moves": guarded_moves, "census_cube": census_cube_rows, "filtered_report": filtered_report, "gap_totals": gap_totals, "nested_map": nested_map,
    "place_pages": place_pages, "page_points": page_points, "land_rows": land_rows, "distinct_hosts": distinct_hosts, "bake": bake, "unclassified_sample": unclassified_sample, "review_sample": review_sample, "quota_sample": quota_sample_rows, "provenance": provenance_rows, "outlines": outlines,
}
SQL = {
    "band_dupe_pairs": BAND_DUPE_PAIRS, "local_snap_plan": LOCAL_SNAP_PLAN, "scorecard_rows": SCORECARD_ROWS, "scorecard_spans": SCORECARD_SPANS, "fuzzy_snap_plan": FUZZY_SNAP_PLAN, "snap_twins": SNAP_TWINS, "exact_spec_lookup": EXACT_SPEC,
    "candidate_actions": CANDIDATE_ACTIONS, "gap_rows": GAP_ROWS, "guarded_moves": GUARDED_MOVES, "census_cube": CENSUS_CUBE, "filtered_report": FILTERED_REPORT, "gap_totals": GAP_TOTALS, "nested_map": NESTED_MAP,
    "place_pages": PLACE_PAGES, "page_points": PAGE_POINTS, "land_rows": LAND_ROWS, "distinct_hosts": DISTINCT_HOSTS, "bake": BAKE, "unclassified_sample": UNCLASSIFIED, "review_sample": REVIEW_SAMPLE, "quota_sample": QUOTA_SAMPLE, "provenance": PROVENANCE, "outlines": OUTLINES,
}
