"""Queries on what is prepared once and used often: the stored grid, covered polygons."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pinfold.functions import rules as R
from pinfold.functions import text as T
from pinfold.functions.geo import rounded
from pinfold.operators.cells import distance_pairs
from pinfold.operators.components import connected_components, merge_components
from pinfold.operators.covering import containing_prepared, prepare
from pinfold.operators.grid_index import GridIndex, in_view, indexed_pairs, write_grid_index
from pinfold.operators.polygons import edges_of, nearest_border
from pinfold.operators.review import landmark_places
from pinfold.queries.names import _REASON, sql_tokens
from pinfold.queries.pins import hav, nation_edges_sql, nation_rings, pins, pins_sql, round_sql
from pinfold.queries.places import _INSIDE
from pinfold.queries.reviews import _near
from pinfold.runtime import materialise, scratch_dir

C, S, E = pins_sql(), pins_sql("supplier"), nation_edges_sql()


def directory_index(spark: SparkSession, sf_dir: str, *keys: str) -> GridIndex:
    """The directory pins as a stored grid in the shared folder."""
    return write_grid_index(pins(spark, sf_dir), f"{scratch_dir(spark)}/grid-{uuid.uuid4().hex[:12]}", keys=keys)


def indexed_gap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a gap fill adds, matched twice with the one stored grid: first within 250 m, and
    of those that are left again within 600 m."""
    index, s = directory_index(spark, sf_dir, "rel"), pins(spark, sf_dir, "supplier").where(R.drop_reason("name").isNull())
    for radius in (250.0, 600.0):
        s = s.join(indexed_pairs(s.select("row_id", "rel", "lat", "lon"), index, radius).select("row_id").distinct(), "row_id", "left_anti")
    return s.select("row_id", "name", "state")


INDEXED_GAP_ROWS = f"SELECT row_id, name, state FROM {S} s WHERE {_REASON} IS NULL AND row_id NOT IN (SELECT row_id FROM {_near(S, C, 600)})"

VIEW = (40.05, 40.11, -74.92, -74.84)


def indexed_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directory pins in a box."""
    return in_view(spark, directory_index(spark, sf_dir), *VIEW).select("row_id", "name", "rel", "lat", "lon")


INDEXED_VIEW = f"SELECT row_id, name, rel, lat, lon FROM {C} WHERE lat BETWEEN {VIEW[0]}e0 AND {VIEW[1]}e0 AND lon BETWEEN {VIEW[2]}e0 AND {VIEW[3]}e0"


def covered_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nation whose ring holds each directory pin, by the covering of all rings."""
    return containing_prepared(pins(spark, sf_dir), prepare(edges_of(nation_rings(spark, sf_dir))))


COVERED_POINTS = f"SELECT row_id, min(poly_id) AS poly_id FROM (SELECT row_id, poly_id FROM {C} CROSS JOIN {E} GROUP BY 1, 2 HAVING {_INSIDE}) GROUP BY 1"


def ring_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest ring of each external pin, within a hundredth of a degree."""
    return nearest_border(pins(spark, sf_dir, "supplier"), edges_of(nation_rings(spark, sf_dir)), 0.01).select("row_id", "poly_id", rounded("deg", 7).alias("deg"))


_T = "CASE WHEN x1 = x2 AND y1 = y2 THEN 0e0 ELSE greatest(0e0, least(1e0, ((lon-x1)*(x2-x1)+(lat-y1)*(y2-y1))/((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))) END"
RING_BORDERS = f"""
WITH d AS (SELECT row_id, poly_id, sqrt((lon-x1-t*(x2-x1))*(lon-x1-t*(x2-x1)) + (lat-y1-t*(y2-y1))*(lat-y1-t*(y2-y1))) AS deg FROM (SELECT p.row_id, e.*, lat, lon, {_T} AS t FROM {S} p CROSS JOIN {E} e))
SELECT row_id, poly_id, {round_sql('deg', 7)} AS deg FROM d WHERE deg < 0.01 QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY floor(deg * 1e9 + 0.5), poly_id) = 1"""


def merged_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of pins of a class and segment within 500 m: those of every second pin are
    connected and stored, the links of the others are merged with them."""
    p = pins(spark, sf_dir).select("row_id", "rel", "segment", "lat", "lon")
    links = distance_pairs(p, p, 500.0, ["rel", "segment"]).where("row_id < r_row_id").select(F.col("row_id").alias("src"), F.col("r_row_id").alias("dst"))
    stored = materialise(connected_components(links.where("src % 2 = 0"), contract=True), "stored-components")
    return merge_components(stored, links.where("src % 2 <> 0")).withColumnRenamed("node", "row_id")


MERGED_COMPONENTS = f"""
WITH RECURSIVE p AS (SELECT * FROM {C}),
e AS (SELECT a.row_id AS u, b.row_id AS v FROM p a JOIN p b ON a.rel = b.rel AND a.segment = b.segment AND a.row_id <> b.row_id AND abs(a.lat - b.lat) <= 0.006 AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 500e0),
r AS (SELECT u, u AS w FROM e UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.w)
SELECT u AS row_id, min(w) AS component FROM r GROUP BY 1"""


def landmark_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The buildings of each name and state, their spans made of their numbers."""
    areas = pins(spark, sf_dir).withColumn("span_m", (F.col("row_id") * 37 % 1600).cast("double"))
    return landmark_places(areas).select("state", "key", F.size("places").cast("long").alias("n"), F.element_at("places", 1)["row_id"].alias("first"), F.element_at("places", -1)["row_id"].alias("last"))


LANDMARK_ROWS = f"""
WITH a AS (SELECT *, {sql_tokens('name', T.SAME_A, T.STOP_A)} AS t FROM {C} WHERE row_id * 37 % 1600 <= 800)
SELECT state, array_to_string(t, ' ') AS key, count(*) AS n, min(row_id) AS first, max(row_id) AS last FROM a WHERE len(t) >= 2 GROUP BY 1, 2"""


QUERIES = {"indexed_gap_rows": indexed_gap_rows, "indexed_view": indexed_view, "covered_points": covered_points, "ring_borders": ring_borders, "merged_components": merged_components, "landmark_rows": landmark_rows}
SQL = {"indexed_gap_rows": INDEXED_GAP_ROWS, "indexed_view": INDEXED_VIEW, "covered_points": COVERED_POINTS, "ring_borders": RING_BORDERS, "merged_components": MERGED_COMPONENTS, "landmark_rows": LANDMARK_ROWS}
