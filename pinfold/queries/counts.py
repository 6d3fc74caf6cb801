"""Queries of the independent count and of gaps in a part of the area, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pinfold.functions import rules as R
from pinfold.functions.geo import valid_county
from pinfold.operators.census import census_counties, census_groups, gaps_in_area
from pinfold.operators.cells import without_near
from pinfold.operators.dedupe import best_of
from pinfold.queries.names import _REASON, sql_says
from pinfold.queries.pins import pins, pins_sql
from pinfold.queries.reviews import _near

C, S = pins_sql(), pins_sql("supplier")
#: Groups of a census and the places of their classes, written down by hand; -1 is none.
GROUPS = (("Southern Baptist Convention", 0), ("Non-denominational", 0), ("Muslim Estimate", 2), ("Sikh", 5), ("Vedanta Society", 3), ("Zen Buddhism", 4), ("Conservative Judaism", 1), ("Bahai", -1), ("", -1))
STATES = (("Ohio", "OH"), ("New York", "NY"), ("Guam", ""), ("Kentucky", "KY"))
_pick = lambda values, k: f"element_at(array({', '.join(repr(v) for v in values)}), cast({k} % {len(values)} as int) + 1)"
_list = lambda values, k: f"list_extract([{', '.join(repr(v) for v in values)}], ({k} % {len(values)})::INT + 1)"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows of a census, made of the columns of a pin."""
    return pins(spark, sf_dir).selectExpr(
        "row_id", "if(row_id % 13 = 0, 'none', if(row_id % 2 = 0, concat(cast(rel + 1001 as string), '.0'), cast(rel + 1001 as string))) AS fips", f"{_pick([s for s, _ in STATES], 'row_id')} AS state_name",
        "concat(segment, if(row_id % 3 = 0, ' County', ' city and borough ')) AS county_name", "if(row_id % 17 = 0, 'Totals', '10') AS code", f"{_pick([g for g, _ in GROUPS], 'row_id')} AS group_name", "cast(row_id % 5 as string) AS congregations",
    )


_RAW = f"""(SELECT row_id, CASE WHEN row_id % 13 <> 0 THEN '0' || (rel + 1001) END AS fips, {_list([a for _, a in STATES], 'row_id')} AS state, segment AS county, {_list([p for _, p in GROUPS], 'row_id')} AS pos, row_id % 5 AS n
  FROM {C} WHERE row_id % 17 <> 0 AND row_id % {len(GROUPS)} <> {len(GROUPS) - 1})"""


def census_county_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each county by class, its state and its name."""
    found = census_counties(census_groups(_raw(spark, sf_dir)))
    return found.select("fips", "state", "county", *[F.element_at("counts", i + 1).alias(f"c{i}") for i in range(6)])


CENSUS_COUNTY_ROWS = f"""SELECT fips, max_by(state, row_id) AS state, max_by(county, row_id) AS county, {', '.join(f'coalesce(sum(n) FILTER (pos = {i}), 0)::BIGINT AS c{i}' for i in range(6))}
FROM {_RAW} WHERE n > 0 AND pos >= 0 AND fips IS NOT NULL GROUP BY fips"""


def census_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that count and rows that are skipped."""
    return census_groups(_raw(spark, sf_dir)).groupBy("skipped").agg(F.count("*").alias("n"))


CENSUS_SKIPPED = f"SELECT pos < 0 OR fips IS NULL AS skipped, count(*) AS n FROM {_RAW} WHERE pos < 0 OR n > 0 GROUP BY 1"

AREA = (40.02, 40.15, -74.95, -74.8)


def area_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gaps in a part of the area."""
    gaps = without_near(pins(spark, sf_dir, "supplier"), pins(spark, sf_dir), 250.0, ["rel"]).where(R.drop_reason("name").isNull())
    return gaps_in_area(gaps, AREA).select("row_id", "name", "state")


AREA_GAPS = f"""SELECT row_id, name, state FROM {S} s WHERE {_REASON} IS NULL AND lat BETWEEN {AREA[0]}e0 AND {AREA[1]}e0 AND lon BETWEEN {AREA[2]}e0 AND {AREA[3]}e0
AND row_id NOT IN (SELECT row_id FROM {_near(S, C, 250)})"""

COUNTIES = ("Adair", "N/A", " not available ", "")


def known_county_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each class and segment the pin that stays: a county that is named counts."""
    p = pins(spark, sf_dir).withColumn("county", F.expr(_pick(COUNTIES, "row_id")))
    return best_of(p, ["rel", "segment"], R.near_score("name", valid_county("county"), F.lit(""))).select("row_id", "rel", "segment")


KNOWN_COUNTY_FIRST = f"""SELECT row_id, rel, segment FROM {C} QUALIFY row_number() OVER (PARTITION BY rel, segment
  ORDER BY CASE WHEN {sql_says('name', R.NEAR_AGAINST)} THEN -3 ELSE 0 END DESC, CASE WHEN row_id % 4 = 0 THEN 2 ELSE 0 END DESC, length(name) DESC, row_id) = 1"""

QUERIES = {"census_counties": census_county_rows, "census_skipped": census_skipped, "area_gaps": area_gaps, "known_county_first": known_county_first}
SQL = {"census_counties": CENSUS_COUNTY_ROWS, "census_skipped": CENSUS_SKIPPED, "area_gaps": AREA_GAPS, "known_county_first": KNOWN_COUNTY_FIRST}
