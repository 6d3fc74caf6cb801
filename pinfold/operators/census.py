"""The independent count: raw rows of a census of groups, by county and class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinfold.functions import rules as R
from pinfold.functions.geo import in_box
from pinfold.functions.present import state_code
from pinfold.operators.report import by_state_and_name

#: Endings that county names are shown without: fixed values.
ENDINGS = "County|Parish|Borough|Census Area|Municipality|City and Borough"


def census_groups(raw: DataFrame) -> DataFrame:
    """``row_id, fips, state, county, pos, n, skipped`` of ``raw(row_id, fips, state_name,
    county_name, code, group_name, congregations)``.

    Rows without a group, totals, and counts of zero and less are left out.  ``skipped``
    marks rows of other faiths, and those whose code is no number: they stay to be counted
    and belong to no county.  ``pos`` is the place of the class; states that are none are
    empty, codes have five digits.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    cls = R.census_class("group_name")
    place = F.coalesce(*[F.when(cls == r, F.lit(k)) for k, r in enumerate(R.RELIGIONS)])
    digits = F.regexp_replace(text("fips"), r"\.0$", "")
    code = F.when(digits.rlike("^[0-9]+$"), F.when(F.length(digits) < 5, F.lpad(digits, 5, "0")).otherwise(digits))
    told = raw.select(
        "row_id", code.alias("fips"), F.coalesce(state_code(text("state_name")), F.lit("")).alias("state"), F.trim(F.regexp_replace(text("county_name"), rf"(?i)\s+(?:{ENDINGS})\s*$", "")).alias("county"),
        place.alias("pos"), F.coalesce(F.col("congregations").cast("double").cast("long"), F.lit(0)).alias("n"), (text("group_name") != "").alias("named"), (F.lower(text("code")) == "totals").alias("total"),
    )
    told = told.withColumn("skipped", F.col("pos").isNull() | F.col("fips").isNull())
    return told.where("named and not total and (n > 0 or pos is null)").drop("named", "total")


def census_counties(groups: DataFrame, size: int = len(R.RELIGIONS)) -> DataFrame:
    """``fips, counts, state, county`` of the rows that count; state and name are those of a
    county's last row."""
    kept = groups.where("not skipped")
    sums = F.array(*[F.coalesce(F.sum(F.when(F.col("pos") == i, F.col("n"))), F.lit(0)).cast("long") for i in range(size)])
    last = F.max_by(F.struct("state", "county"), F.col("row_id"))
    return kept.groupBy("fips").agg(sums.alias("counts"), last.alias("last")).select("fips", "counts", "last.state", "last.county")


def gaps_in_area(gaps: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Gaps in a part of the area (south, north, west, east), in order of state and name."""
    return by_state_and_name(gaps.where(in_box("lat", "lon", box)))
