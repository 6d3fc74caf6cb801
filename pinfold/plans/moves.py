"""Plans to drop and to move rows, guards on them, and the ledger of what was done.

A plan is a table; computing it changes nothing, applying it is a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinfold.functions.geo import coord_key
from pinfold.operators.cells import nearest_within
from pinfold.runtime import shuffled


def apply_drops(rows: DataFrame, plan: DataFrame, row_id: str = "row_id") -> DataFrame:
    return rows.join(plan.select(row_id).distinct(), row_id, "left_anti")


def apply_moves(rows: DataFrame, plan: DataFrame, row_id: str = "row_id") -> DataFrame:
    """New coordinates from ``plan(row_id, new_lat, new_lon)``, one move a row at most;
    ``moved`` tells where."""
    to = plan.select(row_id, "new_lat", "new_lon")
    out = rows.join(to, row_id, "left").withColumn("moved", F.col("new_lat").isNotNull())
    return out.withColumn("lat", F.coalesce("new_lat", "lat")).withColumn("lon", F.coalesce("new_lon", "lon")).drop("new_lat", "new_lon")


def with_destination(plan: DataFrame) -> DataFrame:
    return plan.withColumn("d_lat", coord_key("new_lat")).withColumn("d_lon", coord_key("new_lon"))


def guard_unique(plan: DataFrame, also: list[str] | None = None) -> DataFrame:
    """Moves whose destination no other move shares; ``blocked`` says which are not."""
    at = ["d_lat", "d_lon", *(also or [])]
    ends = with_destination(plan)
    shared = ends.groupBy(*at).agg(F.count("*").alias("moves"))
    return ends.join(shared, at).withColumn("blocked", F.when(F.col("moves") > 1, "shared_destination")).drop("moves")


def guard_occupied(plan: DataFrame, rows: DataFrame) -> DataFrame:
    """Block moves to a place that a row of another name holds; what is blocked stays as it is."""
    free = plan.where("blocked is null")
    held = rows.select(coord_key("lat").alias("d_lat"), coord_key("lon").alias("d_lon"), F.col("name").alias("h_name")).distinct()
    taken = free.join(shuffled(held), ["d_lat", "d_lon"]).where("h_name <> name").select("row_id").distinct().withColumn("occupied", F.lit(True))
    return shuffled(plan).join(taken, "row_id", "left").withColumn("blocked", F.coalesce("blocked", F.when(F.col("occupied"), "occupied"))).drop("occupied")


def guard_near(plan: DataFrame, rows: DataFrame, within_m: float = 30.0) -> DataFrame:
    """Block moves to a place within so many metres of another row; what is blocked stays
    as it is and is not looked at."""
    ends = plan.where("blocked is null").select("row_id", F.col("new_lat").alias("lat"), F.col("new_lon").alias("lon"))
    close = nearest_within(ends, rows.select("row_id", "lat", "lon"), within_m, match=F.expr("row_id <> r_row_id")).select("row_id", F.lit(True).alias("close"))
    return plan.join(close, "row_id", "left").withColumn("blocked", F.coalesce("blocked", F.when(F.col("close"), "near_occupied"))).drop("close")


def match_plan(plan: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows that a plan with ``p_lat, p_lon`` (five decimals, whole numbers) and ``name``
    means: those of the same name at that place, or all there if none has it; ``row_id``
    is null where nothing is there."""
    held = rows.select(coord_key("lat").alias("p_lat"), coord_key("lon").alias("p_lon"), "row_id", F.col("name").alias("r_name"))
    met = plan.join(held, ["p_lat", "p_lon"], "left").withColumn("eq", F.col("name") == F.col("r_name"))
    best = met.groupBy("plan_id").agg(F.max("eq").alias("best"))
    return met.join(best, "plan_id").where("row_id is null or eq or not best").drop("best", "eq", "r_name")


def replace_class(rows: DataFrame, fresh: DataFrame, column: str, value) -> DataFrame:
    """All rows of one class replaced by others."""
    return rows.where(F.col(column) != value).unionByName(fresh)


def ledger(stages: list[tuple[str, DataFrame]], by: str | None = None) -> DataFrame:
    """Counts after each stage, in all and by class: ``step, stage, class, n``."""
    out = None
    for k, (name, df) in enumerate(stages):
        rows = df.groupBy(*([by] if by else [])).agg(F.count("*").alias("n"))
        part = rows.select(F.lit(k).alias("step"), F.lit(name).alias("stage"), (F.col(by).cast("string") if by else F.lit("all")).alias("class"), "n")
        out = part if out is None else out.unionByName(part)
    return out
