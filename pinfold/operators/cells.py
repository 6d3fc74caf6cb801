"""Distance joins by grid cells.

A distance predicate alone plans as a nested loop.  Here one side is dealt to all cells
within reach and meets the other in an equi-join on (keys, cell row, cell column), so the
plan is a hash or sort-merge join whose partitions grow with the number of true candidates.
The side that is multiplied should be the smaller one.

Cells are as wide as the reach unless a width is given, so a row is dealt to few of them.
Where only the nearest partners count, ``nearest_within`` looks a short way first, by the
density of the other side, and farther only for the rows that found too few: what a row
meets does not grow with the table.  Sizes of files tell nothing of rows that are dealt to
many cells, so these joins are never broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinfold.functions.geo import DEGREE_M, cell, haversine_m
from pinfold.runtime import discard, materialise, shuffled

#: Rows of a cell that a first look may meet; looks at most, each three times as far.
FEW, LOOKS, WIDER = 4, 9, 3


def within_reach(left: DataFrame, radius_m: float, per_degree: float, neighbourhood: str = "radius") -> DataFrame:
    """Each row of ``left`` once for every cell (``ci, cj``) that may hold a partner; rows
    without coordinates have none."""
    near = left.where("lat is not null and lon is not null").withColumn("ci", cell("lat", per_degree)).withColumn("cj", cell("lon", per_degree))
    if neighbourhood == "3x3":
        rows = cols = F.lit(1)
    else:
        side_m = DEGREE_M / per_degree
        rows = F.lit(math.ceil(radius_m / side_m))
        # the widest reach of a row is at its latitude nearest to a pole
        top = F.least(F.lit(89.0), F.abs("lat") + radius_m / DEGREE_M)
        cols = F.ceil(F.lit(radius_m / side_m) / F.cos(F.radians(top))).cast("int")
    return near.withColumn("ci", F.explode(F.sequence(F.col("ci") - rows, F.col("ci") + rows))).withColumn("cj", F.explode(F.sequence(F.col("cj") - cols, F.col("cj") + cols)))


def _grid(reach_m: float) -> float:
    """Cells per degree that are just wider than the reach, and a metre at least."""
    return DEGREE_M / (max(reach_m, 1.0) * 1.001)


def distance_pairs(
    left: DataFrame, right: DataFrame, radius_m: float, on: list[str] | None = None, per_degree: float | None = None, neighbourhood: str = "radius"
) -> DataFrame:
    """Pairs of ``left`` and ``right`` rows whose cells lie near each other and whose
    distance is at most ``radius_m``, with the distance as ``dist_m``.

    Columns of the right side get the prefix ``r_``.  ``on`` names key columns that must be
    equal.  ``left`` is the side that is multiplied.  ``neighbourhood`` is ``radius`` (all
    cells the radius can reach, at any latitude) or ``3x3`` (the adjacent cells only, which
    is narrower than the radius where cells are small).  Cells are as wide as the radius, or
    ``per_degree``; for ``3x3`` a hundredth of a degree unless given.  Rows without
    coordinates pair with nothing.  Longitudes do not wrap around.
    """
    on = on or []
    if per_degree is None:
        per_degree = 100.0 if neighbourhood == "3x3" else _grid(radius_m)
    named = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).where("r_lat is not null and r_lon is not null")
    named = named.withColumn("r_ci", cell("r_lat", per_degree)).withColumn("r_cj", cell("r_lon", per_degree))
    near = within_reach(left, radius_m, per_degree, neighbourhood)
    same = [F.col("ci") == F.col("r_ci"), F.col("cj") == F.col("r_cj"), *[F.col(k) == F.col(f"r_{k}") for k in on]]
    met = shuffled(near).join(named, same).drop("ci", "cj", "r_ci", "r_cj")
    return met.withColumn("dist_m", haversine_m("lat", "lon", "r_lat", "r_lon")).where(F.col("dist_m") <= radius_m)


def cell_window_pairs(left: DataFrame, right: DataFrame, k: int, per_degree: float, on: list[str] | None = None) -> DataFrame:
    """All pairs whose cells are at most ``k`` rows and columns apart, with ``dist_m``."""
    on = on or []
    named = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).withColumn("r_ci", cell("r_lat", per_degree)).withColumn("r_cj", cell("r_lon", per_degree))
    steps = F.array(*[F.lit(i) for i in range(-k, k + 1)])
    near = left.withColumn("ci", F.explode(F.transform(steps, lambda s: cell("lat", per_degree) + s))).withColumn("cj", F.explode(F.transform(steps, lambda s: cell("lon", per_degree) + s)))
    same = [F.col("ci") == F.col("r_ci"), F.col("cj") == F.col("r_cj"), *[F.col(c) == F.col(f"r_{c}") for c in on]]
    return shuffled(near).join(named, same).drop("ci", "cj", "r_ci", "r_cj").withColumn("dist_m", haversine_m("lat", "lon", "r_lat", "r_lon"))


def nearest(pairs: DataFrame, key: str = "row_id", other: str = "r_row_id", hits: bool = False) -> DataFrame:
    """The nearest partner of each row; the smaller id wins a tie.  Combined map-side.
    ``hits`` adds how many there are."""
    carried = [c for c in pairs.columns if c.startswith("r_") and c not in (key, other)]
    best = F.min(F.struct(F.floor(F.col("dist_m") * 1000 + 0.5).alias("mm"), F.col(other), "dist_m", *carried))
    out = pairs.groupBy(key).agg(best.alias("best"), *([F.count("*").alias("hits")] if hits else []))
    return out.select(key, F.col(f"best.{other}").alias(other), F.col("best.dist_m").alias("dist_m"), *[F.col(f"best.{c}").alias(c) for c in carried], *(["hits"] if hits else []))


def reaches(right: DataFrame, radius_m: float, on: list[str] | None = None, low_m: float = 0.0) -> list[float]:
    """How far to look, step by step, the last time to the radius: a first look meets about
    ``FEW`` rows of equal keys a cell, by an estimate that decides nothing but the cost."""
    each = [low_m + (radius_m - low_m) / WIDER**k for k in range(LOOKS)]
    cells = [F.approx_count_distinct(F.xxhash64(*(on or []), cell("lat", _grid(r)), cell("lon", _grid(r)))).alias(f"c{k}") for k, r in enumerate(each)]
    told = right.where("lat is not null and lon is not null").agg(F.count("*").alias("n"), *cells).first()
    first = next((k for k in range(LOOKS) if told["n"] <= FEW * told[f"c{k}"]), LOOKS - 1)
    return each[first::-1]


def nearest_within(left: DataFrame, right: DataFrame, radius_m: float, on: list[str] | None = None, match: Column | None = None, low_m: float = 0.0, enough: int = 1, key: str = "row_id") -> DataFrame:
    """``nearest`` of the pairs at ``low_m`` to ``radius_m`` that ``match``, and ``hits``: how
    many there are, of which those beyond ``enough`` may be left out.

    ``left`` may hold a key several times, to meet several values of ``on``; no pair may be
    met twice.  A row that has ``enough`` partners, the nearest of them surely so, looks no
    farther.
    """
    mine = left.where("lat is not null and lon is not null")
    steps = reaches(right, radius_m, on, low_m)
    if len(steps) > 1:
        mine, right = materialise(mine, "nearest-left"), materialise(right, "nearest-right")
    found = None
    for reach in steps:
        pairs = distance_pairs(mine, right, reach, on)
        pairs = pairs if low_m <= 0 else pairs.where(F.col("dist_m") >= low_m)
        best = nearest(pairs if match is None else pairs.where(match), key, hits=True)
        if len(steps) == 1:
            return best
        best = materialise(best, "nearest-best")
        # within the last millimetre a partner not yet seen may be as near and have a smaller id
        done = best if reach == steps[-1] else best.where((F.col("hits") >= enough) & (F.col("dist_m") < reach - 0.001))
        found = done if found is None else found.unionByName(done)
        if reach != steps[-1]:
            left_over = materialise(shuffled(mine).join(done.select(key), key, "left_anti"), "nearest-left")
            discard(mine)
            mine = left_over
            if mine.isEmpty():
                break
    return found


def first_within(left: DataFrame, right: DataFrame, radius_m: float, on: list[str] | None = None, key: str = "row_id") -> DataFrame:
    """``row_id, r_row_id``: the partner of the smallest id within the radius.

    The rows with the smallest ids are looked at first, then four times as many, and so on;
    a row that finds one among them looks no farther.  Where to cut is an estimate, and
    decides nothing but the cost.
    """
    told = right.where("lat is not null and lon is not null").agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64(*(on or []), cell("lat", _grid(radius_m)), cell("lon", _grid(radius_m)))).alias("c")).first()
    looks = max(0, math.ceil(math.log(max(1.0, told["n"] / (FEW * max(1, told["c"]))), 4)))
    mine, found = materialise(left, "first-left") if looks else left, None
    cuts = right.agg(F.percentile_approx(key, [4.0**-k for k in range(looks, 0, -1)], 10000)).first()[0] if looks else []
    for cut in [*cuts, None]:
        some = right if cut is None else right.where(F.col(key) <= F.lit(cut))
        best = distance_pairs(mine, some, radius_m, on).groupBy(key).agg(F.min(f"r_{key}").alias(f"r_{key}"))
        if not looks:
            return best
        best = materialise(best, "first-best")
        found = best if found is None else found.unionByName(best)
        if cut is not None:
            left_over = materialise(shuffled(mine).join(best.select(key), key, "left_anti"), "first-left")
            discard(mine)
            mine = left_over
            if mine.isEmpty():
                break
    return found


def without_near(left: DataFrame, right: DataFrame, radius_m: float, on: list[str] | None = None, key: str = "row_id", **options) -> DataFrame:
    """Rows of ``left`` with no partner in ``right`` within the radius: the gaps."""
    return left.join(distance_pairs(left, right, radius_m, on, **options).select(key).distinct(), key, "left_anti")


def nearest_in_window(left: DataFrame, right: DataFrame, k: int, per_degree: float) -> DataFrame:
    """``nearest`` of ``cell_window_pairs``.  Whatever lies within ``k`` cells' width is in the
    window, so rows look there first; only those that find nothing meet the whole window."""
    sure = k / per_degree * DEGREE_M * 0.999
    # a degree of longitude is shortest where a row lies nearest to a pole
    narrow = left.agg(F.max(F.abs("lat"))).first()[0]
    sure *= math.cos(math.radians(min(89.0, (narrow or 0.0) + k / per_degree)))
    mine = materialise(left.where("lat is not null and lon is not null"), "window-left")
    near = materialise(nearest_within(mine, right, sure).drop("hits"), "window-near").where(F.col("dist_m") < sure - 0.001)
    rest = shuffled(mine).join(near.select("row_id"), "row_id", "left_anti")
    return near.unionByName(nearest(cell_window_pairs(rest, right, k, per_degree)))


def only_partner(pairs: DataFrame, key: str = "row_id") -> DataFrame:
    """Pairs of the rows that have exactly one partner."""
    return pairs.join(pairs.groupBy(key).agg(F.count("*").alias("partners")).where("partners = 1"), key).drop("partners")
