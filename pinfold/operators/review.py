"""Reviewing external pins against a directory, buildings and land: duplicates in a band,
snaps to a building of the same name, matches of candidates, and the scorecard of buckets.

Every step is an equi-join on cells and keys; the nearest, the only and the first partner
are aggregations, so a dense place or a common name is combined before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinfold.functions import rules as R
from pinfold.functions import text as T
from pinfold.functions.geo import haversine_m
from pinfold.operators.cells import distance_pairs, first_within, nearest, nearest_within
from pinfold.operators.name_pairs import matching_names, near_names, with_similar
from pinfold.operators.polygons import containing
from pinfold.plans import moves as M
from pinfold.runtime import materialise, shuffled

BUCKETS = ("name_junk", "hifld_dupe", "on_building", "local_snap", "impossible", "rural_expected")


def band_dupes(gaps: DataFrame, directory: DataFrame, low_m: float = 250.0, high_m: float = 1000.0, least: float = 0.7, neighbourhood: str = "radius") -> DataFrame:
    """``row_id, other, dist_m``: the nearest directory pin of the class in the band whose
    name tokens are similar or the same."""
    # tokens are told apart once a row, not once a pair
    told = lambda df: df.select("row_id", T.tokens_a("name").alias("t"), "rel", "lat", "lon")
    mine, other = matching_names(told(gaps), told(directory), high_m, (T.jaccard("t", "r_t") >= least) | (F.col("t") == F.col("r_t")))
    if neighbourhood == "radius":
        near = nearest_within(mine, other, high_m, ["rel", "t"], low_m=low_m)
    else:
        near = nearest(distance_pairs(mine, other, high_m, ["rel", "t"], neighbourhood=neighbourhood).where(F.col("dist_m") >= low_m))
    return near.select("row_id", F.col("r_row_id").alias("other"), "dist_m")


def _keyed(rows: DataFrame, least_tokens: int) -> DataFrame:
    tokens = T.tokens_a("name")
    return rows.where(F.size(tokens) >= least_tokens).withColumn("key", F.array_join(tokens, " "))


def local_snaps(gaps: DataFrame, areas: DataFrame, least_tokens: int = 2, low_m: float = 1500.0, near_m: float = 25_000.0, far_m: float = 100_000.0) -> DataFrame:
    """``row_id, name, action, area, new_lat, new_lon, move_m`` for pins that one building
    (``areas``: ``row_id, name, state, lat, lon``) of the same state and tokens is meant by.

    ``snap`` where exactly one lies at ``low_m`` to ``near_m``; ``review`` where none does
    but the only one of the state lies farther, up to ``far_m``.
    """
    pins, places = _keyed(gaps, least_tokens).select("row_id", "name", "state", "key", "lat", "lon"), _keyed(areas, least_tokens).select("row_id", "state", "key", "lat", "lon")
    close = nearest_within(pins.select("row_id", "state", "key", "lat", "lon"), places, near_m, ["state", "key"], low_m=low_m, enough=2).where("hits = 1")
    close = close.select("row_id", F.col("r_row_id").alias("area"), F.col("r_lat").alias("new_lat"), F.col("r_lon").alias("new_lon"), F.col("dist_m").alias("move_m"))
    snap = close.join(shuffled(pins.select("row_id", "name")), "row_id").select("row_id", "name", F.lit("snap").alias("action"), "area", "new_lat", "new_lon", "move_m")
    single = places.groupBy("state", "key").agg(F.count("*").alias("n"), F.min("row_id").alias("area"), F.min("lat").alias("new_lat"), F.min("lon").alias("new_lon")).where("n = 1")
    far = shuffled(pins).join(single, ["state", "key"]).withColumn("move_m", haversine_m("lat", "lon", "new_lat", "new_lon")).where((F.col("move_m") > near_m) & (F.col("move_m") <= far_m))
    return snap.unionByName(far.select("row_id", "name", F.lit("review").alias("action"), "area", "new_lat", "new_lon", "move_m"))


def small_areas(areas: DataFrame, most_m: float) -> DataFrame:
    """Areas whose box spans ``most_m`` at most (``span_m``): buildings, not grounds."""
    return areas.where(F.col("span_m") <= most_m)


def landmark_places(areas: DataFrame, most_m: float = 800.0, least_tokens: int = 2) -> DataFrame:
    """``state, key, places``: the buildings of each name in each state, ``areas(row_id, name,
    state, lat, lon, span_m)`` of ``most_m`` across at most.  ``key`` are the name's tokens,
    ``places`` structs in order of ``row_id``.  A name repeats in a state as often as it has
    such buildings there, so a row holds what one name has."""
    kept = _keyed(small_areas(areas, most_m), least_tokens)
    place = F.struct("row_id", "lat", "lon", "span_m")
    return kept.groupBy("state", "key").agg(F.array_sort(F.collect_list(place)).alias("places"))


def off_land(points: DataFrame, land: DataFrame, lakes: DataFrame) -> DataFrame:
    """``row_id, why`` of every point: in-lake, not-on-land, or null where it may lie."""
    on_land = containing(points, land).select("row_id", F.lit(True).alias("land"))
    in_lake = containing(points, lakes).select("row_id", F.lit(True).alias("lake"))
    placed = shuffled(points.select("row_id")).join(on_land, "row_id", "left").join(shuffled(in_lake), "row_id", "left")
    return placed.select("row_id", F.when(F.col("lake"), "in-lake").when(F.col("land").isNull(), "not-on-land").alias("why"))


def scorecard(gaps: DataFrame, directory: DataFrame, areas: DataFrame, land: DataFrame, lakes: DataFrame, building_m: float = 60.0, band: dict | None = None, near_span_m: float = 5000.0, snap_span_m: float = 800.0, **snap) -> DataFrame:
    """``row_id, bucket, detail`` of every external pin, in the first of ``BUCKETS`` that
    holds; ``land`` and ``lakes`` are edge tables, ``band`` and ``snap`` settings of the steps.
    Areas that tell their ``span_m`` count as buildings up to the two spans.

    A snap that shares its destination, or whose destination a pin of another name holds,
    is blocked: such a pin is ``rural_expected`` without the test for land, and its detail
    says why.  A pin to be reviewed goes on to the later buckets.

    What speaks for each bucket is a column of one table, and one expression picks the first
    that holds; only snaps, which block each other, wait for the pins that are left.
    Evidence is as long as the pins, so it is never broadcast.
    """
    base = materialise(gaps.withColumn("junk", R.drop_reason("name")), "scorecard-pins")
    live = base.where("junk is null").drop("junk")
    near_areas, snap_areas = (small_areas(areas, m) if "span_m" in areas.columns else areas for m in (near_span_m, snap_span_m))
    dupes = band_dupes(live, directory, **(band or {})).select("row_id", F.col("other").alias("dupe"))
    built = nearest_within(live.select("row_id", "lat", "lon"), near_areas.select("row_id", "lat", "lon"), building_m).select("row_id", F.col("r_row_id").alias("built"))
    told = materialise(shuffled(base).join(dupes, "row_id", "left").join(shuffled(built), "row_id", "left"), "scorecard-evidence")
    rest = told.where("junk is null and dupe is null and built is null").drop("junk", "dupe", "built")
    moves = materialise(local_snaps(rest, snap_areas, **snap).where("action = 'snap'"), "scorecard-moves")
    pins = gaps.select("row_id", "name", "lat", "lon").unionByName(directory.select("row_id", "name", "lat", "lon"))
    guarded = M.guard_occupied(M.guard_unique(moves), pins).select("row_id", F.col("area").alias("area"), "blocked")
    why = off_land(rest.select("row_id", "lat", "lon"), land, lakes)
    every = shuffled(told).join(guarded, "row_id", "left").join(shuffled(why), "row_id", "left")
    free, blocked = F.col("area").isNotNull() & F.col("blocked").isNull(), F.col("blocked").isNotNull()
    evidence = [(F.col("junk").isNotNull(), 0, "junk"), (F.col("dupe").isNotNull(), 1, "dupe"), (F.col("built").isNotNull(), 2, "built"), (free, 3, "area"), (blocked, 5, "blocked"), (F.col("why").isNotNull(), 4, "why")]
    bucket, detail = F.lit(BUCKETS[5]), F.lit(None).cast("string")
    for holds, k, says in reversed(evidence):
        bucket, detail = F.when(holds, BUCKETS[k]).otherwise(bucket), F.when(holds, F.col(says).cast("string")).otherwise(detail)
    return every.select("row_id", bucket.alias("bucket"), detail.alias("detail"))


def fuzzy_snaps(pins: DataFrame, places: DataFrame, within_m: float = 500.0, least_m: float = 15.0) -> DataFrame:
    """``row_id, reason, other, new_lat, new_lon``: where each pin goes that exactly one
    place of its state and class matches by name, and why the others stay."""
    mine = pins.withColumn("t", T.tokens_b("name"))
    told = lambda df: df.select("row_id", T.tokens_b("name").alias("t"), "state", "rel", "lat", "lon")
    dealt, other = matching_names(told(pins), told(places), within_m, T.name_match("t", "r_t"))
    met = nearest_within(dealt, other, within_m, ["state", "rel", "t"], enough=2)
    hits = met.select("row_id", "hits", F.struct("dist_m", "r_row_id", "r_lat", "r_lon").alias("h"))
    reason = R.first_of(
        [(F.size("t") < 2, "few_tokens"), (R.says("name", R.ADMIN_PINS), "admin_name"), (F.col("hits").isNull(), "no_match"), (F.col("hits") > 1, "not_unique"), (F.col("h.dist_m") < least_m, "already_there")], "snap"
    )
    told = mine.join(hits, "row_id", "left").withColumn("reason", reason)
    to = lambda c: F.when(F.col("reason") == "snap", F.col(f"h.{c}"))
    return told.select("row_id", "reason", to("r_row_id").alias("other"), to("r_lat").alias("new_lat"), to("r_lon").alias("new_lon"))


def twins_of(moves: DataFrame, gaps: DataFrame, within_m: float = 50.0) -> DataFrame:
    """``row_id`` of external pins that match a moved pin (``name, new_lat, new_lon``) by
    name near its destination."""
    ends = materialise(moves.select("row_id", T.tokens_b("name").alias("t"), F.col("new_lat").alias("lat"), F.col("new_lon").alias("lon")), "move-ends")
    dealt, other = matching_names(ends, gaps.select("row_id", T.tokens_b("name").alias("t"), "lat", "lon"), within_m, T.name_match("t", "r_t"))
    return distance_pairs(dealt, other, within_m, ["t"]).select(F.col("r_row_id").alias("row_id")).distinct()


def find_by_spec(specs: DataFrame, rows: DataFrame, within_m: float = 80.0) -> DataFrame:
    """``row_id`` (of the spec), ``other, dist_m``: the nearest row of exactly the name,
    state and class of each spec."""
    on = ["state", "rel", "name"]
    met = nearest_within(specs.select("row_id", *on, "lat", "lon"), rows.select("row_id", *on, "lat", "lon"), within_m, on)
    return met.select("row_id", F.col("r_row_id").alias("other"), "dist_m")


def match_candidates(candidates: DataFrame, mapped: DataFrame, match_m: float = 120.0, stack_m: float = 15.0) -> DataFrame:
    """``row_id, action, other, reason`` of every candidate.

    FILTER_DROP for a name that is none; GEOCODE_FAIL without coordinates; MATCH_EXISTING
    with the first row (by id, not distance) of a similar name within ``match_m``;
    STACK_DUP where an equal normal name lies within ``stack_m`` (that is, both empty); else
    APPEND_CANDIDATE.
    """
    told = candidates.withColumn("reason", R.drop_reason("name"))
    named = lambda df: df.select("row_id", F.coalesce("name", F.lit("")).alias("name"), "lat", "lon")
    mine, other = named(told.where("reason is null")), materialise(named(mapped), "mapped-names")
    names = materialise(with_similar(near_names(mine, other, match_m, "name"), "name", "r_name").where("similar or normal_a = normal_b").select("name", "r_name", "similar"), "similar-names")
    dealt = lambda which: mine.join(names.where(which), "name").drop("name").withColumnRenamed("r_name", "name")
    hit = first_within(dealt("similar"), other, match_m, ["name"]).withColumnRenamed("r_row_id", "hit")
    stack = distance_pairs(dealt("not similar"), other, min(match_m, stack_m), ["name"]).groupBy("row_id").agg(F.min("r_row_id").alias("stack"))
    first = hit.join(stack, "row_id", "full")
    action = R.first_of(
        [(F.col("reason").isNotNull(), "FILTER_DROP"), (F.col("lat").isNull() | F.col("lon").isNull(), "GEOCODE_FAIL"), (F.col("hit").isNotNull(), "MATCH_EXISTING"), (F.col("stack").isNotNull(), "STACK_DUP")],
        "APPEND_CANDIDATE",
    )
    return told.join(first, "row_id", "left").select("row_id", action.alias("action"), F.coalesce("hit", "stack").alias("other"), "reason")
