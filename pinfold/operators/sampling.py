"""Seeded samples and quotas that come out alike on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pinfold.functions.hashing import hash01, jitter
from pinfold.operators.ranking import spread_rank

#: Ids that are ranked together.
RUN = 1 << 16


def seeded_key(row_id: Column, seed: int) -> Column:
    """A portable order that looks random: the id times an odd number, modulo 2**32."""
    return (F.pmod(row_id + seed, F.lit(1 << 31)) * F.lit(2654435761)) % (1 << 32)


def spread_sample(df: DataFrame, stratum: str, n: int, seed: int, row_id: str = "row_id") -> DataFrame:
    """``n`` rows dealt round-robin over the strata, each in a seeded order.

    At most ``n`` rows of a stratum can be wanted, so the window keeps only those.
    """
    w = Window.partitionBy(stratum).orderBy("pick_key", row_id)
    ranked = df.withColumn("pick_key", seeded_key(F.col(row_id), seed)).withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n)
    return ranked.orderBy("turn", stratum).limit(n).drop("pick_key")


def first_rows(df: DataFrame, k: int, row_id: str = "row_id") -> DataFrame:
    """The first ``k`` rows in scan order."""
    return df.orderBy(row_id).limit(k)


def quota_sample(df: DataFrame, bucket: str, quotas: dict, stratum: str, seed: int, row_id: str = "row_id") -> DataFrame:
    """As many rows of each bucket as its quota says, spread over the strata."""
    out = None
    for value, n in quotas.items():
        part = spread_sample(df.where(F.col(bucket) == value), stratum, n, seed, row_id)
        out = part if out is None else out.unionByName(part)
    return df.withColumn("turn", F.lit(0)).limit(0) if out is None else out


def far_and_random(df: DataFrame, length: str, n_far: int, n_random: int, seed: int, row_id: str = "row_id") -> DataFrame:
    """The farthest rows, and others in a seeded order; ``pick`` tells which."""
    far = df.orderBy(F.desc(length), row_id).limit(n_far).withColumn("pick", F.lit("far"))
    rest = df.join(far.select(row_id), row_id, "left_anti").withColumn("pick_key", seeded_key(F.col(row_id), seed))
    return far.unionByName(rest.orderBy("pick_key", row_id).limit(n_random).drop("pick_key").withColumn("pick", F.lit("random")))


def fill_quota(pins: DataFrame, needs: DataFrame, keys: list[str], row_id: str = "row_id") -> DataFrame:
    """Exactly ``need`` pins for each key of ``needs`` that has any pin.

    Real pins come first, in the order of their ids; where they are too few, pins jittered
    around them in turn make up the rest.  Returns ``keys, slot, source_id, synthetic, lat,
    lon``.  Keys without pins get none.
    """
    # keys without a need are out first; ids are ranked in runs of RUN, so no key is one task
    asked = pins.join(needs.where("need > 0").select(*keys), keys, "left_semi").withColumn("run", F.floor(F.col(row_id) / RUN))
    ranked = spread_rank(asked, keys, ["run"], [row_id], "nth").drop("run").join(asked.groupBy(*keys).agg(F.count("*").alias("have")), keys)
    wanted = ranked.join(needs.where("need > 0").select(*keys, "need"), keys).withColumn("need", F.col("need").cast("long"))
    real = wanted.where("nth <= need").select(*keys, F.col("nth").cast("long").alias("slot"), F.col(row_id).alias("source_id"), F.lit(False).alias("synthetic"), "lat", "lon")
    # the i-th extra pin stands around template i mod have; each template makes its own
    extra = wanted.where("need > have and nth <= need - have").withColumn("i", F.explode(F.expr("sequence(cast(nth - 1 as bigint), need - have - 1, have)")))
    key = F.concat(F.concat_ws(":", *[F.col(k).cast("string") for k in keys]), F.lit(":x"))
    lat, lon = jitter(F.col("lat"), F.col("lon"), hash01(key, F.col("i")), hash01(key, F.col("i") + 7919))
    made = extra.select(*keys, (F.col("have") + F.col("i") + 1).alias("slot"), F.col(row_id).alias("source_id"), F.lit(True).alias("synthetic"), lat.alias("lat"), lon.alias("lon"))
    return real.unionByName(made)


def click_stack(pins: DataFrame, x: float, y: float, hit: float = 24.0, penalty: float = 36.0, slack: float = 0.25) -> DataFrame:
    """Pins (screen ``x, y``) tied for nearest to a click, the rarer class first.

    ``synthetic`` pins count as farther by ``penalty``; only pins within ``hit`` are seen.
    At a coarse zoom these may be many: they are ranked class by class and by the beginnings
    of their names, not in one task.
    """
    d = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y) + F.when(F.col("synthetic"), penalty).otherwise(0.0)
    seen = pins.withColumn("d", d).where(F.col("d") <= hit * hit)
    best = seen.agg(F.min("d")).first()[0]
    tied = seen.where(F.lit(False) if best is None else F.col("d") <= best + slack)
    same = tied.groupBy("rel").agg(F.count("*").alias("same"))
    ranked = tied.join(F.broadcast(same), "rel").withColumn("all", F.lit(0)).withColumn("turn", F.struct("same", "rel"))
    # names as people order them: by letters, then by accents, then by case; beginnings by letters alone,
    # which no accent further on can turn around
    ranked = ranked.withColumn("start", F.collate(F.substring(F.coalesce("name", F.lit("")), 1, 12), "UNICODE_CI_AI"))
    return spread_rank(ranked, ["all"], ["turn", "start"], [F.collate("name", "UNICODE"), "row_id"], "nth").drop("same", "d", "all", "turn", "start")
