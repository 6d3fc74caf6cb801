"""Counts of pairs at a distance, without the pairs.

Rows are dealt to cells, and the rows of a cell are held in blocks of some thousand.  Blocks
of cells within reach meet in an equi-join, each pair of blocks once, and their distances
are one matrix product: chords between points of a sphere, seen from near by so that nothing
cancels.  Pairs are as many as they are, but only blocks are shuffled and only counts leave
a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinfold.functions.geo import DEGREE_M, EARTH_M, cell
from pinfold.runtime import arrow_map, shuffled

#: Rows of a block; rows of one that a product takes at once.
BLOCK, STRIP = 4096, 128
#: Part of a squared chord within which the distance itself decides.
_NEAR = 1e-8


def _sphere(lat: np.ndarray, lon: np.ndarray, lat0: float, lon0: float) -> np.ndarray:
    """Points of the unit sphere as seen from one of them: differences of near-by points keep
    their digits."""
    a, b = np.radians(lat), np.radians(lon)
    a0, b0 = math.radians(lat0), math.radians(lon0)
    # cos a cos b - cos a0 cos b0 and so on, by half angles
    da, db = a - a0, b - b0
    cos_b = -2 * np.sin(db / 2) ** 2
    x = np.cos(a) * cos_b + -2 * np.sin((a + a0) / 2) * np.sin(da / 2)
    y = np.cos(a) * np.sin(db)
    z = 2 * np.cos((a + a0) / 2) * np.sin(da / 2)
    return np.stack([x, y, z], axis=1)


def _metres(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    half = lambda x, y: np.sin((np.radians(y) - np.radians(x)) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.minimum(1.0, np.sqrt(half(a, c) + np.cos(np.radians(a)) * np.cos(np.radians(c)) * half(b, d))))


def count_between(lat: np.ndarray, lon: np.ndarray, r_lat: np.ndarray, r_lon: np.ndarray, low_m: float, high_m: float) -> int:
    """Pairs of two blocks whose distance is ``low_m`` to ``high_m``."""
    chord = lambda m: (2 * math.sin(min(m / (2 * EARTH_M), math.pi / 2))) ** 2
    marks = [(chord(low_m), low_m, False)] * (low_m > 0) + [(chord(high_m), high_m, True)]
    p, q = _sphere(lat, lon, lat[0], lon[0]), _sphere(r_lat, r_lon, lat[0], lon[0])
    wide = np.concatenate([-2 * q, np.ones((len(q), 1)), (q * q).sum(1)[:, None]], axis=1).T.copy()
    tall = np.concatenate([p, (p * p).sum(1)[:, None], np.ones((len(p), 1))], axis=1)
    total, noise = 0, 1e-14 * ((p * p).sum(1).max() + (q * q).sum(1).max())
    for start in range(0, len(p), STRIP):
        square = tall[start : start + STRIP] @ wide
        for mark, metres, upper in marks:
            below, above = mark * (1 - _NEAR) - noise, mark * (1 + _NEAR) + noise
            sure, maybe = np.count_nonzero(square < below), np.count_nonzero(square <= above)
            if maybe != sure:
                i, j = np.nonzero((square >= below) & (square <= above))
                m = _metres(lat[start + i], lon[start + i], r_lat[j], r_lon[j])
                sure += np.count_nonzero(m <= metres if upper else m < metres)
            total += sure if upper else -sure
    return int(total)


def _counts(low_m: float, high_m: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = adjacent = 0
        for batch in batches:
            lists = [batch.column(batch.schema.get_field_index(c)) for c in ("lats", "lons", "r_lats", "r_lons")]
            same, close = batch.column(batch.schema.get_field_index("same")).to_pylist(), batch.column(batch.schema.get_field_index("close")).to_pylist()
            for k in range(batch.num_rows):
                a, b, c, d = (x[k].values.to_numpy(zero_copy_only=False) for x in lists)
                n = count_between(a, b, c, d, low_m, high_m)
                if same[k]:
                    # every pair was met from both sides, and each row met itself
                    n = (n - (len(a) if low_m <= 0 else 0)) // 2
                pairs, adjacent = pairs + n, adjacent + (n if close[k] else 0)
        yield pa.RecordBatch.from_pydict({"pairs": pa.array([pairs], pa.int64()), "adjacent": pa.array([adjacent], pa.int64())})

    return run


def count_pairs(rows: DataFrame, low_m: float, high_m: float, on: list[str], per_degree: float = 100.0, key: str = "row_id") -> DataFrame:
    """One row, ``pairs, adjacent``: how many pairs of different rows with equal keys lie
    ``low_m`` to ``high_m`` apart, and how many of them in the same or adjacent cells of the
    grid of ``per_degree``.  Rows without a key or coordinates count with nothing."""
    at = [*on, "ci", "cj"]
    lean = rows.select(key, *on, "lat", "lon").where(" and ".join(f"{c} is not null" for c in [*on, "lat", "lon"]))
    lean = lean.withColumn("ci", cell("lat", per_degree)).withColumn("cj", cell("lon", per_degree))
    often = lean.groupBy(*at).agg(F.count("*").alias("n"))
    dealt = lean.join(shuffled(often), at).withColumn("part", F.pmod(F.xxhash64(key), F.ceil(F.col("n") / BLOCK)))
    block = dealt.groupBy(*at, "part").agg(F.collect_list(F.struct("lat", "lon")).alias("at")).select(*at, "part", F.col("at.lat").alias("lats"), F.col("at.lon").alias("lons"))
    side = DEGREE_M / per_degree
    top = F.least(F.lit(89.0), F.greatest(F.abs("ci"), F.abs(F.col("ci") + 1)) / per_degree + high_m / DEGREE_M)
    up, across = math.ceil(high_m / side * 1.001), F.greatest(F.lit(1), F.ceil(F.lit(high_m / side * 1.001) / F.cos(F.radians(top))).cast("int"))
    # half of the cells around, so that two cells meet from one side only
    steps = block.withColumn("di", F.explode(F.sequence(F.lit(0), F.lit(max(1, up))))).withColumn("dj", F.explode(F.sequence(-across, across))).where("di > 0 or dj >= 0")
    mine = steps.withColumn("close", F.col("di").between(-1, 1) & F.col("dj").between(-1, 1)).withColumn("ti", F.col("ci") + F.col("di")).withColumn("tj", F.col("cj") + F.col("dj"))
    other = block.select(*[F.col(c).alias(f"r_{c}") for c in block.columns])
    same_cell = (F.col("ti") == F.col("r_ci")) & (F.col("tj") == F.col("r_cj"))
    for c in on:
        same_cell = same_cell & (F.col(c) == F.col(f"r_{c}"))
    met = shuffled(mine).join(other, same_cell).where("di > 0 or dj > 0 or part <= r_part")
    told = met.select("lats", "lons", "r_lats", "r_lons", "close", F.expr("di = 0 and dj = 0 and part = r_part").alias("same"))
    counted = arrow_map(told, _counts(low_m, high_m), "pairs long, adjacent long")
    return counted.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("adjacent"), F.lit(0)).alias("adjacent"))
