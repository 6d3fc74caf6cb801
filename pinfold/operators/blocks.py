"""Rows of equal keys as blocks: arrays of bounded length that a task can hold and multiply."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinfold.runtime import shuffled


def blocks(rows: DataFrame, at: list[str], fields: list[str], size: int) -> DataFrame:
    """``at``, and an array of each field in one order: about ``size`` rows a block, however
    many rows a key has.  Null keys are left out."""
    often = rows.groupBy(*at).agg(F.count("*").alias("n"))
    dealt = rows.join(shuffled(often), at).withColumn("part", F.pmod(F.xxhash64(*fields), F.ceil(F.col("n") / size)))
    held = dealt.groupBy(*at, "part").agg(F.collect_list(F.struct(*fields)).alias("held"))
    return held.select(*at, *[F.col(f"held.{f}").alias(f) for f in fields])


def arrays(batch: pa.RecordBatch, row: int, *columns: str) -> list[np.ndarray]:
    """The arrays of some columns of a row."""
    return [batch.column(batch.schema.get_field_index(c))[row].values.to_numpy(zero_copy_only=False) for c in columns]
