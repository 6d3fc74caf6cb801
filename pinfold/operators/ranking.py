"""Ranks within keys that one task need not hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spread_rank(df: DataFrame, by: list[str], levels: list[str], order: list, name: str) -> DataFrame:
    """Rank rows of each key ``by`` from 1, by ``levels`` and then ``order``.

    Offsets are running sums over the counts of each level, so that a key which holds a
    third of all rows is ranked by as many tasks as it has levels.  ``by`` and ``levels``
    must not be null.
    """
    offset = F.lit(0).cast("long")
    for depth in range(len(levels)):
        inner, outer = [*by, *levels[: depth + 1]], [*by, *levels[:depth]]
        counts = df.groupBy(*inner).agg(F.count("*").alias("c"))
        before = counts.select(*inner, (F.sum("c").over(Window.partitionBy(*outer).orderBy(levels[depth])) - F.col("c")).alias(f"before{depth}"))
        df, offset = df.join(before, inner), offset + F.col(f"before{depth}")
    ranked = df.withColumn(name, offset + F.row_number().over(Window.partitionBy(*by, *levels).orderBy(*order)))
    return ranked.drop(*[f"before{d}" for d in range(len(levels))])
