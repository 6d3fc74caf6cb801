"""Similarity joins of token sets by their rarest tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinfold.functions import text as T
from pinfold.runtime import materialise


def similar_sets(rows: DataFrame, name: str, tokens: str, least: float, on: list[str] | None = None) -> DataFrame:
    """Pairs ``name < r_name`` of rows whose ``tokens`` (arrays of different tokens) have a
    similarity of ``least`` and more, or of which one holds the other (``T.name_match``).

    Two sets of similarity j share one of the ``size - ceil(j * size) + 1`` rarest tokens of
    each, so they meet on those; a set within another one has its rarest token there, so it
    meets all tokens of others with that one only.
    """
    on = on or []
    each = rows.select(name, *on, F.explode(tokens).alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("n"))
    ranked = each.join(often, "token").groupBy(name, *on).agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("by_n"))
    ranked = materialise(ranked.select(name, *on, F.transform("by_n", lambda x: x["token"]).alias("all")), "token-ranks")
    prefix = F.slice("all", F.lit(1), (F.size("all") - F.ceil(F.size("all") * least) + 1).cast("int"))
    # way 0: rare tokens on both sides; way 1: the rarest token of a set that may lie within another
    way = lambda k, found: F.transform(found, lambda t: F.struct(F.lit(k).alias("way"), t.alias("token")))
    first = F.when(F.size("all") >= 2, F.slice("all", 1, 1)).otherwise(F.slice("all", 1, 0))
    keys = ranked.select(name, *on, F.inline(F.concat(way(0, prefix), way(1, first))))
    held = ranked.select(F.col(name).alias(f"r_{name}"), *[F.col(c).alias(f"r_{c}") for c in on], F.inline(F.concat(way(0, prefix), way(1, F.when(F.size("all") >= 2, F.col("all")).otherwise(F.slice("all", 1, 0))))))
    met = keys.join(held, ["way", "token"]).where((F.col(name) < F.col(f"r_{name}")) | (F.col("way") == 1) & (F.col(name) != F.col(f"r_{name}")))
    for c in on:
        met = met.where(F.col(c) == F.col(f"r_{c}"))
    ends = met.select(F.least(name, f"r_{name}").alias(name), F.greatest(name, f"r_{name}").alias(f"r_{name}")).distinct()
    left, right = rows.select(name, F.col(tokens).alias("t"), *on), rows.select(F.col(name).alias(f"r_{name}"), F.col(tokens).alias("r_t"))
    return ends.join(left, name).join(right, f"r_{name}").where((T.jaccard("t", "r_t") >= least) | T.name_match("t", "r_t"))
