"""Similar names among pairs of rows, with Python for the few that nothing else decides.

Normal forms and most verdicts are column expressions: equal forms and nearly equal tokens
are similar, and texts whose lengths or letters differ too much cannot reach the ratio.
What is left is matched once for each pair of different names, however many pairs of rows
have it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from pinfold.functions import text as T
from pinfold.functions.matching import ratio
from pinfold.functions.geo import DEGREE_M, cell
from pinfold.operators.cells import within_reach
from pinfold.runtime import materialise, ship_package, shuffled

#: Pairs of different names that meet without a look at where they are.
EVERY_NAME = 1 << 20
#: Shared tokens of all tokens, and matched characters of all, from which names are similar.
LEAST_TOKENS, LEAST_RATIO = 0.85, 0.92


@F.pandas_udf(BooleanType())
def _matching(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) >= LEAST_RATIO for x, y in zip(a, b)], dtype="boolean")


def plain_normal(name: Column) -> Column:
    """``normal_name`` of a name of ASCII letters."""
    parts = T.words(F.regexp_replace(F.lower(name), r"[^a-z0-9_\s]", " "))
    parts = F.when((F.size(parts) > 1) & (parts[0] == "the"), F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
    kept = F.regexp_replace(F.array_join(parts, " "), rf"(?:(?:^| )(?:{'|'.join(T.COMPANY)}))+$", "")
    longer = F.create_map(*[F.lit(x) for pair in T.EXPAND.items() for x in pair])
    return F.array_join(F.transform(T.words(kept), lambda w: F.coalesce(longer[w], w)), " ")


def with_normal(rows: DataFrame, name: str, out: str) -> DataFrame:
    """``rows`` with the normal form of a name; null counts as empty.

    Names beyond ASCII, whose compatible forms only Unicode's tables know, are normalised
    once each and joined.
    """
    ship_package(rows.sparkSession)
    plain = F.coalesce(F.col(name), F.lit("")).rlike(r"^[\x00-\x7f]*$")
    other = rows.where(~plain).select(F.col(name).alias("np_name")).distinct().withColumn("np_normal", T.normal_names("np_name"))
    key = F.when(~plain, F.col(name))
    told = rows.withColumn("np_key", key).join(other, F.col("np_key") == F.col("np_name"), "left")
    return told.withColumn(out, F.when(plain, plain_normal(F.coalesce(F.col(name), F.lit("")))).otherwise(F.col("np_normal"))).drop("np_key", "np_name", "np_normal")


def _shared_letters(x: Column, y: Column) -> Column:
    """Letters that two texts have in common, each as often as both have it."""
    often = lambda t, c: F.length(t) - F.length(F.replace(t, c, F.lit("")))
    return F.aggregate(F.array_distinct(F.split(x, "")), F.lit(0), lambda n, c: n + F.least(often(x, c), often(y, c)))


def with_verdict(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """``pairs`` with ``verdict``: similar, not similar, or null where only the ratio of
    their normal names ``x`` and ``y`` tells."""
    a, b = F.col(x), F.col(y)
    s, t = T.words(a), T.words(b)
    both = F.length(a) + F.length(b)
    most = 2.0 * F.least(F.length(a), F.length(b)) / both
    verdict = (
        F.when((a == "") | (b == ""), F.lit(False)).when(a == b, F.lit(True)).when(F.size(F.array_intersect(s, t)) / F.size(F.array_union(s, t)) >= LEAST_TOKENS, F.lit(True))
        .when(most < LEAST_RATIO, F.lit(False)).when(2.0 * _shared_letters(a, b) / both < LEAST_RATIO, F.lit(False))
    )
    return pairs.withColumn("verdict", verdict)


def with_similar(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with ``normal_a, normal_b, similar``: whether two names are the same in
    normal form, share nearly all tokens, or match for the most part.  Null names are like
    empty ones, which are similar to nothing."""
    normal = with_normal(with_normal(pairs, a, "normal_a"), b, "normal_b")
    told = materialise(with_verdict(normal, "normal_a", "normal_b"), "name-pairs")
    open_ = told.where("verdict is null").select(F.col("normal_a").alias("na"), F.col("normal_b").alias("nb")).distinct().withColumn("ratio", _matching("na", "nb"))
    met = told.join(open_, F.col("verdict").isNull() & (F.col("normal_a") == F.col("na")) & (F.col("normal_b") == F.col("nb")), "left")
    return met.withColumn("similar", F.coalesce("verdict", "ratio")).drop("verdict", "na", "nb", "ratio")


def near_names(left: DataFrame, right: DataFrame, radius_m: float, name: str) -> DataFrame:
    """``name, r_name`` of different names: at least all those whose rows lie within the radius.

    Names meet in the cells they occur in, where a name counts once however many rows have
    it; or all of them meet, where that is less work because the same few are everywhere.
    """
    wide = DEGREE_M / (2 * radius_m)
    mine = materialise(within_reach(left.select(name, "lat", "lon"), radius_m, wide).select(name, "ci", "cj").distinct(), "names-near")
    other = materialise(right.where("lat is not null and lon is not null").select(F.col(name).alias(f"r_{name}"), cell("lat", wide).alias("ci"), cell("lon", wide).alias("cj")).distinct(), "names-there")
    a, b = (materialise(df.select(c).distinct(), "names") for df, c in ((mine, name), (other, f"r_{name}")))
    every = a.count() * b.count()
    if every > EVERY_NAME:
        often = lambda df, n: df.groupBy("ci", "cj").agg(F.count("*").alias(n))
        met = often(mine, "n").join(often(other, "m"), ["ci", "cj"]).agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0))).first()[0]
        if met < every:
            return shuffled(mine).join(other, ["ci", "cj"]).select(name, f"r_{name}").distinct()
    return a.repartition(a.sparkSession.sparkContext.defaultParallelism).crossJoin(b)


def matching_names(left: DataFrame, right: DataFrame, radius_m: float, match: Column, name: str = "t") -> tuple[DataFrame, DataFrame]:
    """Both tables, ready to be joined on equal ``name``: ``left`` has each row once for every
    name near it that ``match`` (on ``name`` and ``r_name``) finds for its own.

    Names are compared once for each pair of different ones, so rows of many copies of few
    names meet only partners that match.
    """
    pairs = materialise(near_names(left, right, radius_m, name).where(match), "name-matches")
    return left.join(pairs, name).drop(name).withColumnRenamed(f"r_{name}", name), right
