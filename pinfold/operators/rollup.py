"""Roll-ups, count vectors, and the report of gaps against an independent count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, FractionalType, NumericType

from pinfold.functions.geo import clean_fips
from pinfold.runtime import broadcast_checked, materialise

#: Values of a key that bound the ranges its values are counted in, about; exactness of the
#: sketch of a key, as a part of its rows.
BUCKETS, SKETCH = 1024, 1000


def levels(df: DataFrame, outer: str, inner: str, measures: dict) -> DataFrame:
    """Totals of all, of each ``outer`` and of each (``outer``, ``inner``) in one pass;
    ``level`` is 0, 1 or 2 and the keys above it are null."""
    named = [m.alias(k) for k, m in measures.items()]
    out = df.groupingSets([[], [outer], [outer, inner]], outer, inner).agg(F.grouping_id().alias("gid"), *named)
    return out.select((F.when(F.col("gid") == 3, 0).when(F.col("gid") == 1, 1).otherwise(2)).alias("level"), outer, inner, *measures)


def at_focus(rolled: DataFrame, outer: str, inner: str, state: str | None = None, county: str | None = None) -> DataFrame:
    """The row of the level that a focus selects: county, else state, else all."""
    if county is not None:
        return rolled.where((F.col("level") == 2) & (F.col(outer) == state) & (F.col(inner) == county))
    return rolled.where((F.col("level") == 1) & (F.col(outer) == state)) if state is not None else rolled.where("level = 0")


def count_vectors(df: DataFrame, key: list[str], position: str, size: int, amount: str) -> DataFrame:
    """Dense vector ``counts`` of ``size`` sums by ``position`` (from 0) for each key;
    amounts of zero and less are left out."""
    kept = df.where(F.col(amount) > 0)
    sums = [F.coalesce(F.sum(F.when(F.col(position) == i, F.col(amount))), F.lit(0)).cast("long") for i in range(size)]
    return kept.groupBy(*key).agg(F.array(*sums).alias("counts"))


def vector_total(vectors: DataFrame, active: list[int], name: str = "total") -> DataFrame:
    """Sum of the selected positions; keys whose sum is zero are left out."""
    total = F.aggregate(F.array(*[F.element_at("counts", i + 1) for i in active]), F.lit(0).cast("long"), lambda a, x: a + x)
    return vectors.withColumn(name, total).where(F.col(name) > 0)


def census_cube(groups: DataFrame, size: int) -> DataFrame:
    """``level, key, counts`` of ``groups(fips, state, pos, n)`` by county, by state and for
    the whole country.

    Counts of zero and less, and rows without a county code, are left out; rows without a
    known state count for the country.
    """
    valid = groups.withColumn("fips", clean_fips("fips")).where((F.col("n") > 0) & (F.col("fips") != ""))
    sums = F.array(*[F.coalesce(F.sum(F.when(F.col("pos") == i, F.col("n"))), F.lit(0)).cast("long") for i in range(size)])
    out = valid.withColumn("state", F.coalesce("state", F.lit(""))).groupingSets([["fips"], ["state"], []], "fips", "state").agg(F.grouping_id().alias("gid"), sums.alias("counts"))
    level = F.when(F.col("gid") == 1, "county").when(F.col("gid") == 2, "state").otherwise("country")
    return out.select(level.alias("level"), F.coalesce("fips", "state", F.lit("")).alias("key"), "counts").where("level <> 'state' or key <> ''")


def label_of(df: DataFrame, key: str, label: str, row_id: str, last: bool) -> DataFrame:
    """One label of each key: that of the last row, or of the first."""
    pick = F.max_by if last else F.min_by
    return df.groupBy(key).agg(pick(label, row_id).alias(label))


def gap_report(mapped: DataFrame, counted: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of two counts ``n`` by the same keys: ``mapped, census, gap, pct``.

    ``gap`` is what the independent count has more; ``pct`` of it to one decimal, null
    where the count is zero.
    """
    m, c = mapped.select(*keys, F.col("n").alias("mapped")), counted.select(*keys, F.col("n").alias("census"))
    both = m.join(c, keys, "full").select(*keys, F.coalesce("mapped", F.lit(0)).cast("long").alias("mapped"), F.coalesce("census", F.lit(0)).cast("long").alias("census"))
    gap = F.col("census") - F.col("mapped")
    return both.withColumn("gap", gap).withColumn("pct", F.floor(F.col("gap") * 1000.0 / F.nullif(F.col("census"), F.lit(0)) + 0.5) / 10.0)


def upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The element in the middle of the sorted values, the upper one of two; nulls are left
    out, keys without values absent.  Values may be of any ordered type.  Null keys are keys
    of numbers, and left out of other types.

    Numbers take two passes: a sketch of each key gives two values between which the middle
    must lie, and one aggregation counts what is below and each value between.  Only the
    values between, a few thousandths of a key, are ranked.  Other types are counted and
    ranked in parts that a sample of their values bounds.
    """
    kept = df.where(F.col(value).isNotNull())
    if not isinstance(df.schema[value].dataType, NumericType):
        return _sampled_median(kept, by, value)
    # a sketch knows no order of what is not a number: the largest there is stands for it
    real = isinstance(df.schema[value].dataType, FractionalType) and not isinstance(df.schema[value].dataType, DecimalType)
    plain = F.when(F.isnan(value), F.lit(float("inf"))).otherwise(F.col(value)) if real else F.col(value)
    around = F.percentile_approx(plain, F.array(F.lit(0.5 - 2 / SKETCH), F.lit(0.5 + 2 / SKETCH)), F.lit(SKETCH))
    sketch = materialise(kept.groupBy(*by).agg(around.alias("mid"), F.count("*").alias("n")), "median-sketch")
    told = sketch.select(*[F.col(k).alias(f"s_{k}") for k in by], "mid", "n")
    same = [F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in by]
    met = kept.select(*by, value, plain.alias("plain")).join(broadcast_checked(told), same).where("plain <= mid[1]")
    counts = met.groupBy(*by, "n", F.when(F.col("plain") >= F.col("mid")[0], F.col(value)).alias(value)).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_first()))
    ranked = counts.withColumn("upto", upto).where(F.col(value).isNotNull() & F.expr("upto > n div 2 and upto - c <= n div 2"))
    return ranked.select(*by, F.col(value).alias("upper_median"), "n")


def _sampled_median(kept: DataFrame, by: list[str], value: str) -> DataFrame:
    counts = kept.groupBy(*by, value).agg(F.count("*").alias("c"))
    # different values that a hash picks, fewer the more a key has
    size = counts.groupBy(*by).agg(F.sum("c").alias("n"), F.count("*").alias("kinds"))
    marked = counts.join(size, by).withColumn("mark", F.pmod(F.xxhash64(value), F.greatest(F.floor(F.col("kinds") / BUCKETS), F.lit(1))) == 0)
    bounds = marked.where("mark").groupBy(*by).agg(F.array_sort(F.collect_set(value)).alias("bounds"))
    below = F.size(F.filter("bounds", lambda b: b <= F.col(value)))
    placed = marked.join(bounds, by, "left").select(*by, value, "c", "n", F.coalesce(below, F.lit(0)).alias("bucket"))
    held = placed.groupBy(*by, "bucket", "n").agg(F.sum("c").alias("inside"))
    held = held.withColumn("before", F.sum("inside").over(Window.partitionBy(*by).orderBy("bucket")) - F.col("inside"))
    middle = held.where(F.expr("before <= n div 2 and n div 2 < before + inside")).select(*by, "bucket", "before")
    ranked = placed.join(middle, [*by, "bucket"]).withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy(*by).orderBy(value)))
    return ranked.where(F.expr("upto > n div 2 and upto - c <= n div 2")).select(*by, F.col(value).alias("upper_median"), "n")
