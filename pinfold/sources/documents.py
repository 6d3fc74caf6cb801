"""Readers and writers of the file forms that places and reports come in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pinfold.operators.cells import distance_pairs, nearest

PLACE_FIELDS = (("name", "string"), ("rel", "int"), ("lat", "double"), ("lon", "double"), ("state", "string"), ("county", "string"), ("city", "string"), ("fips", "string"))


def decode_places(documents: DataFrame, column: str = "value") -> DataFrame:
    """Rows of a ``{"k": [...], "p": [[...], ...]}`` document: seven or eight values by
    position.  ``row_id`` is the position; shorter rows are left out, an absent eighth value
    is empty, and numbers that cannot be read are null."""
    rows = documents.select(F.posexplode(F.from_json(column, "struct<p: array<array<string>>>").getField("p")).alias("row_id", "r")).where(F.size("r") >= 7)
    cells = [F.try_element_at("r", F.lit(i + 1)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(PLACE_FIELDS)]
    return rows.select(F.col("row_id").cast("long").alias("row_id"), *cells).withColumn("fips", F.coalesce("fips", F.lit("")))


def encode_places(places: DataFrame) -> DataFrame:
    """One JSON array a row, in the same order of values."""
    return places.select("row_id", F.to_json(F.array(*[F.col(n).cast("string") for n, _ in PLACE_FIELDS])).alias("value"))


def read_overpass(spark: SparkSession, path: str) -> DataFrame:
    """Map elements, one JSON object a line: tags flattened, the centre used where a point
    is missing, repeated (type, id) once."""
    schema = "type string, id long, lat double, lon double, center struct<lat: double, lon: double>, tags map<string, string>"
    e = spark.read.schema(schema).json(path).dropDuplicates(["type", "id"])
    at = [F.coalesce(c, f"center.{c}").alias(c) for c in ("lat", "lon")]
    return e.select(F.concat_ws("/", "type", "id").alias("osm"), *[F.coalesce(F.col("tags")[t], F.lit("")).alias(t) for t in ("name", "religion", "denomination")], *at).where("lat is not null and lon is not null")


def tiles(box: tuple[float, float, float, float], rows: int = 2, columns: int = 2) -> list[tuple[float, float, float, float]]:
    """A box (south, north, west, east) cut into equal tiles, to be read one by one."""
    south, north, west, east = box
    y = [south + (north - south) * k / rows for k in range(rows + 1)]
    x = [west + (east - west) * k / columns for k in range(columns + 1)]
    return [(y[i], y[i + 1], x[j], x[j + 1]) for i in range(rows) for j in range(columns)]


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], least_bytes: int = 1000) -> DataFrame:
    """The Parquet table at ``path`` if its files hold ``least_bytes`` and more, else
    ``build()`` written there: what a failed pull left behind is not taken for a source."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place) or files.getContentSummary(place).getLength() < least_bytes:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def optional(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """A source that may be absent: an empty table of its columns then."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.format(kind).schema(schema).load(path)


def read_tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("sep", "\t").option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated text; tabs and line ends inside values become spaces."""
    flat = [F.translate(F.col(c).cast("string"), "\t\n\r", "   ").alias(c) for c in df.columns]
    df.select(*flat).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_rows(df: DataFrame, path: str, kind: str = "json", compression: str = "gzip") -> None:
    """Rows as JSON lines or Parquet; readers see all of a write or none of it."""
    df.write.mode("overwrite").option("compression", compression).format(kind).save(path)


def content_digest(df: DataFrame) -> str:
    """Twelve hex digits that change with any row, whatever the order of rows."""
    row = F.xxhash64(*[F.col(c) for c in df.columns])
    low = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.pmod(row, F.lit(1 << 40))), F.lit(0)).alias("s"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("x"))
    return low.select(F.substring(F.sha2(F.concat_ws(":", "n", "s", "x"), 256), 1, 12)).first()[0]


def with_cached_geocodes(rows: DataFrame, cache: DataFrame, address: str = "address") -> DataFrame:
    """Coordinates from a table of known addresses; ``status`` is empty, pobox, ok, nomatch,
    or error where the table (its column ``status``, if any) says so.  No network is asked."""
    key = F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(address), F.lit("")), r"\s+", " ")))
    keyed = rows.withColumn("address_key", key)
    failed = (F.col("status") == "error") if "status" in cache.columns else F.lit(False)
    known = cache.select("address_key", F.col("lat").alias("g_lat"), F.col("lon").alias("g_lon"), failed.alias("g_failed"))
    status = F.when(F.col("address_key") == "", "empty").when(F.col("address_key").rlike(r"\bpo\s*box\b"), "pobox").when(F.col("g_lat").isNotNull(), "ok").when(F.col("g_failed"), "error").otherwise("nomatch")
    return keyed.join(known, "address_key", "left").withColumn("status", status).drop("address_key", "g_failed")


def with_reverse_geocodes(points: DataFrame, known: DataFrame, within_m: float = 50.0) -> DataFrame:
    """``points`` (``row_id, lat, lon``) with the ``display`` of the nearest known place
    (``row_id, lat, lon, display``) within reach, null without one."""
    near = nearest(distance_pairs(points.select("row_id", "lat", "lon"), known.select("row_id", "lat", "lon", "display"), within_m))
    return points.join(near.select("row_id", F.col("r_display").alias("display")), "row_id", "left")
