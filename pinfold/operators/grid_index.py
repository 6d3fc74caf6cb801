"""A stored grid: pins kept in a table that viewport scans and distance joins need not sort
or shuffle again.

Rows carry the code of their cell on a space-filling curve, whose bits are those of the
cell's row and column in turn.  The table is bucketed by cell (and key columns) and sorted
by it, so that

* a distance join reads the stored side bucket by bucket where it lies: only the other side
  is shuffled, however often the index is used;
* a viewport is a range of codes and of coordinates that Parquet's statistics know, and
  whole row groups and pages outside it are skipped.

Cells that hold very many rows are dealt to several buckets by a salt, and the few rows of
the hot-cell table tell the other side how many.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pinfold.functions.geo import cell, haversine_m, in_box
from pinfold.operators.cells import within_reach
from pinfold.runtime import broadcast_checked

#: Rows of a cell that one bucket takes; bytes of a row group, and rows of a page.
HOT_ROWS, GROUP_BYTES, PAGE_ROWS = 1 << 20, 4 << 20, 2000
#: Added to cells so that none is negative; the masks that spread 31 bits to every second one.
_SHIFT = 1 << 30
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


@dataclass(frozen=True)
class GridIndex:
    """Where a stored grid lies and how it is dealt out."""

    path: str
    table: str
    per_degree: float
    keys: tuple[str, ...]
    buckets: int

    @property
    def bucketed(self) -> list[str]:
        return ["grid_cell", "grid_salt", *self.keys]

    def rows(self, spark: SparkSession) -> DataFrame:
        """The stored pins as they were given."""
        return spark.table(self.table).drop("grid_cell", "grid_salt")


def curve(row: Column, col: Column) -> Column:
    """Code of a cell: the bits of its column and row in turn.  It grows with either, so the
    codes of a rectangle lie between those of its lowest and its highest corner."""

    def spread(x: Column) -> Column:
        for by, mask in _SPREAD:
            x = x.bitwiseOR(F.shiftleft(x, by)).bitwiseAND(F.lit(mask))
        return x

    return F.shiftleft(spread(row + F.lit(_SHIFT)), 1).bitwiseOR(spread(col + F.lit(_SHIFT)))


def _ddl(index: GridIndex, fields: str) -> str:
    by = ", ".join(f"`{c}`" for c in index.bucketed)
    return f"CREATE TABLE {index.table} ({fields}) USING parquet CLUSTERED BY ({by}) SORTED BY (grid_cell) INTO {index.buckets} BUCKETS LOCATION '{index.path}/rows'"


def write_grid_index(pins: DataFrame, path: str, per_degree: float = 100.0, keys: tuple[str, ...] = (), buckets: int | None = None, hot_rows: int = HOT_ROWS) -> GridIndex:
    """Store ``pins(lat, lon, keys...)`` under ``path``, which all executors must see.

    ``keys`` are columns that joins will ask to be equal.  Pins without coordinates are in
    no cell and are left out.  ``buckets`` defaults to the session's shuffle partitions; it
    bounds the tasks of a join, so it should follow the size of the table.
    """
    spark = pins.sparkSession
    index = GridIndex(path, f"grid_{uuid.uuid4().hex}", float(per_degree), tuple(keys), buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    celled = pins.where("lat is not null and lon is not null").withColumn("grid_cell", curve(cell("lat", per_degree), cell("lon", per_degree)))
    hot = celled.groupBy("grid_cell", *keys).agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select("grid_cell", *keys, F.ceil(F.col("n") / hot_rows).cast("int").alias("grid_salts"))
    hot.write.parquet(f"{path}/hot")
    met = _with_salts(celled, spark.read.parquet(f"{path}/hot"), index)
    salted = met.withColumn("grid_salt", F.coalesce(F.pmod(F.xxhash64(*pins.columns), F.col("grid_salts")), F.lit(0)).cast("int")).drop("grid_salts")
    dealt = salted.repartition(index.buckets, *index.bucketed)
    kept = dealt.write.format("parquet").bucketBy(index.buckets, *index.bucketed).sortBy("grid_cell").option("path", f"{path}/rows")
    kept.option("parquet.block.size", GROUP_BYTES).option("parquet.page.row.count.limit", PAGE_ROWS).saveAsTable(index.table)
    told = json.dumps(asdict(index) | {"fields": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.table(index.table).schema)})
    spark.createDataFrame([(told,)], "value string").coalesce(1).write.text(f"{path}/about")
    return index


def open_grid_index(spark: SparkSession, path: str) -> GridIndex:
    """The index that another session stored under ``path``, as a table of this one."""
    told = json.loads(spark.read.text(f"{path}/about").first()[0])
    fields = told.pop("fields")
    index = GridIndex(**told | {"path": path, "keys": tuple(told["keys"]), "table": f"grid_{uuid.uuid4().hex}"})
    spark.sql(_ddl(index, fields))
    return index


def _with_salts(rows: DataFrame, hot: DataFrame, index: GridIndex) -> DataFrame:
    """``grid_salts`` of the rows whose cell is a hot one, null elsewhere."""
    return rows.join(broadcast_checked(hot, *[k for k in index.keys if hot.schema[k].dataType.typeName() == "string"]), ["grid_cell", *index.keys], "left")


def in_view(spark: SparkSession, index: GridIndex, south: float, north: float, west: float, east: float) -> DataFrame:
    """Stored pins in a box, its borders included.  A box whose west lies east of its east
    goes on beyond the antimeridian."""
    if west > east:
        return in_view(spark, index, south, north, west, 180.0).unionByName(in_view(spark, index, south, north, -180.0, east))
    code = lambda lat, lon: curve(cell(F.lit(float(lat)), index.per_degree), cell(F.lit(float(lon)), index.per_degree))
    low, high = spark.range(1).select(code(south, west), code(north, east)).first()
    held = spark.table(index.table).where(F.col("grid_cell").between(low, high) & in_box("lat", "lon", (south, north, west, east)))
    return held.drop("grid_cell", "grid_salt")


def indexed_pairs(left: DataFrame, index: GridIndex, radius_m: float) -> DataFrame:
    """What ``distance_pairs`` of ``left`` and the stored pins gives, with the index's keys
    equal: the stored side is read bucket by bucket and not shuffled."""
    spark = left.sparkSession
    near = within_reach(left, radius_m, index.per_degree).withColumn("grid_cell", curve(F.col("ci"), F.col("cj"))).drop("ci", "cj")
    met = _with_salts(near, spark.read.parquet(f"{index.path}/hot"), index)
    dealt = met.withColumn("grid_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("grid_salts") - 1, F.lit(0))))).drop("grid_salts")
    stored = spark.table(index.table)
    stored = stored.select(*[F.col(c).alias(f"r_{c}") for c in stored.columns])
    pairs = dealt.join(stored, [F.col(c) == F.col(f"r_{c}") for c in index.bucketed])
    told = pairs.withColumn("dist_m", haversine_m("lat", "lon", "r_lat", "r_lon")).where(F.col("dist_m") <= radius_m)
    return told.drop("grid_cell", "grid_salt", "r_grid_cell", "r_grid_salt")
