"""Polygons as tables of edges: containment by ray casting, distance to borders.

``edges`` has one row an edge: ``poly_id, x1, y1, x2, y2`` (x is the longitude), outer
rings and holes alike.  A point is inside where a ray to the east crosses an odd number of
edges.  Points first meet the polygons whose box covers their cell of a grid, and then only
the edges of those, in the row of the grid they lie in: both are equi-joins, and a point
never meets the edges of polygons far to its east or west.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pinfold.operators.blocks import arrays, blocks
from pinfold.runtime import arrow_map, materialise, shuffled

#: Rows of the latitude grid per degree; cells per degree that boxes of polygons are dealt to,
#: and cells of a box beyond which coarser ones are taken.
BANDS, CELLS, MOST_CELLS = 50, 4, 4096


def edges_of(polygons: DataFrame, poly_id: str = "poly_id", rings: str = "rings") -> DataFrame:
    """Edges of polygons whose ``rings`` are arrays of arrays of ``[x, y]``; rings of fewer
    than four positions are left out."""
    each = polygons.select(F.col(poly_id).alias("poly_id"), F.posexplode(rings).alias("ring", "at")).where(F.size("at") >= 4)
    pairs = F.zip_with(F.slice("at", F.lit(1), F.size("at") - 1), F.slice("at", F.lit(2), F.size("at") - 1), lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")))
    return each.select("poly_id", "ring", F.inline(pairs))


def geojson_polygons(spark: SparkSession, documents: DataFrame, column: str = "value") -> DataFrame:
    """``poly_id, state, county, rings`` of the features of GeoJSON texts (Polygon,
    MultiPolygon and collections of them; properties id, s, c).  Rings without an area, and
    features without a ring, are left out."""
    plain = "type: string, coordinates: string"
    schema = f"struct<features: array<struct<properties: struct<id: string, s: string, c: string>, geometry: struct<{plain}, geometries: array<struct<{plain}>>>>>>"
    f = documents.select(F.explode(F.from_json(column, schema).getField("features")).alias("f"))
    ring = "array<array<array<double>>>"

    def rings(g: Column) -> Column:
        several, one = F.flatten(F.from_json(g["coordinates"], f"array<{ring}>")), F.from_json(g["coordinates"], ring)
        return F.when(g["type"] == "MultiPolygon", several).when(g["type"] == "Polygon", one).otherwise(F.array().cast(ring))

    parts = F.flatten(F.transform(F.col("f.geometry.geometries"), rings))
    many = F.when(F.col("f.geometry.type") == "GeometryCollection", parts).otherwise(rings(F.col("f.geometry")))
    whole = F.filter(many, lambda r: F.abs(ring_area(r)) > 0)
    return f.select(F.col("f.properties.id").alias("poly_id"), F.col("f.properties.s").alias("state"), F.col("f.properties.c").alias("county"), whole.alias("rings")).where("size(rings) > 0")


def ring_area(ring: Column) -> Column:
    """Signed area of a closed ring of ``[x, y]``, in square degrees."""
    ends = F.zip_with(F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), lambda a, b: a[0] * b[1] - b[0] * a[1])
    return F.aggregate(ends, F.lit(0.0), lambda s, x: s + x) / 2


def banded(edges: DataFrame) -> DataFrame:
    low, high = F.floor(F.least("y1", "y2") * BANDS), F.floor(F.greatest("y1", "y2") * BANDS)
    return edges.withColumn("band", F.explode(F.sequence(low, high)))


def candidates(points: DataFrame, edges: DataFrame, row_id: str = "row_id") -> DataFrame:
    """``row_id, lat, lon, poly_id`` of the polygons whose box holds each point.

    A box is dealt to the cells of the finest grid (``CELLS`` a degree, halved step by step)
    on which it has ``MOST_CELLS`` at most; points look on every grid that is in use.
    """
    box = edges.groupBy("poly_id").agg(
        F.min(F.least("x1", "x2")).alias("west"), F.max(F.greatest("x1", "x2")).alias("east"), F.min(F.least("y1", "y2")).alias("south"), F.max(F.greatest("y1", "y2")).alias("north")
    )
    grids = [CELLS / 2.0**k for k in range(0, 12, 2)]
    span = lambda low, high, g: F.floor(F.col(high) * g) - F.floor(F.col(low) * g) + 1
    grid = F.coalesce(*[F.when(span("west", "east", g) * span("south", "north", g) <= MOST_CELLS, F.lit(g)) for g in grids[:-1]], F.lit(grids[-1]))
    cells = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) * F.col("grid")), F.floor(F.col(high) * F.col("grid"))))
    dealt = box.withColumn("grid", grid).withColumn("cy", cells("south", "north")).withColumn("cx", cells("west", "east"))
    p = points.select(row_id, "lat", "lon").where("lat is not null and lon is not null").withColumn("grid", F.explode(F.array(*[F.lit(g) for g in grids])))
    p = p.withColumn("cy", F.floor(F.col("lat") * F.col("grid"))).withColumn("cx", F.floor(F.col("lon") * F.col("grid")))
    met = p.join(dealt, ["grid", "cy", "cx"]).where("lat between south and north and lon between west and east")
    return met.select(row_id, "lat", "lon", "poly_id")


def containing(points: DataFrame, edges: DataFrame, row_id: str = "row_id") -> DataFrame:
    """``row_id, poly_id`` of the polygon that holds or touches each point; the smallest
    id where there are several.  Points outside all polygons are absent."""
    p = candidates(points, edges, row_id).withColumn("band", F.floor(F.col("lat") * BANDS))
    met = p.join(banded(edges.select("poly_id", "x1", "y1", "x2", "y2")), ["poly_id", "band"])
    crosses = F.expr("(y1 > lat) <> (y2 > lat)") & F.expr("lon < (x2 - x1) * (lat - y1) / (case when y2 = y1 then 1.0 else y2 - y1 end) + x1")
    touches = F.expr("(x2 - x1) * (lat - y1) = (lon - x1) * (y2 - y1) and lon between least(x1, x2) and greatest(x1, x2) and lat between least(y1, y2) and greatest(y1, y2)")
    hits = met.groupBy(row_id, "poly_id").agg(F.sum(crosses.cast("int")).alias("n"), F.max(touches.cast("int")).alias("t")).where("n % 2 = 1 or t = 1")
    return hits.groupBy(row_id).agg(F.min("poly_id").alias("poly_id"))


def _dealt(edges: DataFrame, side: float) -> DataFrame:
    """Each edge in the cells (``cy, cx``) of a grid that it passes through: row by row, the
    columns between the places where it enters and leaves the row."""
    slack = side * 1e-6
    row = lambda y: F.floor(y / side).cast("long")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges.withColumn("cy", F.explode(F.sequence(row(low - slack), row(high + slack))))
    at = lambda y: F.expr("x1") + (F.least(F.greatest(y, low), high) - F.col("y1")) * F.expr("(x2 - x1) / (y2 - y1)")
    flat = F.col("y1") == F.col("y2")
    enter, leave = at(F.col("cy") * side - slack), at((F.col("cy") + 1) * side + slack)
    west = F.when(flat, F.least("x1", "x2")).otherwise(F.least(enter, leave)) - slack
    east = F.when(flat, F.greatest("x1", "x2")).otherwise(F.greatest(enter, leave)) + slack
    return rows.withColumn("cx", F.explode(F.sequence(row(west), row(east))))


#: Cells of the grid of borders that the reach is long; points and edges of a block.
CELLS_OF_REACH, POINTS, EDGES = 2, 1024, 4096
#: Points that meet the edges of a block at once.
_STRIP = 64


def _border_distances(reach_deg: float):
    """The edge of each block of edges that is nearest to each point of a block of points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            poly = batch.column(batch.schema.get_field_index("poly_id"))
            ids, names, far = [], [], []
            for k in range(batch.num_rows):
                row, lat, lon = arrays(batch, k, "row_id", "lat", "lon")
                x1, y1, x2, y2 = arrays(batch, k, "x1", "y1", "x2", "y2")
                dx, dy = x2 - x1, y2 - y1
                square = dx * dx + dy * dy
                some = np.where(square == 0, 1.0, square)
                for start in range(0, len(row), _STRIP):
                    ex, ey = lon[start : start + _STRIP, None] - x1, lat[start : start + _STRIP, None] - y1
                    # the foot of the point on the edge, kept between its ends
                    along = np.where(square == 0, 0.0, np.clip((ex * dx + ey * dy) / some, 0.0, 1.0))
                    ox, oy = ex - along * dx, ey - along * dy
                    deg = np.sqrt((ox * ox + oy * oy).min(axis=1))
                    near = np.nonzero(deg < reach_deg)[0]
                    ids.append(row[start + near])
                    far.append(deg[near])
                    names += [poly[k].as_py()] * len(near)
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids), pa.int64()), pa.array(names, poly.type), pa.array(np.concatenate(far), pa.float64())], ["row_id", "poly_id", "deg"])

    return run


def nearest_border(points: DataFrame, edges: DataFrame, reach_deg: float, row_id: str = "row_id") -> DataFrame:
    """``row_id, poly_id, deg`` of the border nearest to each point, in degrees, below
    ``reach_deg``; the smallest id wins a tie.  Ids of points are whole numbers.

    Edges are dealt to the cells of a grid, in blocks of one polygon.  A point meets those of
    its own cell; only where a border may be nearer beyond the cell's sides does it meet the
    other cells within what it found.  Blocks are compared as arrays, so however dense the
    borders are, a block for each cell is shuffled and not each pair.
    """
    side = reach_deg / CELLS_OF_REACH
    lean = edges.select("poly_id", "x1", "y1", "x2", "y2").where("poly_id is not null and x1 + y1 + x2 + y2 is not null")
    lines = materialise(blocks(_dealt(lean, side).select("poly_id", "cy", "cx", "x1", "y1", "x2", "y2"), ["poly_id", "cy", "cx"], ["x1", "y1", "x2", "y2"], EDGES), "border-cells")
    index = lambda c: F.floor(F.col(c) / side).cast("long")
    p = materialise(points.select(F.col(row_id).cast("long").alias("row_id"), "lat", "lon").where("lat is not null and lon is not null"), "border-points")
    schema = f"row_id long, poly_id {lean.schema['poly_id'].dataType.simpleString()}, deg double"

    def met(rows: DataFrame) -> DataFrame:
        held = blocks(rows, ["cy", "cx"], ["row_id", "lat", "lon"], POINTS)
        pairs = shuffled(held).join(lines, ["cy", "cx"]).select("row_id", "lat", "lon", "poly_id", "x1", "y1", "x2", "y2")
        return arrow_map(pairs, _border_distances(reach_deg), schema)

    def best(found: DataFrame) -> DataFrame:
        return found.groupBy("row_id").agg(F.min(F.struct(F.floor(F.col("deg") * 1e9 + 0.5).alias("nano"), "poly_id", "deg")).alias("best")).select("row_id", "best.*")

    own = materialise(best(met(p.withColumn("cy", index("lat")).withColumn("cx", index("lon")))), "border-own")
    told = p.join(shuffled(own), "row_id", "left").withColumn("cy", index("lat")).withColumn("cx", index("lon"))
    inset = F.least(F.col("lat") - F.col("cy") * side, (F.col("cy") + 1) * side - F.col("lat"), F.col("lon") - F.col("cx") * side, (F.col("cx") + 1) * side - F.col("lon"))
    told = materialise(told.withColumn("sure", F.coalesce(F.col("deg") < inset - 1e-8, F.lit(False))), "border-told")
    reach = F.coalesce("deg", F.lit(reach_deg)) + 1e-8
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - F.col("reach")) / side).cast("long"), F.floor((F.col(c) + F.col("reach")) / side).cast("long")))
    rest = told.where("not sure").select("row_id", "lat", "lon", F.col("cy").alias("oy"), F.col("cx").alias("ox"), reach.alias("reach"))
    rest = rest.withColumn("cy", span("lat")).withColumn("cx", span("lon")).where("cy <> oy or cx <> ox").select("row_id", "lat", "lon", "cy", "cx")
    found = best(own.select("row_id", "poly_id", "deg").unionByName(met(rest)))
    return found.select(F.col("row_id").alias(row_id), "poly_id", "deg")


def within_tolerance(points: DataFrame, edges: DataFrame, tolerance_deg: float = 1e-4, row_id: str = "row_id") -> DataFrame:
    """``row_id, poly_id`` of points inside a polygon or as near as the tolerance."""
    return assign(points, edges, tolerance_deg, row_id).where("poly_id is not null").select(row_id, "poly_id")


def canary(edges: DataFrame, lat: float, lon: float, poly_id: str, tolerance_deg: float = 1e-4) -> None:
    """Raise unless a point that is known to lie in a polygon is found there: run before a
    long job, it tells a wrong or empty polygon table."""
    spark = edges.sparkSession
    point = spark.range(1).select(F.lit(-1).cast("long").alias("row_id"), F.lit(float(lat)).alias("lat"), F.lit(float(lon)).alias("lon"))
    found = within_tolerance(point, edges, tolerance_deg).collect()
    if [r.poly_id for r in found] != [poly_id]:
        raise ValueError(f"the canary at {lat}, {lon} is in {[r.poly_id for r in found]}, not in {poly_id}")


def assign(points: DataFrame, edges: DataFrame, reach_deg: float = 0.05, row_id: str = "row_id") -> DataFrame:
    """``row_id, poly_id, how``: inside, near a border, or neither (null)."""
    inside = containing(points, edges, row_id).withColumn("how", F.lit("inside"))
    rest = points.join(inside, row_id, "left_anti")
    near = nearest_border(rest, edges, reach_deg, row_id).select(row_id, "poly_id", F.lit("near").alias("how"))
    return points.select(row_id).join(inside.unionByName(near), row_id, "left")


def ring_stats(polygons: DataFrame, poly_id: str = "poly_id", rings: str = "rings") -> DataFrame:
    """Mean of the vertices of the outer ring, the closing one included, and its span in
    degrees on both axes."""
    outer = polygons.select(F.col(poly_id).alias("poly_id"), F.element_at(rings, 1).alias("o"))
    xs, ys = F.transform("o", lambda p: p[0]), F.transform("o", lambda p: p[1])
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    span = lambda a: F.array_max(a) - F.array_min(a)
    return outer.select("poly_id", mean(xs).alias("lon"), mean(ys).alias("lat"), span(xs).alias("dx"), span(ys).alias("dy"), F.size("o").alias("n"))
