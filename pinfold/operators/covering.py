"""Prepared polygons: a covering by cells of a quadtree, made once and joined many times.

A cell without an edge in it lies inside its polygon as a whole or outside; a cell with few
edges carries them.  Cells with more are split, level by level, wherever polygons are
detailed.  A point then meets one cell of each level that is in use: in an inner cell it
needs no edge at all, in a border cell only those that pass through it.

A border cell knows whether its upper right corner is inside.  From the point the way goes
east to the side of the cell and then up to that corner; every edge on the way changes
sides, and all of them are edges of the cell.  The corners of smaller cells are told from
that of the cell they come from in the same way, so only the first cells of a polygon meet
the edges of its whole width.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinfold.operators.blocks import arrays, blocks
from pinfold.operators.polygons import BANDS, banded
from pinfold.runtime import arrow_map, materialise, shuffled

#: Edges that a border cell carries; finest level (cells of 2**-22 degrees, some cm); levels
#: by which a cell is split at once.
MOST_EDGES, FINEST, STEP = 8, 22, 2
#: Cells that an edge of a polygon may pass through on average for its cells to be split again.
SPREAD = 32
#: Edges from which a cell's points meet them as arrays; points of a block, and at once.
MANY, POINTS, _STRIP = 32, 1024, 64
#: Where the grid begins: no usual coordinate lies on a border of its cells.
X0, Y0 = 0.0004142135623731, 0.0007320508075689
_SLACK = 1e-9
_CELL = ["poly_id", "level", "cy", "cx"]
_EDGES = "array<struct<x1:double,y1:double,x2:double,y2:double>>"


def _corner(c: Column, side: Column, origin: float) -> Column:
    return F.lit(origin) + c * side


def _index(x: Column, level: Column, origin: float) -> Column:
    return F.floor((x - origin) * F.pow(F.lit(2.0), level)).cast("long")


def _passes(cells: DataFrame) -> DataFrame:
    """Rows whose edge passes through their cell, or as near as rounding may err."""
    half = F.col("side") / 2
    mx, my, reach = _corner(F.col("cx") + 0.5, F.col("side"), X0), _corner(F.col("cy") + 0.5, F.col("side"), Y0), half + _SLACK
    box = (F.abs(F.expr("(x1 + x2) / 2") - mx) <= F.expr("abs(x1 - x2) / 2") + reach) & (F.abs(F.expr("(y1 + y2) / 2") - my) <= F.expr("abs(y1 - y2) / 2") + reach)
    # the line is as near to the middle as the cell is wide, seen along the line
    off = F.abs(F.expr("x2 - x1") * (my - F.col("y1")) - F.expr("y2 - y1") * (mx - F.col("x1")))
    return cells.where(box & (off <= F.expr("abs(x2 - x1) + abs(y2 - y1)") * reach + _SLACK))


def _across(x: Column, y: Column, east: Column, north: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether an edge changes sides between a point and the corner that lies east and then
    north of it: it is across one leg of the way and not the other."""
    at = (x2 - x1) * (y - y1) / F.when(y2 == y1, F.lit(1.0)).otherwise(y2 - y1) + x1
    up = (y2 - y1) * (east - x1) / F.when(x2 == x1, F.lit(1.0)).otherwise(x2 - x1) + y1
    first = ((y1 > y) != (y2 > y)) & (x < at) & (at <= east)
    second = ((x1 > east) != (x2 > east)) & (y < up) & (up <= north)
    return first != second


def _odd_corners(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """``cells`` with ``odd``: whether their upper right corner is inside the polygon."""
    at = cells.withColumn("ax", _corner(F.col("cx") + 1, F.col("side"), X0)).withColumn("ay", _corner(F.col("cy") + 1, F.col("side"), Y0)).withColumn("band", F.floor(F.col("ay") * BANDS))
    met = shuffled(at).join(shuffled(banded(edges)), ["poly_id", "band"]).where("(y1 > ay) <> (y2 > ay) and ax < (x2 - x1) * (ay - y1) / (case when y2 = y1 then 1.0 else y2 - y1 end) + x1")
    crossed = met.groupBy(*_CELL).agg((F.count("*") % 2 == 1).alias("odd"))
    return cells.join(crossed, _CELL, "left").withColumn("odd", F.coalesce("odd", F.lit(False)))


def prepare(edges: DataFrame, most_edges: int = MOST_EDGES) -> DataFrame:
    """``poly_id, level, cy, cx, side, odd, edges`` of the inner and the border cells of polygons
    given as ``edges(poly_id, x1, y1, x2, y2)``; inner cells have no edges.

    A border cell has ``most_edges`` at most, unless so many meet in a cell of the finest
    level, or the polygon's edges cross each other everywhere: splitting parts no such edges
    and only multiplies them, so it ends where one passes through ``SPREAD`` cells.  Every level is a table, so the result is read from files however often it is
    used.  Edges with a null end are left out.
    """
    lean = materialise(edges.select("poly_id", "x1", "y1", "x2", "y2").where("poly_id is not null and x1 + y1 + x2 + y2 is not null"), "cover-given")
    given = materialise(lean.groupBy("poly_id").agg(F.count("*").alias("given")), "cover-sizes")
    box = lean.groupBy("poly_id").agg(
        F.min(F.least("x1", "x2")).alias("west"), F.max(F.greatest("x1", "x2")).alias("east"), F.min(F.least("y1", "y2")).alias("south"), F.max(F.greatest("y1", "y2")).alias("north")
    )
    # two to five cells along the longer side of the box; border cells of this size are split in any case
    span = F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"), F.lit(2.0**-FINEST))
    box = box.withColumn("level", F.least(F.floor(F.lit(2.0) - F.log2(span)), F.lit(FINEST)).cast("int"))
    run = lambda low, high, origin: F.explode(F.sequence(_index(F.col(low), F.col("level"), origin), _index(F.col(high), F.col("level"), origin)))
    started = materialise(box.withColumn("cy", run("south", "north", Y0)).withColumn("cx", run("west", "east", X0)).select(*_CELL, F.pow(F.lit(0.5), F.col("level")).alias("side")), "cover-start")
    met = materialise(_passes(shuffled(lean).join(started, "poly_id")), "cover-edges")
    cells = materialise(_odd_corners(started, lean), "cover-cells")
    # every part is a table of its own: what is planned at the end is a union of files
    inner = lambda: materialise(shuffled(cells).join(shuffled(met.select(*_CELL).distinct()), _CELL, "left_anti").where("odd").withColumn("edges", F.array().cast(_EDGES)), "cover")
    cover, fits = inner(), 0
    while True:
        wide = met.groupBy("poly_id").agg(F.count("*").alias("now")).join(given, "poly_id").where(F.col("now") <= SPREAD * F.col("given")).select("poly_id")
        counted = met.groupBy(*_CELL).agg(F.count("*").alias("n")).where((F.col("n") > fits) & (F.col("level") < FINEST)).drop("n")
        full = materialise(counted.join(wide, "poly_id", "left_semi"), "cover-full")
        again = not full.isEmpty()
        done = (shuffled(met).join(shuffled(full), _CELL, "left_anti") if again else met).groupBy(*_CELL).agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
        cover = cover.unionByName(materialise(shuffled(cells).join(shuffled(done), _CELL), "cover"))
        if not again:
            return cover
        children, meeting = _split(shuffled(cells).join(shuffled(full), _CELL, "left_semi"), "odd"), _split(shuffled(met).join(shuffled(full), _CELL, "left_semi"), "x1", "y1", "x2", "y2")
        # the corner of a child lies in its parent: what is across the way to the parent's corner is an edge of the parent
        corner = (*_corners(F.col("cx"), F.col("cy"), F.col("side")), *_corners(F.col("px"), F.col("py"), F.col("side") * (1 << STEP)))
        across = meeting.where(_across(*corner, *map(F.col, ("x1", "y1", "x2", "y2")))).groupBy(*_CELL).agg(F.count("*").alias("w"))
        met = materialise(_passes(meeting.drop("px", "py")), "cover-edges")
        told = shuffled(children.drop("px", "py")).join(shuffled(across), _CELL, "left").withColumn("odd", (F.coalesce("w", F.lit(0)) % 2 == 1) != F.col("odd")).drop("w")
        cells, fits = materialise(told, "cover-cells"), most_edges
        cover = cover.unionByName(inner())


def _corners(cx: Column, cy: Column, side: Column) -> tuple[Column, Column]:
    return _corner(cx + 1, side, X0), _corner(cy + 1, side, Y0)


def _split(rows: DataFrame, *kept: str) -> DataFrame:
    """Rows of cells, once for each of the smaller cells; ``px, py`` say where they come from."""
    wide = 1 << STEP
    parts = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(wide * wide - 1))))
    y, x = F.shiftright("part", STEP), F.col("part").bitwiseAND(F.lit(wide - 1))
    return parts.select("poly_id", (F.col("level") + STEP).alias("level"), (F.col("cy") * wide + y).alias("cy"), (F.col("cx") * wide + x).alias("cx"), F.col("cy").alias("py"), F.col("cx").alias("px"), (F.col("side") / wide).alias("side"), *kept)


def _inside(found: Column) -> Column:
    """Whether the point is inside: its corner is, but for the edges across the way."""
    one = lambda odd, e: odd != _across(F.col("lon"), F.col("lat"), F.col("ce"), F.col("cn"), e["x1"], e["y1"], e["x2"], e["y2"])
    return F.aggregate(found, F.col("odd"), one)


def _touches(e: Column) -> Column:
    lat, lon = F.col("lat"), F.col("lon")
    on_line = (e["x2"] - e["x1"]) * (lat - e["y1"]) == (lon - e["x1"]) * (e["y2"] - e["y1"])
    return on_line & lon.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & lat.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))


def met_cells(points: DataFrame, cover: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Every point with the cells of the covering it lies in."""
    levels = [r.level for r in cover.select("level").distinct().collect()]
    p = points.select(row_id, "lat", "lon").where("lat is not null and lon is not null").withColumn("level", F.explode(F.array(*[F.lit(v) for v in sorted(levels)]).cast("array<int>")))
    p = p.withColumn("cy", _index(F.col("lat"), F.col("level"), Y0)).withColumn("cx", _index(F.col("lon"), F.col("level"), X0))
    return shuffled(p).join(shuffled(cover), ["level", "cy", "cx"])


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What ``_inside`` and ``_touches`` say of blocks of points in cells with many edges."""
    for batch in batches:
        poly, rest = batch.column(batch.schema.get_field_index("poly_id")), batch.select(["odd", "ce", "cn"]).to_pylist()
        ids, names = [], []
        for k in range(batch.num_rows):
            row, lat, lon = arrays(batch, k, "row_id", "lat", "lon")
            x1, y1, x2, y2 = arrays(batch, k, "x1", "y1", "x2", "y2")
            odd, east, north = rest[k]["odd"], rest[k]["ce"], rest[k]["cn"]
            up = (y2 - y1) * (east - x1) / np.where(x2 == x1, 1.0, x2 - x1) + y1
            wall, high, flat = ((x1 > east) != (x2 > east)) & (up <= north), np.where(y2 == y1, 1.0, y2 - y1), x2 - x1
            for start in range(0, len(row), _STRIP):
                x, y = lon[start : start + _STRIP, None], lat[start : start + _STRIP, None]
                rise = flat * (y - y1)
                at = rise / high + x1
                across = (((y1 > y) != (y2 > y)) & (x < at) & (at <= east)) != (wall & (y < up))
                inside = (across.sum(axis=1) % 2 == 1) != odd
                i, j = np.nonzero(rise == (x - x1) * (y2 - y1))
                on = (x[i, 0] >= np.minimum(x1, x2)[j]) & (x[i, 0] <= np.maximum(x1, x2)[j]) & (y[i, 0] >= np.minimum(y1, y2)[j]) & (y[i, 0] <= np.maximum(y1, y2)[j])
                inside[i[on]] = True
                ids.append(row[start : start + _STRIP][inside])
                names += [poly[k].as_py()] * int(inside.sum())
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids), pa.int64()), pa.array(names, poly.type)], ["row_id", "poly_id"])


def _met_by_blocks(points: DataFrame, cover: DataFrame, row_id: str) -> DataFrame:
    """``row_id, poly_id`` of the points inside, for cells of many edges."""
    levels = [r.level for r in cover.select("level").distinct().collect()]
    p = points.select(F.col(row_id).cast("long").alias("row_id"), "lat", "lon").where("lat is not null and lon is not null").withColumn("level", F.explode(F.array(*[F.lit(v) for v in sorted(levels)]).cast("array<int>")))
    p = p.withColumn("cy", _index(F.col("lat"), F.col("level"), Y0)).withColumn("cx", _index(F.col("lon"), F.col("level"), X0))
    east, north = _corners(F.col("cx"), F.col("cy"), F.col("side"))
    met = shuffled(blocks(p, ["level", "cy", "cx"], ["row_id", "lat", "lon"], POINTS)).join(shuffled(cover), ["level", "cy", "cx"])
    told = met.select("row_id", "lat", "lon", "poly_id", "odd", east.alias("ce"), north.alias("cn"), *[F.col(f"edges.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])
    return arrow_map(told, _hits, f"row_id long, poly_id {cover.schema['poly_id'].dataType.simpleString()}").withColumnRenamed("row_id", row_id)


def containing_prepared(points: DataFrame, cover: DataFrame, row_id: str = "row_id") -> DataFrame:
    """What ``containing`` of the same polygons gives: ``row_id, poly_id`` of the polygon
    that holds or touches each point, the smallest id where there are several."""
    many = cover.where(F.size("edges") > MANY)
    met = met_cells(points, cover.where(F.size("edges") <= MANY), row_id)
    east, north = _corners(F.col("cx"), F.col("cy"), F.col("side"))
    met = met.withColumn("ce", east).withColumn("cn", north)
    hits = met.where((F.size("edges") == 0) | _inside(F.col("edges")) | F.exists("edges", _touches))
    every = hits.select(row_id, "poly_id").unionByName(_met_by_blocks(points, many, row_id))
    return every.groupBy(row_id).agg(F.min("poly_id").alias("poly_id"))
