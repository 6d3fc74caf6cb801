"""A data source over shapefile layers, plain or in zip archives, with struct alone.

``spark.read.format("shapefile").option("layer", "pofw").load(paths)`` after registering
``Shapefiles``; one partition for each file.  ``path`` names ``.shp`` files or ``.zip``
archives, separated by commas, that every executor can read.  Rows are
``osm_id, name, fclass, kind, lat, lon, span_lat, span_lon``: points as they are, areas by
the mean of the vertices of their first ring and by the span of their box.  With the option
``states`` (``slug:ST,slug:ST``) a column ``state`` tells whose name is in the path of a file.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

POINTS, AREAS = (1, 11, 21), (3, 5, 13, 15, 23, 25)
SCHEMA = "osm_id string, name string, fclass string, kind string, lat double, lon double, span_lat double, span_lon double"


def records(dbf: bytes) -> Iterator[dict[str, str]]:
    """Rows of a dBASE table by lower-case field names."""
    n, head, size = struct.unpack("<IHH", dbf[4:12])
    fields, at, offset = [], 32, 1
    while dbf[at] != 0x0D:
        name, width = dbf[at : at + 11].split(b"\0")[0].decode("ascii").lower(), dbf[at + 16]
        fields.append((name, offset, width))
        at, offset = at + 32, offset + width
    for k in range(n):
        row = dbf[head + k * size : head + (k + 1) * size]
        yield {name: row[o : o + w].decode("utf-8", "replace").strip(" \0") for name, o, w in fields}


def shapes(shp: bytes) -> Iterator[tuple[str, float, float, float, float] | None]:
    """Kind, latitude, longitude and spans of each shape; None for null and other shapes."""
    at = 100
    while at + 8 <= len(shp):
        words = struct.unpack(">I", shp[at + 4 : at + 8])[0]
        body = shp[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        kind = struct.unpack("<I", body[:4])[0]
        if kind in POINTS:
            x, y = struct.unpack("<2d", body[4:20])
            yield "point", y, x, 0.0, 0.0
        elif kind in AREAS:
            west, south, east, north, parts, total = struct.unpack("<4d2I", body[4:44])
            ends = [*struct.unpack(f"<{parts}I", body[44 : 44 + 4 * parts]), total]
            first = ends[1] if len(ends) > 1 else total
            xy = struct.unpack(f"<{2 * first}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * first])
            yield "area", sum(xy[1::2]) / first, sum(xy[::2]) / first, north - south, east - west
        else:
            yield None


def layers(path: str, layer: str) -> Iterator[tuple[bytes, bytes]]:
    """The (shp, dbf) pairs of a file or archive whose name holds ``layer``."""
    if path.endswith(".zip"):
        if not zipfile.is_zipfile(path):
            raise ValueError(f"{path} is no zip archive; a failed download?")
        with zipfile.ZipFile(path) as z:
            for name in sorted(z.namelist()):
                if name.endswith(".shp") and layer in name:
                    yield z.read(name), z.read(name[:-4] + ".dbf")
    elif layer in path:
        with open(path, "rb") as a, open(path[:-4] + ".dbf", "rb") as b:
            yield a.read(), b.read()


class Shapefiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return SCHEMA + (", state string" if self.options.get("states") else "")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Shapes(self.options, schema)


class _Shapes(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.paths, self.layer, self.columns = options["path"].split(","), options.get("layer", ""), schema.fieldNames()
        self.states = [s.split(":") for s in options.get("states", "").split(",") if s]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        # the longest slug that fits: west-virginia is not virginia
        slug = max((s for s in self.states if s[0] in partition.value), key=lambda s: len(s[0]), default=("", None))
        for shp, dbf in layers(partition.value, self.layer):
            for row, shape in zip(records(dbf), shapes(shp)):
                if shape is not None:
                    full = row | dict(zip(("kind", "lat", "lon", "span_lat", "span_lon"), shape)) | {"state": slug[1]}
                    yield tuple(full.get(c) for c in self.columns)


class Sheets(DataSource):
    """``spark.read.format("sheet").load(path)``: rows of the first sheet of an xlsx file,
    header left out, as text columns ``c0 .. c5`` (or those of a schema)."""

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def schema(self) -> str:
        return ", ".join(f"c{i} string" for i in range(6))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Sheet(self.options["path"], len(schema.fieldNames()))


class _Sheet(DataSourceReader):
    def __init__(self, path: str, width: int) -> None:
        self.path, self.width = path, width

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            rows = sheet_rows(f.read())
        next(rows, None)
        for row in rows:
            yield tuple((row + [None] * self.width)[: self.width])


def sheet_rows(xlsx: bytes) -> Iterator[list[str | None]]:
    """Cell texts of the first sheet of a workbook, row by row, in column order."""
    from xml.etree import ElementTree as X

    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(xlsx)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in item.iter(f"{ns}t")) for item in X.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
        sheet = min(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))
        with z.open(sheet) as f:
            for _, row in X.iterparse(f):
                if row.tag != f"{ns}row":
                    continue
                cells: list[str | None] = []
                for c in row.iter(f"{ns}c"):
                    column = 0
                    for letter in (c.get("r") or "A").rstrip("0123456789"):
                        column = column * 26 + ord(letter) - 64
                    cells += [None] * (column - len(cells))
                    v = c.find(f"{ns}v")
                    if c.get("t") == "inlineStr":
                        cells[column - 1] = "".join(t.text or "" for t in c.iter(f"{ns}t"))
                    elif v is not None:
                        cells[column - 1] = shared[int(v.text)] if c.get("t") == "s" else v.text
                yield cells
                row.clear()
