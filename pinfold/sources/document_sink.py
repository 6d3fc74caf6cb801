"""A sink that publishes one JSON document, its compressed twin and a summary, or nothing.

``spark.dataSource.register(PlacesDocument)``, then
``df.write.format("places_document").mode("overwrite").save(folder)``.  The folder must be
one that the driver and all executors share.

Tasks write the rows they have as parts; a part of a task that failed or ran twice is never
published.  The commit joins the parts of the tasks that count, as streams of bytes, into
``places.json`` and ``places.json.gz``, puts both in place and the summary last: a reader
that sees a summary sees the document it tells of.  An abort leaves the folder as it was.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

DOCUMENT, SUMMARY = "places.json", "summary.json"


@dataclass
class Part(WriterCommitMessage):
    """What a task wrote: its number, its file, rows, and rows by class."""

    number: int
    file: str
    rows: int
    classes: dict


class PlacesDocument(DataSource):
    @classmethod
    def name(cls) -> str:
        return "places_document"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema, overwrite)


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        self.folder, self.columns = options["path"], schema.fieldNames()
        self.by = options.get("count_by") or None
        if not overwrite and os.path.exists(os.path.join(self.folder, SUMMARY)):
            raise FileExistsError(f"{self.folder} holds a document; overwrite it or choose another folder")
        self.parts = os.path.join(self.folder, f"_parts-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[Row]) -> Part:
        from pyspark import TaskContext

        os.makedirs(self.parts, exist_ok=True)
        task = TaskContext.get()
        file = os.path.join(self.parts, f"{task.partitionId()}-{task.taskAttemptId()}")
        rows, classes = 0, {}
        with open(file, "w", encoding="utf-8") as out:
            for row in iterator:
                out.write((",\n" if rows else "") + json.dumps([row[c] for c in self.columns], separators=(",", ":"), ensure_ascii=False))
                rows += 1
                if self.by:
                    key = str(row[self.by])
                    classes[key] = classes.get(key, 0) + 1
        return Part(task.partitionId(), file, rows, classes)

    def commit(self, messages: list[Part | None]) -> None:
        told = sorted((m for m in messages if m), key=lambda m: m.number)
        os.makedirs(self.parts, exist_ok=True)
        whole, digest = os.path.join(self.parts, DOCUMENT), hashlib.sha256()
        with open(whole, "wb") as plain, gzip.GzipFile(whole + ".gz", "wb", mtime=0) as packed:

            def put(data: bytes) -> None:
                plain.write(data)
                packed.write(data)
                digest.update(data)

            put(b'{"k":' + json.dumps(self.columns).encode() + b',"p":[')
            first = True
            for m in told:
                if m.rows:
                    put(b"\n" if first else b",\n")
                    first = False
                    with open(m.file, "rb") as part:
                        while data := part.read(1 << 20):
                            put(data)
            put(b"]}\n")
        summary: dict = {"n": sum(m.rows for m in told), "sha256": digest.hexdigest()}
        if self.by:
            summary["by"] = {k: sum(m.classes.get(k, 0) for m in told) for k in sorted({k for m in told for k in m.classes})}
        with open(os.path.join(self.parts, SUMMARY), "w", encoding="utf-8") as out:
            json.dump(summary, out, indent=2)
        for name in (f"{DOCUMENT}.gz", DOCUMENT, SUMMARY):
            os.replace(os.path.join(self.parts, name), os.path.join(self.folder, name))
        shutil.rmtree(self.parts, ignore_errors=True)

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)
