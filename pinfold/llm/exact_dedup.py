"""Exact duplicates by Grace hashing: buckets on disk, an open-addressing table for each.

Texts are equal when they are the same after lower-casing A-Z.  The rows of a task first
meet in windows of bounded size, each with a table of its own, and are written to a spill
table: one row a document, with the content on the first of equal ones only.  So a text
that makes up a third of all rows is one record a window, not one a row.

The records are then dealt to buckets by the leading bits of their digest.  A bucket whose
different contents exceed the table is spilled again and dealt by the next bits, until every
bucket fits; one content alone always fits.  Each bucket goes through a table that compares
complete contents, and only keys travel from there back to the documents.
"""

from __future__ import annotations

import hashlib
import itertools
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinfold.runtime import arrow_map, broadcast_checked, materialise

#: Bytes of different contents that a bucket's table holds; bits by which a bucket that
#: holds more is dealt again.
TABLE_BYTES, MORE_BITS = 64 << 20, 4
#: Bytes of different contents, and rows, of a window of one task.
WINDOW_BYTES, WINDOW_ROWS = 16 << 20, 1 << 16
#: Bits of a digest that deal out, at most.
HEAD_BITS = 63

SPILL = "doc_id long, class_id long, top boolean, digest binary, head long, size long, n long, best long, content binary"
CLASSES = "class_id long, keep_id long, group_size long, keep_class long"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
"""


class ContentTable:
    """Different contents under open addressing with linear probing.

    A key only says where to look; contents are equal when all their bytes are.
    """

    def __init__(self) -> None:
        self.slots = array("q", [-1]) * 64
        self.keys = array("Q")
        self.contents: list[bytes] = []
        self.bytes = 0

    def find(self, key: int, content: bytes) -> int:
        """Number of the entry of this content, a new one if it is not there."""
        mask = len(self.slots) - 1
        at = key & mask
        while (entry := self.slots[at]) >= 0:
            if self.keys[entry] == key and self.contents[entry] == content:
                return entry
            at = (at + 1) & mask
        entry = self.slots[at] = len(self.contents)
        self.keys.append(key)
        self.contents.append(content)
        self.bytes += len(content)
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return entry

    def _grow(self) -> None:
        self.slots = array("q", [-1]) * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for entry, key in enumerate(self.keys):
            at = key & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


def _spill(window_bytes: int, window_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        ids, entries, digests, table = [], [], [], ContentTable()
        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                content = (text or b"").lower()
                digest = hashlib.sha256(content).digest()
                entry = table.find(int.from_bytes(digest[-8:], "big"), content)
                if entry == len(digests):
                    digests.append(digest)
                ids.append(doc_id)
                entries.append(entry)
                if table.bytes >= window_bytes or len(ids) >= window_rows:
                    yield _window(first, ids, entries, digests, table)
                    first += len(digests)
                    ids, entries, digests, table = [], [], [], ContentTable()
        if ids:
            yield _window(first, ids, entries, digests, table)

    return run


def _window(first: int, ids: list, entries: list[int], digests: list[bytes], table: ContentTable) -> pa.RecordBatch:
    """The rows of a window: content and totals stand on the first row of each class."""
    n, best, lead = [0] * len(digests), [None] * len(digests), [-1] * len(digests)
    for row, (doc_id, e) in enumerate(zip(ids, entries)):
        n[e] += 1
        if lead[e] < 0:
            lead[e] = row
        if best[e] is None or doc_id is not None and doc_id > ids[best[e]]:
            best[e] = row if doc_id is not None else None
    top = {lead[e] if best[e] is None else best[e] for e in range(len(digests))}
    leads = [lead[e] == row for row, e in enumerate(entries)]
    on_lead = lambda make: [make(e) if x else None for x, e in zip(leads, entries)]
    columns = [
        ids, [first + e for e in entries], [row in top for row in range(len(ids))], [digests[e] for e in entries],
        on_lead(lambda e: int.from_bytes(digests[e][:8], "big") >> 1), on_lead(lambda e: len(table.contents[e])), on_lead(n.__getitem__),
        on_lead(lambda e: None if best[e] is None else ids[best[e]]), on_lead(table.contents.__getitem__),
    ]
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = [c.split()[0] for c in SPILL.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The classes of buckets that come one after the other, through one table each."""
    bucket, table, held = None, ContentTable(), []
    for batch in batches:
        for path, class_id, key, n, best, content in zip(*(c.to_pylist() for c in batch.columns)):
            if path != bucket:
                yield from _closed(held)
                bucket, table, held = path, ContentTable(), []
            entry = table.find(int.from_bytes(key, "big"), content)
            if entry == len(held):
                held.append([0, None, 0, array("q")])
            h = held[entry]
            h[0] += n
            h[3].append(class_id)
            # the largest id stays; of records without an id, or with the same, the first class
            if len(h[3]) == 1 or (best is not None, best or 0, -class_id) > (h[1] is not None, h[1] or 0, -h[2]):
                h[1], h[2] = best, class_id
    yield from _closed(held)


def _closed(held: list) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in CLASSES.split(", ")]
    rows = ((c, best, n, keep) for n, best, keep, classes in held for c in classes)
    while part := list(itertools.islice(rows, 1 << 16)):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part)], names)


def content_classes(spill: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``class_id, keep_id, group_size, keep_class`` of all classes of a spill table."""
    records = spill.where("content is not null").select("class_id", "digest", "head", "n", "best", "content")
    contents = materialise(spill.where("content is not null").groupBy("head").agg(F.max("size").alias("size")), "dedup-sizes")
    held = contents.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    # buckets of half a table on average
    bits = (max(1, 2 * held // table_bytes) - 1).bit_length()
    path = lambda: F.shiftright("head", HEAD_BITS - bits) if bits else F.lit(0).cast("long")
    found = None
    while True:
        sizes = contents.groupBy(path().alias("path")).agg(F.sum("size").alias("bytes"), F.count("*").alias("kinds"))
        last = bits + MORE_BITS > HEAD_BITS
        over = None if last else materialise(sizes.where((F.col("bytes") > table_bytes) & (F.col("kinds") > 1)).select("path"), "dedup-over")
        again = over is not None and not over.isEmpty()
        dealt = records.withColumn("path", path())
        fit = dealt.join(broadcast_checked(over), "path", "left_anti") if again else dealt
        sorted_ = fit.select("path", "class_id", F.expr("substring(digest, 25, 8)").alias("key"), "n", "best", "content").repartition("path").sortWithinPartitions("path")
        classes = sorted_.transform(arrow_map, _tables, CLASSES)
        found = classes if found is None else found.unionAll(classes)
        if not again:
            return found
        records = materialise(dealt.join(broadcast_checked(over), "path", "left_semi").drop("path"), "dedup-spill")
        contents = contents.withColumn("path", path()).join(broadcast_checked(over), "path", "left_semi").drop("path")
        bits += MORE_BITS


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES, window_bytes: int = WINDOW_BYTES, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of the rows whose texts are equal after lower-casing A-Z, the one with the largest id is
    ``kept``; ``keep_id`` is its id and ``group_size`` counts them.  A null text counts as
    empty.  Rows without an id stay only where no row of the group has one (``keep_id`` is
    null then); of rows that share the largest id one is kept.  ``text_sha256`` is of the
    lower-cased text in UTF-8.  Other columns are ignored; an empty table gives an empty
    result.  One text must fit in the memory of a task, as it must in a row.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("t"))
    spill = materialise(picked.transform(arrow_map, _spill(window_bytes, window_rows), SPILL), "dedup-windows")
    classes = content_classes(spill, table_bytes)
    told = spill.select("doc_id", "class_id", "top", "digest").join(classes, "class_id")
    return told.select("doc_id", "keep_id", "group_size", (F.col("top") & (F.col("class_id") == F.col("keep_class"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))

