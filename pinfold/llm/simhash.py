"""SimHash near-duplicates: 64-bit majority fingerprints linked through BK-trees.

Fingerprints are made where the texts lie, so only (id, fingerprint) pairs are shuffled.
Distinct fingerprints are dealt to shards that agree on one of ``radius + 1`` groups of
bits: two fingerprints within the radius agree on at least one group, so no link is lost.
Each shard is a BK-tree (children keyed by the Hamming distance to their parent), searched
along the edges within the radius only.  The queries of a shard are its own members, so the
tree is built where they meet; broadcasting all trees would grow with the data.

A shard with more than ``shard_limit`` fingerprints is dealt again by the remaining bits,
up to three levels deep.  There a shard has at most 2**20 members by construction, however
many rows the corpus has.  A shard reports a spanning forest, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinfold.operators.components import connected_components
from pinfold.runtime import arrow_map, materialise

BITS = 64
LEVELS = 3
_CHUNK = 1 << 15


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """Signed 64-bit fingerprint of one text; zero without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[k:] for k in range(width))))
    ones, n, block = np.zeros(BITS, np.int64), 0, []
    for gram in grams:
        block.append(xxhash.xxh64_digest(gram, seed))
        if len(block) == _CHUNK:
            n += len(block)
            ones += _ones(block)
            block = []
    n += len(block)
    ones += _ones(block)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def _ones(block: list[bytes]) -> np.ndarray:
    digests = np.frombuffer(b"".join(block), np.uint8).reshape(-1, 8)
    return np.unpackbits(digests, axis=1).sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(doc_id, fp)`` for every row of ``docs``; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(made, pa.int64())], ["doc_id", "fp"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return picked.transform(arrow_map, run, "doc_id long, fp long")


class BKTree:
    """Integers under the Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        at, new = 0, len(self.values) - 1
        while new:
            d = (value ^ self.values[at]).bit_count()
            child = self.children[at].setdefault(d, new)
            if child == new:
                return
            at = child

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of the stored values at most ``radius`` bits away."""
        found, stack = [], [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                found.append(at)
            edges = self.children[at]
            if edges:
                if len(edges) > 2 * radius + 1:
                    stack.extend(edges[k] for k in range(d - radius, d + radius + 1) if k in edges)
                else:
                    stack.extend(c for k, c in edges.items() if -radius <= k - d <= radius)
        return found


def shard_forest(values: list[int], reps: list[int], radius: int) -> list[tuple[int, int]]:
    """(rep, least rep of its group) for every linked member of one shard but the least."""
    tree, parent = BKTree(), list(range(len(values)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k in sorted(range(len(values)), key=reps.__getitem__):
        order = len(tree.values)
        for other in tree.within(values[k], radius):
            a, b = find(order), find(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.add(values[k])
    ranked = sorted(reps)
    return [(ranked[k], ranked[r]) for k in range(len(ranked)) if (r := find(k)) != k]


def _masks(radius: int) -> list[list[int]]:
    """Per level the masks of bits on which a shard agrees, as signed longs."""

    def split(free: list[int]) -> list[list[int]]:
        return [free[i * len(free) // (radius + 1) : (i + 1) * len(free) // (radius + 1)] for i in range(radius + 1)]

    levels, current = [], [([], list(range(BITS)))]
    for _ in range(LEVELS):
        current = [(fixed + part, [b for b in free if b not in part]) for fixed, free in current for part in split(free)]
        levels.append([_signed(sum(1 << b for b in fixed)) for fixed, _ in current])
    return levels


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest_of(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, values, reps, out = None, [], [], []

        def closed() -> None:
            if len(values) > 1:
                out.extend(shard_forest(values, reps, radius))

        for batch in batches:
            for path, shard, fp, rep in zip(*(c.to_pylist() for c in batch.columns)):
                if (path, shard) != key:
                    closed()
                    key, values, reps = (path, shard), [], []
                values.append(fp & 0xFFFFFFFFFFFFFFFF)
                reps.append(rep)
            if len(out) >= 50_000:
                yield _edges(out)
                out = []
        closed()
        yield _edges(out)

    return run


def _edges(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["src", "dst"])


def hamming_links(classes: DataFrame, radius: int = 2, shard_limit: int = 1024) -> DataFrame:
    """Edges ``(src, dst)`` between representatives of ``classes(fp, rep)`` that span all
    links of at most ``radius`` differing bits.  ``fp`` is distinct, ``rep`` distinct and
    not null."""
    rows, parent_masks, found = classes, None, None
    for level, masks in enumerate(_masks(radius)):
        # rows of a shard that is dealt again carry the path of that shard
        base = rows.withColumn("path", F.lit(0)) if parent_masks is None else rows
        keyed = base.select(
            "fp", "rep", F.explode(F.array(*[F.lit(i) for i in range(radius + 1)])).alias("i"), "path"
        ).select("fp", "rep", (F.col("path") * (radius + 1) + F.col("i")).alias("path"))
        mask = F.element_at(F.array(*[F.lit(m).cast("long") for m in masks]), F.col("path") + 1)
        keyed = keyed.withColumn("shard", F.col("fp").bitwiseAND(mask))
        last = level == LEVELS - 1
        sizes = keyed.groupBy("path", "shard").agg(F.count("*").alias("n"))
        hot = None if last else materialise(sizes.where(F.col("n") > shard_limit).select("path", "shard"), "simhash-hot")
        some_hot = hot is not None and not hot.isEmpty()
        fit = keyed.join(hot, ["path", "shard"], "left_anti") if some_hot else keyed
        dealt = fit.select("path", "shard", "fp", "rep").repartition("path", "shard").sortWithinPartitions("path", "shard")
        edges = dealt.transform(arrow_map, _forest_of(radius), "src long, dst long")
        found = edges if found is None else found.unionAll(edges)
        if not some_hot:
            break
        rows = keyed.join(hot, ["path", "shard"], "left_semi").select("fp", "rep", "path")
        parent_masks = masks
    return found.distinct()


def simhash_near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, shard_limit: int = 1024
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id``.

    ``fingerprint`` is 16 lower-case hex digits; ``component_id`` is the smallest id that
    links of at most ``radius`` bits reach.  Null and empty texts have fingerprint zero and
    link like any other; repeated rows stay repeated.  A row with a null id keeps its row
    and gets the component of its fingerprint's other rows, null if it has none.
    An empty table gives an empty result; other columns are ignored.
    """
    made = materialise(fingerprints(docs, id_col, text_col, width), "simhash-fp")
    classes = materialise(made.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"), "simhash-classes")
    # a repeated id may stand for several fingerprints: one node for the id joins them
    links = hamming_links(classes.groupBy("fp").agg(F.min("rep").alias("rep")), radius, shard_limit)
    groups = connected_components(links)
    named = classes.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return made.join(named, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
