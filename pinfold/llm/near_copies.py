"""Near copies by exact Jaccard similarity of word shingles, found through SimHash.

Texts with equal shingle sets are one class.  Classes are dealt to shards that agree on a
band of MinHash values; a shard is a BK-tree of 64-bit SimHash fingerprints, searched within
``RADIUS`` bits, and reports a spanning forest.  Its components are candidates only: each is
dealt once more with its texts, and links are what the exact similarity says.

The two filters are wide for the similarity asked for.  At 0.8 two sets agree on at least
one of 16 bands of 4 values with probability 0.9998, and differ in 10 of 64 bits on average,
nearly five standard deviations below ``RADIUS``.  A shard over ``shard_limit``
is one candidate component without a tree.  A component with more than ``BLOCK_CHARS`` of
text is compared as pairs of blocks, every pair of texts in one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinfold.llm.simhash import BITS, _forest_of
from pinfold.operators.components import connected_components
from pinfold.runtime import arrow_map, materialise

WIDTH, SIMILARITY, RADIUS = 5, 0.8, 24
BANDS, ROWS = 16, 4
BLOCK_CHARS = 1 << 20
_CHUNK = 1 << 12
_MIX = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64)
_XOR, _TIMES = _MIX[0], _MIX[1] | np.uint64(1)


def shingles(text: bytes | None, width: int = WIDTH) -> frozenset[int]:
    """64-bit hashes of the word runs of a text; one run if it is shorter, none without words."""
    words = (text or b"").lower().split()
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([xxhash.xxh64_intdigest(b" ".join(words))])
    return frozenset(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[k:] for k in range(width))))))


def _array(grams: frozenset[int]) -> np.ndarray:
    return np.sort(np.fromiter(grams, np.uint64, len(grams)))


def set_fingerprint(hashes: np.ndarray) -> int:
    """Signed majority fingerprint of a shingle set; zero for the empty one."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[k : k + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def band_keys(hashes: np.ndarray) -> list[int]:
    """One signed key for each band of MinHash values."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), _CHUNK):
        np.minimum(least, ((hashes[k : k + _CHUNK, None] ^ _XOR) * _TIMES).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) - (1 << 63) for k in range(BANDS)]


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, prints, keys = [], [], []
            for text in batch.column(1):
                hashes = _array(shingles(text.as_py(), width))
                digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                prints.append(set_fingerprint(hashes))
                keys.append(band_keys(hashes))
            columns = [batch.column(0), pa.array(digests, pa.binary()), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "fp", "bands"])

    return run


def similar_forest(rows: list[tuple[int, int, bytes | None]], width: int, similarity: float) -> list[tuple[int, int]]:
    """Links ``(rep, rep)`` that span all similar pairs of ``rows(rep, block, text)``; with
    two blocks, the pairs across them."""
    sets = [shingles(t, width) for _, _, t in rows]
    prints = np.array([set_fingerprint(_array(s)) for s in sets], np.int64).view(np.uint64)
    sizes, blocks = np.array([len(s) for s in sets]), np.array([b for _, b, _ in rows])
    across, label, out = blocks.min() != blocks.max(), np.arange(len(rows)), []
    for k in range(1, len(rows)):
        near = np.bitwise_count(prints[:k] ^ prints[k]) <= RADIUS
        near &= np.minimum(sizes[:k], sizes[k]) >= similarity * np.maximum(sizes[:k], sizes[k]) - 1e-6
        if across:
            near &= blocks[:k] != blocks[k]
        left = np.flatnonzero(near)
        while left.size:
            j, left = left[0], left[1:]
            both = len(sets[j] & sets[k])
            union = len(sets[j]) + len(sets[k]) - both
            if not union or both / union >= similarity:
                out.append((rows[k][0], rows[j][0]))
                label[label == label[j]] = label[k]
                left = left[label[left] != label[k]]
    return out


def _verified(width: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []
        for batch in batches:
            for component, low, high, rep, block, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (component, low, high) != key:
                    if len(rows) > 1:
                        out.extend(similar_forest(rows, width, similarity))
                    key, rows = (component, low, high), []
                rows.append((rep, block, text))
        if len(rows) > 1:
            out.extend(similar_forest(rows, width, similarity))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], ["src", "dst"])

    return run


def _candidates(classes: DataFrame, shard_limit: int) -> DataFrame:
    """``(node, component)`` of the classes that some shard links."""
    keyed = classes.select(F.explode("bands").alias("shard"), "fp", "rep")
    sizes = keyed.groupBy("shard").agg(F.count("*").alias("n"), F.min("rep").alias("dst"))
    hot = F.broadcast(materialise(sizes.where(F.col("n") > shard_limit).select("shard", "dst"), "copies-hot"))
    fit = keyed.join(hot, "shard", "left_anti").select(F.lit(0).alias("path"), "shard", "fp", "rep")
    dealt = fit.repartition("path", "shard").sortWithinPartitions("path", "shard")
    edges = dealt.transform(arrow_map, _forest_of(RADIUS), "src long, dst long")
    return connected_components(edges.unionAll(keyed.join(hot, "shard").select(F.col("rep").alias("src"), "dst")).distinct())


def jaccard_near_dedup(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, shard_limit: int = 1024, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(doc_id, component_id)`` for every row of ``docs(doc_id, text)`` with an id.

    ``component_id`` is the smallest id that links of at least ``similarity`` reach.  Texts
    without words are alike; a repeated id keeps its rows and is one node.
    """
    plain = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    made = materialise(plain.transform(arrow_map, _sketches(width), "doc_id long, digest binary, fp long, bands array<long>"), "copies-sketch")
    classes = materialise(made.groupBy("digest", "fp", "bands").agg(F.min("doc_id").alias("rep")), "copies-classes")
    candidates = materialise(_candidates(classes, shard_limit), "copies-candidates")
    texts = plain.join(candidates.withColumnRenamed("node", "doc_id"), "doc_id")
    texts = materialise(texts.select("component", F.col("doc_id").alias("rep"), "text").distinct(), "copies-texts")
    blocks = texts.groupBy("component").agg(F.ceil((F.sum(F.coalesce(F.octet_length("text"), F.lit(0))) + 1) / block_chars).cast("int").alias("n"))
    many = F.broadcast(materialise(blocks.where("n > 1"), "copies-blocks"))
    cut = texts.join(many, "component", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("n")).cast("int"))
    paired = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    paired = paired.select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "rep", "block", "text")
    dealt = paired.repartition("component", "low", "high").sortWithinPartitions("component", "low", "high", "rep")
    links = dealt.transform(arrow_map, _verified(width, similarity), "src long, dst long")
    groups = connected_components(links)
    named = classes.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    return made.select("doc_id", "digest").join(named, "digest").select("doc_id", "component_id")
