"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items meet on shared seeds of five tokens.  Each pair that shares a
seed is tiled: the longest common runs of tokens not yet covered are marked first, found by
running Karp-Rabin over falling lengths, so a passage is found whatever order its parts
stand in.  An item counts as leaked where tiles cover ``COVERAGE`` of its tokens, or one
tile alone has ``LONG_TILE``: a long item quoted in part.

Items are broadcast in blocks of bounded size, one pass over the documents for each block;
documents are never shuffled, and every document is read whole.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinfold.runtime import arrow_map, materialise

#: Tokens of a seed, which is also the shortest tile; share of an item that makes a leak, and
#: tokens of one tile that make one whatever the share.
SEED, COVERAGE, LONG_TILE = 5, 0.5, 13
#: Characters of benchmark text that are broadcast at a time.
BLOCK_CHARS = 500_000
TOKEN = re.compile(r"\w+").findall
_BASE, _MOD = 1_000_003, (1 << 61) - 1


def tokens(text: str | None) -> list[str]:
    return TOKEN(text.lower()) if text else []


def _scan(p: list, t: list, p_free: list[bool], t_free: list[bool], s: int) -> tuple[int, list[tuple[int, int, int]]]:
    """Maximal common runs of at least ``s`` free tokens by Karp-Rabin: (length, p, t).

    Stops at a run of more than ``2 * s`` and returns its length, to restart with it.
    """
    top = pow(_BASE, s - 1, _MOD)

    def windows(x: list, free: list[bool]) -> Iterator[tuple[int, int]]:
        h = run = 0
        for k, token in enumerate(x):
            if not free[k]:
                h = run = 0
                continue
            if run >= s:
                h = (h - hash(x[k - s]) * top) % _MOD
            h = (h * _BASE + hash(token)) % _MOD
            run += 1
            if run >= s:
                yield k - s + 1, h

    table = defaultdict(list)
    for at, h in windows(p, p_free):
        table[h].append(at)
    found = []
    for j, h in windows(t, t_free):
        for i in table.get(h, ()):
            # a run that continues one further left is that run's
            if i and j and p_free[i - 1] and t_free[j - 1] and p[i - 1] == t[j - 1]:
                continue
            if p[i : i + s] != t[j : j + s]:
                continue
            k = s
            while i + k < len(p) and j + k < len(t) and p_free[i + k] and t_free[j + k] and p[i + k] == t[j + k]:
                k += 1
            if k > 2 * s:
                return k, []
            found.append((k, i, j))
    return 0, found


def greedy_tiles(p: list, t: list, least: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles ``(p position, t position, length)`` of at least ``least`` tokens, longest
    first, equal lengths by position.  ``None`` in ``t`` matches nothing."""
    p_free, t_free = [True] * len(p), [x is not None for x in t]
    tiles, s = [], max(least, 20)
    while True:
        longer, found = _scan(p, t, p_free, t_free, s)
        if longer:
            s = longer
            continue
        heap = [(-k, i, j) for k, i, j in found]
        heapq.heapify(heap)
        while heap:
            k, i, j = heapq.heappop(heap)
            k = -k
            if all(p_free[i : i + k]) and all(t_free[j : j + k]):
                tiles.append((i, j, k))
                p_free[i : i + k] = t_free[j : j + k] = [False] * k
                continue
            # what is left of a run that an earlier tile has cut; shorter rests come later
            start = 0
            for x in range(k + 1):
                if x == k or not (p_free[i + x] and t_free[j + x]):
                    if x - start >= s:
                        heapq.heappush(heap, (start - x, i + start, j + start))
                    start = x + 1
        if s == least:
            return tiles
        s = s // 2 if s > 2 * least else least


class Items:
    """One block of benchmark items with their seeds."""

    def __init__(self, rows: Iterable[tuple[int, str | None]], seed: int = SEED) -> None:
        self.seed, self.tokens, self.seeds = seed, {}, defaultdict(set)
        for number, (item, text) in enumerate(rows):
            words = tokens(text)
            if len(words) >= seed:
                self.tokens[number] = (item, words)
                for g in zip(*(words[k:] for k in range(seed))):
                    self.seeds[g].add(number)
        self.seeds = dict(self.seeds)

    def leaks(self, text: str | None, coverage: float) -> list[tuple[int, float, int]]:
        """``(item, covered share, tiles)`` of the items that a text leaks."""
        words, seeds, n = tokens(text), self.seeds, self.seed
        hits: dict[int, list[int]] = defaultdict(list)
        for at, g in enumerate(zip(*(words[k:] for k in range(n)))):
            if g in seeds:
                for number in seeds[g]:
                    hits[number].append(at)
        out = []
        for number, at in sorted(hits.items()):
            item, pattern = self.tokens[number]
            # tiles lie within runs of seeds, so the rest of the text is left out
            runs: list = []
            end = -1
            for a in at:
                if a > end and runs:
                    runs.append(None)
                runs.extend(words[max(a, end) : a + n])
                end = a + n
            tiles = greedy_tiles(pattern, runs, n)
            share = sum(k for _, _, k in tiles) / len(pattern)
            if share >= coverage or max((k for _, _, k in tiles), default=0) >= LONG_TILE:
                out.append((item, share, len(tiles)))
        return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    block, chars = [], 0
    for row in benchmark.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).toLocalIterator():
        if row[1] is None:
            continue
        if block and chars + len(row[1]) > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append((row[0], row[1]))
        chars += len(row[1])
    if block:
        yield block


def leaked_items(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, coverage, n_tiles`` for every leaked item of every document.

    Null and empty texts leak nothing; items of fewer than ``SEED`` tokens have no seed and
    are never reported.  Repeated documents and items give repeated rows.  Empty tables
    give an empty result; other columns are ignored.
    """
    spark, out = docs.sparkSession, None
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, coverage double, n_tiles int"

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items: Items = shared.value
            for batch in batches:
                found = [(d.as_py(), *leak) for d, t in zip(batch.column(0), batch.column(1)) for leak in items.leaks(t.as_py(), coverage)]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], ["doc_id", "item_id", "coverage", "n_tiles"])

        return run

    for block in _blocks(benchmark, item_id, text_col):
        shared = spark.sparkContext.broadcast(Items(block))
        found = materialise(plain.transform(arrow_map, search(shared), schema), "leaks")
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def drop_leaking(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that leak no benchmark item, all columns kept, whatever their
    names.

    Null and empty texts leak nothing and stay, items of fewer than ``SEED`` tokens are
    never found, repeated rows stay or go together; an empty benchmark changes nothing.
    """
    names, spark = docs.columns, docs.sparkSession
    at = names.index(text_col)

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items: Items = shared.value
            for batch in batches:
                yield batch.filter(pa.array([not items.leaks(t.as_py(), coverage) for t in batch.column(at)], pa.bool_()))

        return run

    for block in _blocks(benchmark, item_id, "text"):
        docs = docs.transform(arrow_map, search(spark.sparkContext.broadcast(Items(block))), docs.schema)
    return docs
