"""Prefix trie of conversations by Patricia construction.

Conversations are sequences of turns; a turn is a digest of 16 bytes, a sequence the bytes
of its turns.  Different sequences are sorted into ranges.  In a sorted range the shared
prefix of each sequence with the one before tells all points of the trie that matter:
branches, ends and leaves.  A stack builds them in one pass and adds up what lies below;
stretches without a branch or an end are one compressed edge.

A point that lies on several ranges gets a part from each.  For the parts to agree, a range
must know which points other ranges put on the paths of its first and last sequence.  Every
range tells its own depths on these two paths, one task folds these short lists from the
left and from the right, and the stacks take up what it found.  Parts of a point are then
summed by its digest, and a compressed edge is expanded into its unary nodes by the suffix
sums of the words on it.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinfold.llm.checksums import crc32_sql
from pinfold.llm.mixing import word_count
from pinfold.runtime import arrow_map, broadcast_checked, materialise

#: Bytes of a turn, hexadecimal digits of a node, and bits of the ids that are joined at once.
TURN, NODE, CHUNK_BITS = 16, 32, 13
#: Conversations that share their beginnings; turns they share are fewer than this.
FAMILY, HEADS = 20, 4

SUMMARY = "part int, first binary, last binary, front array<int>, back array<int>"
BORDERS = "part int, key binary, before int, after int, left array<int>, right array<int>"
POINTS = "id string, parent string, depth int, n long, conv_id long, leaves long, all_words long, new_words long, words long, suffix array<long>"

_WORDS = r"len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))"
ORACLE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, string_agg(d, '' ORDER BY turn NULLS FIRST, d) AS seq, list({_WORDS} ORDER BY turn NULLS FIRST, d) AS w FROM t GROUP BY conv_id),
heads AS (SELECT *, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM own),
rebuilt AS (
  SELECT o.conv_id, coalesce(b.seq, '')[1:64 * o.h] || o.seq[64 * o.h + 1:] AS seq, list_concat(coalesce(b.w, [])[1:o.h], o.w[o.h + 1:]) AS w
  FROM heads o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
paths AS (SELECT conv_id, k AS depth, seq[1:64 * k] AS pre, CASE WHEN k > 0 THEN w[k] ELSE 0 END AS words, len(w) = k AS ends FROM (SELECT *, unnest(range(0, len(w) + 1)) AS k FROM rebuilt)),
nodes AS (
  SELECT pre, depth, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * any_value(words) AS saved,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM paths GROUP BY pre, depth),
kids AS (SELECT pre[1:64 * (depth - 1)] AS pre, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (
  SELECT pre[1:64 * k] AS pre, sum(saved) AS saved, count(*) FILTER (n_children IS NULL) AS leaves
  FROM (SELECT n.pre, n.saved, c.n_children, unnest(range(0, n.depth + 1)) AS k FROM nodes n LEFT JOIN kids c USING (pre)) GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(c.n_children, 0) AS n_children,
       b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b USING (pre) LEFT JOIN kids c USING (pre) LEFT JOIN nodes p ON n.depth > 0 AND p.pre = n.pre[1:64 * (n.depth - 1)]
"""


def _hex_id(prefix: bytes) -> str:
    return hashlib.sha256(prefix).hexdigest()[:NODE]


def shared_turns(a: bytes, b: bytes) -> int:
    """How many turns two sequences begin with alike."""
    low, high = 0, min(len(a), len(b)) // TURN
    if a[: high * TURN] == b[: high * TURN]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low * TURN : mid * TURN] == b[low * TURN : mid * TURN]:
            low = mid
        else:
            high = mid
    return low


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range ``(part, key)``: its first and last sequence and the depths of its own
    points on their paths."""
    at, out = None, []
    for batch in batches:
        for part, key in zip(*(c.to_pylist() for c in batch.columns)):
            size = len(key) // TURN
            if part != at:
                if at is not None:
                    out.append((at, first, last, front, stack))
                at, first, front, stack, low = part, key, [size], [size], size
            else:
                shared = shared_turns(last, key)
                while stack and stack[-1] >= shared:
                    stack.pop()
                stack += [shared, size]
                if shared <= low:
                    low = shared
                    front.append(shared)
            last = key
    if at is not None:
        out.append((at, first, last, front, stack))
    yield _rows(SUMMARY, out)


def fold_borders(ranges: list[tuple]) -> list[tuple]:
    """From the summaries of all ranges in order, what each has to know of the others:
    turns shared with the sequence before and after it, and the depths of all points on the
    paths of its first and of its last sequence that others put there."""
    if not ranges:
        return []
    shared = [shared_turns(a[2], b[1]) for a, b in zip(ranges, ranges[1:])]
    whole = [shared_turns(r[1], r[2]) for r in ranges]
    n = len(ranges)
    left, right = [set()] * n, [set()] * n
    for k in range(1, n):
        known = set(ranges[k - 1][4]) | {d for d in left[k - 1] if d <= whole[k - 1]}
        left[k] = {d for d in known if d <= shared[k - 1]} | {shared[k - 1]}
    for k in range(n - 2, -1, -1):
        known = set(ranges[k + 1][3]) | {d for d in right[k + 1] if d <= whole[k + 1]}
        right[k] = {d for d in known if d <= shared[k]} | {shared[k]}
    out = []
    for k, (part, first, *_) in enumerate(ranges):
        on_first = left[k] | {d for d in right[k] if d <= whole[k]}
        on_last = right[k] | {d for d in left[k] if d <= whole[k]}
        out.append((part, first, shared[k - 1] if k else -1, shared[k] if k < n - 1 else -1, sorted(on_first), sorted(on_last)))
    return out


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ranges = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))]
    yield _rows(BORDERS, fold_borders(ranges))


class _Point:
    """An open point: its depth, and sums over the sequences below it in this range."""

    __slots__ = ("depth", "known", "n", "conv_id", "leaves", "all_words", "new_words")

    def __init__(self, depth: int, known: bool) -> None:
        self.depth, self.known = depth, known
        self.n, self.conv_id, self.leaves, self.all_words, self.new_words = 0, None, 0, 0, 0

    def take(self, n: int, conv_id: int, leaves: int, all_words: int, new_words: int) -> None:
        self.n += n
        self.conv_id = conv_id if self.conv_id is None else min(self.conv_id, conv_id)
        self.leaves += leaves
        self.all_words += all_words
        self.new_words += new_words


class PatriciaRange:
    """The compressed trie of one range of sorted sequences.

    ``known`` points and the edges to them are counted by an earlier range as well, so their
    words are new there.  ``done`` collects rows of ``POINTS``.
    """

    def __init__(self, before: int, after: int, left: list[int], right: list[int]) -> None:
        self.before, self.after, self.right = before, after, right
        self.stack = [_Point(d, d <= before) for d in sorted({0, *left})]
        self.key, self.upto, self.low, self.done = None, [0], None, []

    def add(self, key: bytes, n: int, conv_id: int, words: list[int]) -> None:
        size = len(key) // TURN
        if self.key is not None:
            shared = shared_turns(self.key, key)
            self.low = shared if self.low is None else min(self.low, shared)
            self._close(shared)
        self.key, self.upto = key, [0, *accumulate(words)]
        if self.stack[-1].depth < size:
            self.stack.append(_Point(size, False))
        self.stack[-1].take(n, conv_id, 0, n * self.upto[size], 0)

    def _close(self, shared: int) -> None:
        """End the points of the last sequence deeper than ``shared``, where a point is left."""
        if shared < len(self.key) // TURN:
            self.stack[-1].leaves += 1
        while self.stack[-1].depth > shared:
            point = self.stack.pop()
            if self.stack[-1].depth < shared:
                self._open(shared)
            self._end(point, self.stack[-1])

    def _open(self, depth: int) -> None:
        on_first = self.low is None or depth <= self.low
        self.stack.append(_Point(depth, on_first and depth <= self.before))

    def _end(self, point: _Point, parent: _Point | None) -> None:
        top = parent.depth if parent else 0
        suffix = [self.upto[point.depth] - self.upto[d] for d in range(top, point.depth)] if parent else [0]
        above = _hex_id(self.key[: top * TURN]) if parent else None
        self.done.append((_hex_id(self.key[: point.depth * TURN]), above, point.depth, point.n, point.conv_id, point.leaves, point.all_words, point.new_words, self.upto[point.depth], suffix))
        if parent:
            parent.take(point.n, point.conv_id, point.leaves, point.all_words, point.new_words + (0 if point.known else suffix[0]))

    def finish(self) -> None:
        """End all points; what other ranges put on the last path is among them."""
        if self.after < len(self.key) // TURN:
            self.stack[-1].leaves += 1
        depths = [p.depth for p in self.stack]
        for d in self.right:
            if d not in depths:
                on_first = self.low is None or d <= self.low
                place = bisect.bisect(depths, d)
                depths.insert(place, d)
                self.stack.insert(place, _Point(d, on_first and d <= self.before))
        while self.stack:
            point = self.stack.pop()
            self._end(point, self.stack[-1] if self.stack else None)


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, trie = None, None
    for batch in batches:
        for part, key, n, conv_id, words, before, after, left, right in zip(*(c.to_pylist() for c in batch.columns)):
            if part != at:
                if trie:
                    trie.finish()
                    yield _rows(POINTS, trie.done)
                at, trie = part, PatriciaRange(before, after, left, right)
            trie.add(key, n, conv_id, words)
            if len(trie.done) >= 1 << 14:
                yield _rows(POINTS, trie.done)
                trie.done = []
    if trie:
        trie.finish()
        yield _rows(POINTS, trie.done)


def compressed_trie(sequences: DataFrame) -> DataFrame:
    """Points of the Patricia trie over different ``sequences(key, n, conv_id, words)``:
    ``id, parent, depth, n, conv_id, leaves, below, suffix``.

    ``below`` is what sharing saves strictly below a point; ``suffix[k]`` are the words from
    the k-th node of the edge to it on, the last one being its own."""
    order = materialise(sequences.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "trie-order")
    sorted_keys = order.select("part", "key").repartition("part").sortWithinPartitions("part", "key")
    summaries = materialise(sorted_keys.transform(arrow_map, _summaries, SUMMARY), "trie-ranges")
    # one short row a range: their first and last sequences only
    borders = materialise(summaries.repartition(1).sortWithinPartitions("part").transform(arrow_map, _fold, BORDERS), "trie-borders")
    told = order.join(broadcast_checked(borders, "key", "left", "right"), ["part", "key"], "left")
    dealt = told.select("part", "key", "n", "conv_id", "words", "before", "after", "left", "right").repartition("part").sortWithinPartitions("part", "key")
    parts = dealt.transform(arrow_map, _points, POINTS)
    sums = [F.sum(c).alias(c) for c in ("n", "leaves", "all_words", "new_words")]
    whole = parts.groupBy("id").agg(*[F.first(c).alias(c) for c in ("parent", "depth", "words", "suffix")], F.min("conv_id").alias("conv_id"), *sums)
    below = F.col("all_words") - F.col("n") * F.col("words") - F.col("new_words")
    return whole.select("id", "parent", "depth", "n", "conv_id", "leaves", below.alias("below"), "suffix")


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined texts of each id, which come in order."""
    at, running, out = None, None, []
    for batch in batches:
        for node, text in zip(*(c.to_pylist() for c in batch.columns)):
            if node != at:
                if at is not None:
                    out.append((at, running.hexdigest()))
                at, running = node, hashlib.sha256(text.encode())
            else:
                running.update(b"," + text.encode())
        if len(out) >= 1 << 14:
            yield _rows("id string, ends_sha256 string", out)
            out = []
    if at is not None:
        out.append((at, running.hexdigest()))
    yield _rows("id string, ends_sha256 string", out)


def end_hashes(members: DataFrame) -> DataFrame:
    """``id, ends_sha256`` of ``members(id, conv_id)``.  Ids are joined in stretches of
    numbers first, so a node that ends a third of all conversations sends one row for some
    thousands of them to the task that hashes it."""
    stretch = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    joined = members.groupBy("id", F.shiftright("conv_id", CHUNK_BITS).alias("stretch")).agg(stretch.alias("text"))
    return joined.repartition("id").sortWithinPartitions("id", "stretch").select("id", "text").transform(arrow_map, _hashes, "id string, ends_sha256 string")


def _node(key: Column) -> Column:
    return F.substring(F.sha2(key, 256), 1, NODE)


def rebuilt_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, key, words`` of all conversations, each behind the first turns of the one
    whose number is the next lower multiple of ``FAMILY``: CRC-32 of its own number modulo
    ``HEADS`` of them take the place of as many of its own."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * TURN)
    turn = F.col("turn").cast("long")
    each = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(turn.isNotNull().alias("known"), F.coalesce(turn, F.lit(0)).alias("at"), digest.alias("d"), word_count(text).alias("w")).alias("t"))
    own = materialise(each.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("own")), "trie-turns")
    head = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(head, "base", "left")
    taken = F.slice(F.coalesce("head", F.slice("own", 1, 0)), F.lit(1), h)
    told = both.withColumn("turns", F.concat(taken, F.slice("own", h + 1, F.size("own"))))
    return told.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["d"]), "")).alias("key"), F.transform("turns", lambda t: t["w"]).alias("words"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: ``conv_id`` (smallest member),
    ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Turns are ordered by ``turn``, null first, turns of one number by their digest; null
    roles and texts are empty.  Rows without a ``conv_id`` belong to no conversation and are
    left out; other columns are ignored.  Repeated rows are turns of their own.  An empty
    table has no nodes, as no member would name the root.  The turns of one conversation, 24
    bytes each, must fit in a row.
    """
    rebuilt = materialise(rebuilt_conversations(turns), "trie-rebuilt")
    sequences = rebuilt.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.first("words").alias("words"))
    points = materialise(compressed_trie(materialise(sequences, "trie-sequences")), "trie-points")
    children = points.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("children"))
    above = points.select(F.col("id").alias("parent"), F.col("conv_id").alias("above"))
    ends = end_hashes(rebuilt.select(_node(F.col("key")).alias("id"), "conv_id"))
    told = points.join(children, "id", "left").join(ends, "id", "left").join(above, "parent", "left")
    each = told.select("*", F.posexplode("suffix").alias("k", "rest"))
    own = F.col("k") == F.size("suffix") - 1
    return each.select(
        "conv_id",
        (F.col("depth") - F.size("suffix") + 1 + F.col("k")).cast("long").alias("depth"),
        F.when(F.col("k") > 0, F.col("conv_id")).otherwise(F.col("above")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(own, F.coalesce("children", F.lit(0))).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("below") + (F.col("n") - 1) * F.col("rest")).alias("saved_tokens"),
        F.when(own, F.col("ends_sha256")).otherwise(F.lit(None)).alias("ends_sha256"),
    ).withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
