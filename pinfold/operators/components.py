"""Connected components by union-find within partitions and alternating stars between them.

Edges are dealt by ranges of their smaller end, and every partition replaces its own by the
forest of what they connect: long chains shrink to a few links before anything is joined.
What is left settles in rounds of large-star and small-star.

Every round is two aggregations and two equi-joins on the edge list; no group of edges is
ever collected.  Partial aggregation absorbs hubs, and the joins are plain shuffle joins
whose skewed partitions adaptive execution may split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinfold.runtime import arrow_map, discard, materialise

#: Edges that a partition's union-find holds at a time.
FOREST_EDGES = 1 << 19


def _roots(pairs: list[tuple[int, int]]) -> dict[int, int]:
    """Each end of the pairs with the smallest node that they connect it to."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def _forests(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []

        def forest() -> pa.RecordBatch:
            links = [(x, r) for x, r in _roots(held).items() if x != r]
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in links], pa.int64()) for k in (0, 1)], ["u", "v"])

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns))
            if len(held) >= most:
                yield forest()
                held.clear()
        yield forest()

    return run


def contracted(edges: DataFrame, most: int = FOREST_EDGES) -> DataFrame:
    """Edges ``(u, v)``, ``u > v``, that connect what ``edges(u, v)`` of integers connect: the
    forests of partitions that hold ranges of the smaller end, ``most`` edges at a time."""
    dealt = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).repartitionByRange("v", "u")
    return dealt.sortWithinPartitions("v", "u").transform(arrow_map, _forests(most), "u long, v long")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, contract: bool = False) -> DataFrame:
    """Map each node that has an edge to the smallest node reachable from it.

    Returns ``(node, component)``; nodes without edges are absent.  Self loops and rows
    with a null end are ignored, repeated edges count once, an empty list gives an empty
    result.  ``contract`` runs union-find in the partitions first; nodes must be integers
    then.  Raises RuntimeError if the rounds do not settle (they need O(log^2 n)).
    """
    ends = edges.where(F.col(src) != F.col(dst)).select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
    if contract:
        ends = contracted(materialise(ends, "cc-given"))
    current = materialise(ends.distinct(), "cc-edges")
    state = _state(current)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        following = materialise(_small_star(_large_star(current)), "cc-round")
        discard(current)
        before, state, current = state, _state(following), following
        if before == state:
            break
    else:
        raise RuntimeError("connected components did not settle")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def merge_components(forest: DataFrame, edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` of all edges so far, from the stored result of earlier ones and
    new ``edges``: the same as connecting all edges at once.

    New edges are drawn between the components their ends belong to, so the rounds run on
    what is new; the stored table is read and joined once, and its links never again.
    """
    new = materialise(edges.where(F.col(src) != F.col(dst)).select(F.col(src).alias("a"), F.col(dst).alias("b")).distinct(), "cc-new")
    named = lambda df, end, out: df.join(forest.select(F.col("node").alias(end), F.col("component").alias(out)), end, "left").withColumn(out, F.coalesce(out, end))
    drawn = named(named(new, "a", "src"), "b", "dst").select("src", "dst")
    linked = materialise(connected_components(drawn, contract=True), "cc-linked").select(F.col("node").alias("component"), F.col("component").alias("joined"))
    ends = new.select(F.col("a").alias("node")).unionByName(new.select(F.col("b").alias("node"))).distinct()
    fresh = ends.join(forest.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    every = forest.select("node", "component").unionByName(fresh)
    return every.join(linked, "component", "left").select("node", F.coalesce("joined", "component").alias("component"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the least node of its neighbourhood."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
        # the node itself keeps its link to that least node
        least.where("u <> m").select("u", F.col("m").alias("v"))
    ).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")).first()
    return row["n"], row["h"]
