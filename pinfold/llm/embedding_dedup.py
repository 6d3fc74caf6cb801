"""Embedding near-duplicates by product quantisation with an exact cosine rerank.

* Equal vectors of one label are one class, compared once and counted by weight.
* A coarse quantiser (k-means) deals every class to an inverted list; the residual is coded
  by one small codebook per subspace.  Both are fitted on a bounded sample; every vector is
  coded and searched.
* Every class queries its ``probes`` nearest lists.  Asymmetric distances come from one
  table lookup per subspace.  ``|x - y| >= |x - code(y)| - err(y)``, and ``err`` is stored
  with the code, so the distance filter never loses a pair; only unprobed lists can.
* What passes is compared by exact cosine in double precision.

Vectors of one length have an index of their own, the ``LENGTHS`` most frequent lengths of
``LEAST`` classes and more; those of any other length are compared exhaustively, each with
all of its label and length, which needs no index and loses nothing.

A list and its queries are cut into blocks, and one task step holds one block of each, so
a list that gathers a third of all vectors is shared by many tasks.  Blocks report link
counts and a spanning forest, never their pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinfold.operators.components import connected_components
from pinfold.runtime import arrow_map, materialise

#: Classes the index is fitted on, lists it has at most, classes a list holds on average.
SAMPLE, MOST_LISTS, PER_LIST = 8192, 4096, 512
SUBSPACES, CENTROIDS, PROBES = 8, 32, 16
#: Lengths with an index at most, classes of such a length at least, bytes of a length's sample.
LENGTHS, LEAST, SAMPLE_BYTES = 4, 256, 1 << 28
#: Entries and queries of one list that meet at a time; queries of one matrix step.
BLOCK, STEP = 4096, 256


@dataclass
class Index:
    """Coarse centroids ``(lists, d)`` and codebooks ``(subspaces, centroids, d / subspaces)``."""

    coarse: np.ndarray
    books: np.ndarray
    probes: int

    def lists_of(self, x: np.ndarray) -> np.ndarray:
        """Nearest lists of each row, nearest first; ties go to the lower number."""
        far = (self.coarse**2).sum(1)[None, :] - 2 * x @ self.coarse.T
        return np.argsort(far, axis=1, kind="stable")[:, : self.probes]

    def code(self, residual: np.ndarray) -> np.ndarray:
        m, k, w = self.books.shape
        out = np.empty((len(residual), m), np.uint8)
        for s in range(m):
            part = residual[:, s * w : (s + 1) * w]
            out[:, s] = ((self.books[s] ** 2).sum(1)[None, :] - 2 * part @ self.books[s].T).argmin(1)
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.books[s][codes[:, s]] for s in range(len(self.books))], axis=1)

    def tables(self, residual: np.ndarray) -> np.ndarray:
        """Squared distances of each row's subvectors to all codewords: (rows, m, k)."""
        m, k, w = self.books.shape
        parts = residual.reshape(len(residual), m, 1, w)
        return ((parts - self.books[None]) ** 2).sum(3)


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm from ``k`` distinct rows; an empty cluster keeps its centre."""
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        full = count > 0
        centres[full] = total[full] / count[full, None]
    return centres


def fit_index(sample: np.ndarray, lists: int, probes: int = PROBES, subspaces: int = SUBSPACES, centroids: int = CENTROIDS) -> Index:
    """Fit on unit vectors whose width is a multiple of ``subspaces``."""
    coarse = kmeans(sample, lists, 8, seed=1)
    near = ((coarse**2).sum(1)[None, :] - 2 * sample @ coarse.T).argmin(1)
    residual, w = sample - coarse[near], sample.shape[1] // subspaces
    books = [kmeans(residual[:, s * w : (s + 1) * w], centroids, 8, seed=2 + s) for s in range(subspaces)]
    k = max(map(len, books))
    books = [np.concatenate([b, np.repeat(b[:1], k - len(b), axis=0)]) for b in books]
    return Index(coarse, np.stack(books), min(probes, len(coarse)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Raw vectors to double bytes and a digest; both null where a vector can't link."""
    for batch in batches:
        vecs, keys, dims = [], [], []
        for label, v in zip(batch.column(1), batch.column(2)):
            x = None
            if label.is_valid and v.is_valid and len(v.values):
                x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64) + 0.0
                with np.errstate(over="ignore", invalid="ignore"):
                    scale = np.abs(x).max()
                    usable = np.isfinite(x).all() and scale > 0
                x = x / scale if usable else None
            vecs.append(None if x is None else x.tobytes())
            keys.append(None if x is None else hashlib.blake2b(x.tobytes(), digest_size=16).digest())
            dims.append(0 if x is None else len(x))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())],
            ["vec_id", "label", "dim", "key", "vec"],
        )


def _unit(raw: list[bytes]) -> np.ndarray:
    """Unit vectors of one length, padded to a multiple of ``SUBSPACES``."""
    n = len(raw[0]) // 8
    out = np.zeros((len(raw), -(-n // SUBSPACES) * SUBSPACES))
    out[:, :n] = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), n)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _assign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes: dict[int, Index] = shared.value
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                if index := indexes.get(int(dim)):
                    x = _unit(part.column(4).to_pylist())
                    lists = index.lists_of(x)
                    residual = x - index.coarse[lists[:, 0]]
                    codes = index.code(residual)
                    err = np.linalg.norm(residual - index.decode(codes), axis=1)
                else:
                    lists, codes, err = np.zeros((part.num_rows, 1)), [b""] * part.num_rows, np.zeros(part.num_rows)
                made = [pa.array(list(lists.astype(np.int32)), pa.list_(pa.int32())), pa.array([bytes(c) for c in codes], pa.binary()), pa.array(err)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], ["rep", "weight", "label", "dim", "vec", "lists", "code", "err"])

    return run


def _search(shared, threshold: float):
    limit = np.sqrt(2 - 2 * threshold)

    def step(index: Index | None, e: dict, q: dict, cell: int):
        """Links of a few queries with the entries: (query position, entry position)."""
        if index is None:
            qi, ei = np.nonzero((q["x"] @ e["x"].T >= threshold - 1e-9) & (q["rep"][:, None] != e["rep"][None, :]))
            ok = np.einsum("ij,ij->i", q["x"][qi], e["x"][ei]) >= threshold
            return qi[ok], ei[ok]
        tables = index.tables(q["x"] - index.coarse[cell])
        d = np.zeros((len(q["x"]), len(e["x"])))
        for s in range(tables.shape[1]):
            d += tables[:, s, :][:, e["codes"][:, s]]
        qi, ei = np.nonzero(np.sqrt(np.maximum(d, 0)) <= limit + e["err"][None, :] + 1e-9)
        keep = []
        for at in range(0, len(qi), 1 << 15):
            a, b = qi[at : at + (1 << 15)], ei[at : at + (1 << 15)]
            keep.append((np.einsum("ij,ij->i", q["x"][a], e["x"][b]) >= threshold) & (q["rep"][a] != e["rep"][b]))
        ok = np.concatenate(keep) if keep else np.zeros(0, bool)
        return qi[ok], ei[ok]

    def part(rows: list[tuple]) -> dict:
        return {
            "rep": np.array([r[0] for r in rows], np.int64), "weight": np.array([r[1] for r in rows], np.int64), "x": _unit([r[2] for r in rows]),
            "lists": np.array([r[3] for r in rows], np.int32), "codes": np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), -1), "err": np.array([r[5] for r in rows]),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes: dict[int, Index] = shared.value
        key, entries, e, queries = None, [], None, []
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def meet() -> None:
            """The queries gathered so far against the entries of the current block."""
            nonlocal e, queries
            if entries and queries:
                if e is None:
                    e = part(entries)
                    e["group"], e["count"] = e["rep"].copy(), np.zeros(len(entries), np.int64)
                q, cell = part(queries), key[2]
                qi, ei = step(indexes.get(key[1]), e, q, cell)
                if len(qi):
                    count = np.zeros(len(queries), np.int64)
                    np.add.at(count, qi, e["weight"][ei])
                    # the entry meets this query as its own query only if it probes the query's list
                    alone = ~(e["lists"][ei] == q["lists"][qi, :1]).any(axis=1)
                    np.add.at(e["count"], ei[alone], q["weight"][qi[alone]])
                    group, before = q["rep"].copy(), e["group"].copy()
                    while True:
                        least = np.minimum(group[qi], e["group"][ei])
                        if (least == group[qi]).all() and (least == e["group"][ei]).all():
                            break
                        np.minimum.at(group, qi, least)
                        np.minimum.at(e["group"], ei, least)
                    some = count > 0
                    out.append((q["rep"][some], group[some], count[some]))
                    moved = np.unique(np.stack([before, e["group"]], 1)[before != e["group"]], axis=0)
                    out.append((moved[:, 0], moved[:, 1], np.zeros(len(moved), np.int64)))
            queries = []

        def close() -> None:
            nonlocal entries, e
            meet()
            if e is not None and (some := e["count"] > 0).any():
                out.append((e["rep"][some], e["rep"][some], e["count"][some]))
            entries, e = [], None

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:5] != key:
                    close()
                    key = row[:5]
                if row[5]:
                    queries.append(row[6:])
                    if len(queries) >= STEP:
                        meet()
                else:
                    entries.append(row[6:])
            if sum(len(o[0]) for o in out) > 50_000:
                yield _found(out)
                out.clear()
        close()
        yield _found(out)

    return run


def _found(out: list[tuple]) -> pa.RecordBatch:
    cols = [np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["src", "dst", "n"])


def embedding_near_dedup(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, probes: int = PROBES
) -> DataFrame:
    """One row per row of ``vectors``: ``vec_id, n_links, component_id, kept``.

    Vectors link if their labels are equal and not null and their cosine is at least
    ``threshold``.  Null, empty, zero vectors and those with null or non-finite components
    have no links and are their own component; so are vectors of a length that no other
    vector of the label has.  Repeated rows count as vectors of their own.  A row with a
    null id links with nothing and has a null component.  An empty table gives an empty
    result; other columns are ignored.
    """
    spark = vectors.sparkSession
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))
    read = materialise(raw.transform(arrow_map, _read, "vec_id long, label string, dim int, key binary, vec binary"), "pq-vectors")
    classes = materialise(
        read.where("key is not null and vec_id is not null").groupBy("label", "dim", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.min("vec").alias("vec")),
        "pq-classes",
    )
    lengths = classes.groupBy("dim").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST).orderBy(F.desc("n"), "dim").limit(LENGTHS).collect()
    indexes = {}
    for length in lengths:
        most = max(LEAST // 4, min(SAMPLE, SAMPLE_BYTES // (8 * length.dim)))
        sample = classes.where(F.col("dim") == length.dim).select("vec", F.xxhash64("rep", F.lit(7)).alias("h")).orderBy("h", "vec").limit(most).collect()
        indexes[length.dim] = fit_index(_unit([bytes(r.vec) for r in sample]), max(1, min(MOST_LISTS, length.n // PER_LIST)), probes)
    shared = spark.sparkContext.broadcast(indexes)
    # a vector that is alone with its label and length meets nothing
    company = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    coded = materialise(
        classes.join(company, ["label", "dim"], "left_semi").select("rep", "weight", "label", "dim", "vec").transform(
            arrow_map, _assign(shared), "rep long, weight long, label string, dim int, vec binary, lists array<int>, code binary, err double"
        ),
        "pq-codes",
    )
    rest = ["rep", "weight", "vec", "lists", "code", "err"]
    entries = coded.select("label", "dim", F.element_at("lists", 1).alias("list"), *rest)
    queries = coded.select("label", "dim", F.explode("lists").alias("list"), *rest)
    at = ["label", "dim", "list"]
    blocks = lambda df, name: df.groupBy(*at).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    # a list nothing is in, or nothing but one class probes, needs no search
    sizes = materialise(blocks(entries, "e_blocks").join(blocks(queries, "q_blocks"), at), "pq-sizes")
    salt = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    e = entries.join(sizes, at).withColumn("eb", salt(F.col("e_blocks"))).withColumn("qb", every(F.col("q_blocks")))
    q = queries.join(sizes, at).withColumn("qb", salt(F.col("q_blocks"))).withColumn("eb", every(F.col("e_blocks")))
    cols = [*at, "eb", "qb", "role", *rest]
    both = e.withColumn("role", F.lit(0)).select(*cols).unionAll(q.withColumn("role", F.lit(1)).select(*cols))
    met = both.repartition(*cols[:5]).sortWithinPartitions(*cols[:6])
    found = materialise(met.transform(arrow_map, _search(shared, threshold), "src long, dst long, n long"), "pq-links")
    groups = connected_components(found)
    links = found.groupBy(F.col("src").alias("rep")).agg(F.sum("n").alias("n"))
    named = (
        classes.join(links, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "dim", "key", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    linked = F.col("vec_id").isNotNull()
    out = read.drop("vec").join(named, ["label", "dim", "key"], "left").select(
        "vec_id", F.when(linked, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.when(linked, F.coalesce("component_id", "vec_id")).alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
ok AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS w FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
reach AS (SELECT vec_id AS u, vec_id AS w FROM embeddings UNION SELECT r.u, l.w FROM reach r JOIN links l ON l.u = r.w),
least AS (SELECT u, min(w) AS component_id FROM reach GROUP BY u), degree AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e LEFT JOIN least ON least.u = e.vec_id LEFT JOIN degree d ON d.u = e.vec_id
"""
