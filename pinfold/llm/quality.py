"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text is a set of hashed features: its words, beginnings of words, and bins of what its
characters and words look like.  One weight vector is shared by all grades; ordered thresholds cut the score
into grades: ``P(grade >= k) = logistic(score - threshold_k)``.  That gives the expected
grade and the tail probability by which documents are selected.

The model is fitted on a bounded sample of labelled documents; their features are made on
the executors.  Scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pinfold.runtime import arrow_map, materialise

#: Labelled documents the model is fitted on at most.
MOST_LABELLED = 12288
#: A feature needs so many labelled documents, and an association with lower grades of so
#: many standard deviations, to get a weight.  Rounds and shrinkage of the fit.
LEAST_DOCS, LEAST_Z, ROUNDS, SHRINK = 3, 4.0, 100, 1e-5
#: Bytes of the word beginnings that are features beside the words.
PREFIXES = (3, 4, 5, 6)
#: Grades from the two ratings: 0 poor, 1 toxic, 2 good; documents need this chance of it.
TOP, KEEP = 2, 0.7


def _bins(text: bytes, words: list[bytes]) -> list[bytes]:
    """Shape of a text in coarse bins."""
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n, w = max(1, len(text)), max(1, len(words))
    marks = sum(int(count[c]) for c in b"!#$%&*|@^~<>{}[]\\=_/+")
    parts = {
        b"upper": count[65:91].sum() / max(1, count[65:91].sum() + count[97:123].sum()),
        b"digit": count[48:58].sum() / n,
        b"mark": marks / w,
        b"line": count[10] / w,
        b"repeat": sum(a == b for a, b in zip(words, words[1:])) / w,
        b"distinct": len(set(words)) / w,
        b"length": min(1.0, len(b"".join(words)) / w / 16),
    }
    out = [b"\x01%s:%d" % (name, min(9, int(10 * float(v)))) for name, v in parts.items()]
    return [*out, b"\x01words:%d" % len(words).bit_length()]


def features(text: bytes | None) -> np.ndarray:
    """Hashed features of a whole text; null counts as empty."""
    raw = text or b""
    words = raw.lower().split()
    distinct = set(words)
    found = distinct.union(_bins(raw, words))
    for k in PREFIXES:
        found.update([b"\x02%d%b" % (k, w[:k]) for w in distinct if len(w) > k])
    return np.fromiter(map(zlib.crc32, found), np.uint32, len(found))


@dataclass
class Ordinal:
    """Shared weights of the known features, and rising thresholds: a cumulative-link model."""

    known: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def places(self, ids: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, ids)
        at[at == len(self.known)] = 0
        return at[self.known[at] == ids] if len(self.known) else at[:0]

    def score(self, ids: np.ndarray) -> float:
        return float(self.weights[np.sort(self.places(ids))].sum())

    def tails(self, score: np.ndarray) -> np.ndarray:
        """``P(grade >= k)`` for k = 1, ...: (rows, grades - 1)."""
        return _logistic(score[:, None] - self.cuts[None, :])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _associated(rows: list[np.ndarray], grades: np.ndarray, n_grades: int) -> np.ndarray:
    """Features whose presence speaks against some grade's being reached.

    Words that are merely common in good texts are left out: a long text holds many of
    them, and their sum would outweigh any evidence against it.
    """
    known, df = np.unique(np.concatenate(rows), return_counts=True)
    known, df = known[df >= LEAST_DOCS], df[df >= LEAST_DOCS].astype(np.float64)
    table, n = Ordinal(known, np.zeros(0), np.zeros(0)), len(rows)
    by_grade = np.zeros((n_grades, len(known)))
    for row, g in zip(rows, grades):
        by_grade[g, table.places(row)] += 1
    z = np.zeros(len(known))
    for k in range(1, n_grades):
        p = (grades >= k).mean()
        spread = np.sqrt(np.maximum(1e-9, df * p * (1 - p) * (n - df) / max(1, n - 1)))
        z = np.maximum(z, (df * p - by_grade[k:].sum(0)) / spread)
    return known[z >= LEAST_Z]


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, rounds: int = ROUNDS) -> Ordinal:
    """Penalised maximum likelihood by L-BFGS; grades weigh by the root of their rarity."""
    model = Ordinal(_associated(rows, grades, n_grades), np.zeros(0), np.zeros(n_grades - 1))
    placed = [model.places(r) for r in rows]
    flat, owner = np.concatenate(placed), np.repeat(np.arange(len(rows)), [len(r) for r in placed])
    width, each = len(model.known), np.arange(len(rows))
    count = np.bincount(grades, minlength=n_grades)
    weigh = np.sqrt(len(grades) / (n_grades * np.maximum(count, 1)))[grades]
    weigh /= weigh.sum()

    def cuts_of(z: np.ndarray) -> np.ndarray:
        return z[width] + np.concatenate([[0], np.cumsum(np.exp(z[width + 1 :]))])

    def loss(z: np.ndarray) -> tuple[float, np.ndarray]:
        cuts = cuts_of(z)
        score = np.bincount(owner, weights=z[flat], minlength=len(rows))
        below = np.concatenate([np.zeros((len(rows), 1)), _logistic(cuts[None, :] - score[:, None]), np.ones((len(rows), 1))], axis=1)
        hi, lo = below[each, grades + 1], below[each, grades]
        p = np.maximum(hi - lo, 1e-12)
        by_weight = SHRINK * z[:width] - np.bincount(flat, weights=(weigh * (hi + lo - 1))[owner], minlength=width)
        by_cut = np.zeros(n_grades - 1)
        np.add.at(by_cut, np.minimum(grades, n_grades - 2), np.where(grades < n_grades - 1, weigh * hi * (1 - hi) / p, 0))
        np.add.at(by_cut, np.maximum(grades - 1, 0), np.where(grades > 0, -weigh * lo * (1 - lo) / p, 0))
        later = by_cut[::-1].cumsum()[::-1]
        gradient = np.concatenate([by_weight, [-later[0]], -later[1:] * np.exp(z[width + 1 :])])
        return -(weigh * np.log(p)).sum() + SHRINK / 2 * z[:width] @ z[:width], gradient

    share = np.cumsum(count + 1)[:-1] / (len(grades) + n_grades)
    start = np.log(share / (1 - share))
    z = _lbfgs(loss, np.concatenate([np.zeros(width), start[:1], np.log(np.maximum(np.diff(start), 0.1))]), rounds)
    return Ordinal(model.known, z[:width], cuts_of(z))


def _lbfgs(loss, z: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    value, gradient = loss(z)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, kept = gradient.copy(), []
        for s, y in reversed(steps):
            a = (s @ q) / (y @ s)
            kept.append(a)
            q -= a * y
        q *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1e-12, np.linalg.norm(gradient))
        for (s, y), a in zip(steps, reversed(kept)):
            q += (a - (y @ q) / (y @ s)) * s
        size, slope = 1.0, gradient @ q
        while size > 1e-8:
            there, (found, at) = z - size * q, loss(z - size * q)
            if found <= value - 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = there - z, at - gradient
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-memory:]
        settled = abs(value - found) < 1e-6 * max(1.0, abs(value))
        z, value, gradient = there, found, at
        if settled:
            break
    return z


def graded(labels: DataFrame) -> DataFrame:
    """``doc_id, grade`` from ``labels(doc_id, quality, toxic)``; the worst rating counts.

    A null rating says nothing: a row has a grade where the other rating decides it alone,
    else it is left out, as are rows without an id.
    """
    grade = F.when(F.col("quality") < 1, 0).when(F.col("toxic") > 0, 1).when((F.col("quality") >= 1) & (F.col("toxic") <= 0), TOP)
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = pa.array([np.sort(features(t.as_py())).tobytes() for t in batch.column(2)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made], ["doc_id", "grade", "x"])


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Ordinal:
    """The model from the ``MOST_LABELLED`` labelled documents that come first by a hash of
    their id.  With fewer than two grades every document gets the top grade."""
    sample = graded(labels).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(MOST_LABELLED)
    # the sample has MOST_LABELLED rows of two numbers at most
    sample = F.broadcast(materialise(sample, "quality-sample"))
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    picked = picked.join(sample, "doc_id").select("doc_id", "grade", "t")
    # ids that repeat could exceed the bound, so it is applied again
    rows = picked.transform(arrow_map, _learned, "doc_id long, grade int, x binary").orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id", "x").limit(MOST_LABELLED).collect()
    grades = np.array([r.grade for r in rows], np.int64)
    if len(set(grades.tolist())) < 2:
        return Ordinal(np.zeros(0, np.uint32), np.zeros(0), np.full(TOP, -60.0))
    return fit_ordinal([np.frombuffer(r.x, np.uint32) for r in rows], grades, TOP + 1)


def score_quality(docs: DataFrame, model: Ordinal, text_col: str = "text", keep: float | None = None) -> DataFrame:
    """``docs`` plus ``expected_grade`` and ``tail_probability`` (of the top grade).

    With ``keep`` only rows of at least that tail probability are returned.  Null texts are
    scored as empty ones; repeated rows alike; an empty table gives an empty result.  Columns
    of the same names are replaced, all others kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ours = ["expected_grade", "tail_probability"]
    docs = docs.drop(*ours)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted: Ordinal = shared.value
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            score = np.array([fitted.score(features(t.as_py())) for t in texts])
            tails = fitted.tails(score)
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(tails.sum(1), pa.float64()), pa.array(tails[:, -1], pa.float64())], [*batch.schema.names, *ours])
            yield out if keep is None else out.filter(pa.array(tails[:, -1] >= keep))

    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.DoubleType()) for c in ours]])
    return docs.transform(arrow_map, run, schema)


def select_quality(docs: DataFrame, labels: DataFrame, keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose chance of the top grade is at least ``keep``, scored."""
    return score_quality(docs, fit_quality(docs, labels, id_col, text_col), text_col, keep)
