import numpy as np

from pinfold.llm import quality as Q

SCHEMA = "doc_id long, text string, expected_grade string, source string"


def brute(rows, grades, known, w, cuts):
    """Probabilities of the grades, term by term."""
    out = []
    for r in rows:
        score = sum(w[i] for i, k in enumerate(known) if k in set(r.tolist()))
        below = [1 / (1 + np.exp(-(c - score))) for c in cuts]
        out.append(np.diff([0, *below, 1]))
    return np.array(out)


def test_model_probabilities_and_likelihood():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 3, 300)
    rows = [np.unique(np.concatenate([rng.integers(0, 50, 6), [100 + g] * (rng.random() < 0.9)])).astype(np.uint32) for g in grades]
    m = Q.fit_ordinal(rows, grades, 3)
    # only evidence against a grade is kept
    assert m.cuts[0] < m.cuts[1] and {100, 101} <= set(m.known.tolist()) and 102 not in m.known
    tails = m.tails(np.array([m.score(r) for r in rows]))
    p = brute(rows, grades, m.known.tolist(), m.weights, m.cuts)
    assert np.allclose(tails[:, 0], 1 - p[:, 0]) and np.allclose(tails[:, 1], p[:, 2])
    assert ((tails > 0.5).sum(1) == grades).mean() > 0.85


def corpus(spark, n=900):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.integers(0, 400)}" for _ in range(rng.integers(20, 200))]
        kind = i % 5
        if kind == 1:
            words.insert(int(rng.integers(0, len(words))), f"nasty{rng.integers(0, 1000)}")
        if kind == 2:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "x", None))
        labels.append((i, 0 if kind == 2 else 1, 1 if kind == 1 else 0, "t"))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_held_out_selection(spark):
    docs, labels = corpus(spark)
    kept = {r.doc_id for r in Q.select_quality(docs, labels.where("doc_id % 3 <> 0")).collect()}
    held = [i for i in range(900) if i % 3 == 0]
    assert np.mean([(i in kept) == (i % 5 not in (1, 2)) for i in held]) > 0.97


def test_nulls_ties_long_texts_and_empty_tables(spark):
    docs, labels = corpus(spark, 300)
    odd = spark.createDataFrame([(None, None, None, None), (1, "", None, None), (1, "", None, None), (2, "w1 " * 300_000, None, None)], SCHEMA)
    bad = spark.createDataFrame([(None, 1, 0, ""), (1, None, 0, ""), (2, 1, None, ""), (3, 1, 0, ""), (3, 0, 0, "")], "doc_id long, quality int, toxic int, text string")
    assert {(r.doc_id, r.grade) for r in Q.graded(bad).collect()} == {(3, 0)}
    model = Q.fit_quality(docs, labels)
    got = Q.score_quality(docs.union(odd), model)
    assert got.columns == ["doc_id", "text", "source", "expected_grade", "tail_probability"]
    rows = got.collect()
    assert len(rows) == 304 and all(0 <= r.expected_grade <= 2 for r in rows)
    assert len({r.tail_probability for r in rows if not r.text}) == 1
    assert Q.select_quality(docs, labels.limit(0)).count() == 300
    assert Q.select_quality(docs.limit(0), labels).count() == 0
