import random

import corpus_pipeline as P

from pinfold.llm import near_copies as N

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edited_texts(rng, n=25):
    out = []
    for i in range(n):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(60, 200))]
        out.append(" ".join(words))
        for edits in (1, 2, 5):
            copy = list(words)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = "changed"
            out.append(" ".join(copy))
    return out + ["", None, "too short", "Too  short", "x " * 30_000]


def brute(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    group = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if not union or len(sets[i] & sets[j]) / union >= 0.8:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return group


def test_groups_against_brute_force(spark):
    texts = edited_texts(random.Random(3))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    want = dict(enumerate(brute(texts)))
    for settings in ({}, {"shard_limit": 2, "block_chars": 700}):
        assert {r.doc_id: r.component_id for r in N.jaccard_near_dedup(df, **settings).collect()} == want


def test_stage_drops_edited_copies_and_keeps_looser_ones(spark):
    words = [f"w{k * k % 9973}" for k in range(150)]
    edited = [*words[:70], "other", *words[71:]]
    loose = [w if k % 30 else "other" for k, w in enumerate(words)]
    rows = [(i, " ".join(t), "en", "s", 9) for i, t in enumerate([words, edited, loose])] + [(None, " ".join(words), "en", "s", 9)]
    kept = P.dedup_stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in kept if r.doc_id is not None) == [(False, 0), (False, 2)]
    assert len(kept) == 3
