import numpy as np

from pinfold.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int, dim string, kept int"


def vectors(n=600, d=24, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for k in range(n // 2, n):
        x[k] = x[rng.integers(0, 40)] * rng.uniform(0.5, 3) + rng.normal(size=d) * rng.uniform(0, 0.25)
    return x.astype(np.float32), rng.integers(0, 3, n)


def brute(rows, threshold=0.93):
    usable = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and len(v) and None not in v:
            a = np.array(v, float)
            if np.isfinite(a).all() and (a != 0).any():
                usable.setdefault((label, len(a)), []).append((i, a / np.linalg.norm(a)))
    links, parent = {}, {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for group in usable.values():
        for k, (i, a) in enumerate(group):
            for j, b in group[:k]:
                if a @ b >= threshold:
                    links[i] = links.get(i, 0) + 1
                    links[j] = links.get(j, 0) + 1
                    p, q = find(i), find(j)
                    parent[max(p, q)] = min(p, q)
    return links, find


def check(spark, rows, least=1.0, **options):
    df = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], SCHEMA).repartition(4)
    got = E.embedding_near_dedup(df, **options).collect()
    links, find = brute(rows)
    assert len(got) == len(rows)
    found, real = sum(r.n_links for r in got), sum(links.values())
    assert all(r.n_links <= links.get(r.vec_id, 0) for r in got) and found >= least * real and real > 100
    if found == real:
        for r in got:
            assert r.component_id == (None if r.vec_id is None else find(r.vec_id)) and r.kept == (r.vec_id is not None and r.vec_id == r.component_id)
    return found / real


def test_all_links_against_brute_force(spark):
    x, labels = vectors()
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, labels))]
    odd = [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [float("inf")] * 24, [None] + [1.0] * 23, [1.0] * 7, [1e30] * 24, [1e-30] * 24]
    rows += [(1000 + k, v, 0) for k, v in enumerate(odd)] + [(2000, x[0].tolist(), None), (None, x[0].tolist(), 0)]
    check(spark, rows)


def test_equal_vectors_count_and_repeat(spark):
    x, labels = vectors(300)
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, labels))]
    rows += [(10_000 + k, x[0].tolist(), int(labels[0])) for k in range(30)]
    check(spark, rows)


def test_recall_with_many_lists_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(E, "PER_LIST", 12)
    monkeypatch.setattr(E, "BLOCK", 16)
    monkeypatch.setattr(E, "STEP", 5)
    x, labels = vectors(1200, seed=5)
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, labels))]
    assert check(spark, rows, 0.9) >= 0.9
    # every list probed: blocks and steps lose nothing
    assert check(spark, rows, 1.0, probes=10_000) == 1.0


def test_distance_tables_match_decoded_vectors():
    x, _ = vectors(200, 16)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    index = E.fit_index(x.astype(float), 4, subspaces=4, centroids=8)
    codes = index.code(x.astype(float))
    t = index.tables(x[:5].astype(float))
    looked = sum(t[:, s, :][:, codes[:, s]] for s in range(4))
    assert np.allclose(looked, ((x[:5, None] - index.decode(codes)[None]) ** 2).sum(2))


def test_empty_table(spark):
    assert E.embedding_near_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rare_lengths_are_compared_whole_and_pad_nothing(spark):
    x, labels = vectors(n=400)
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, labels))]
    for d in (3, 9, 40):
        base = rng.normal(size=(4, d))
        rows += [(1000 * d + k, (base[k % 4] + rng.normal(size=d) * 0.1).tolist(), k % 2) for k in range(40)]
    rows += [(90_000, rng.normal(size=300_000).tolist(), 0), (90_001, [2.0] * 300_000, 1)]
    check(spark, rows)
