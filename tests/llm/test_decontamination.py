import random

from pinfold.llm import decontamination as D

SCHEMA = "doc_id long, text string, item_id int, coverage int"


def brute(p, t, least):
    """Greedy string tiling by trying every pair of positions again and again."""
    p_free, t_free, tiles = [True] * len(p), [x is not None for x in t], []
    while True:
        best = None
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p_free[i + k] and t_free[j + k] and p[i + k] == t[j + k]:
                    k += 1
                if k >= least and (best is None or (-k, i, j) < best):
                    best = (-k, i, j)
        if best is None:
            return tiles
        k, i, j = -best[0], best[1], best[2]
        tiles.append((i, j, k))
        p_free[i : i + k] = t_free[j : j + k] = [False] * k


def test_tiling_against_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        words = "abcd"[: rng.randint(2, 4)]
        p = [rng.choice(words) for _ in range(rng.randint(1, 40))]
        t = [rng.choice([*words, None]) for _ in range(rng.randint(1, 60))] + p[5:20] + p[:9]
        assert sorted(D.greedy_tiles(p, t, 3)) == sorted(brute(p, t, 3))
    long = [str(rng.random()) for _ in range(300)]
    assert D.greedy_tiles(long, long[150:] + [None] + long[:150], 5) == [(0, 151, 150), (150, 0, 150)]


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, doc_id int")


def test_reordered_and_partial_passages(spark):
    words = [f"w{i}" for i in range(40)]
    noisy = " ".join(f"{w.upper()}!!" for w in words[20:]) + " x y z " + " ".join(words[:20])
    docs = [
        (1, noisy), (2, " ".join(words[:12])), (9, "x " + " ".join(words[20:33])), (3, "a b c d e " * 50), (4, None), (5, ""), (6, "q " * 100_000 + " ".join(words)),
        (6, "q " * 100_000 + " ".join(words)), (None, " ".join(words)), (8, " ".join(words[::-1])),
    ]
    bench = items(spark, [(7, " ".join(words), 1), (8, None, 1), (9, "too short", 1), (10, "", 1)])
    df = spark.createDataFrame([(*d, 0, 0) for d in docs], SCHEMA)
    got = sorted(D.leaked_items(df, bench).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [(r.doc_id, r.item_id, r.coverage, r.n_tiles) for r in got] == [(1, 7, 1.0, 2), (6, 7, 1.0, 1), (6, 7, 1.0, 1), (9, 7, 13 / 40, 1), (None, 7, 1.0, 1)]
    left = D.drop_leaking(df, bench)
    assert sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 5, 8] and left.columns == df.columns


def test_blocks_of_items_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_CHARS", 50)
    texts = [" ".join(f"i{k}w{j}" for j in range(8)) for k in range(7)]
    df = spark.createDataFrame([(k, t, 0, 0) for k, t in enumerate(texts)] + [(99, " ".join(texts), 0, 0)], SCHEMA)
    bench = items(spark, [(k, t, 0) for k, t in enumerate(texts)])
    got = sorted((r.doc_id, r.item_id) for r in D.leaked_items(df, bench).collect())
    assert got == [(k, k) for k in range(7)] + [(99, k) for k in range(7)]
    assert D.drop_leaking(df, bench).count() == 0
    assert D.leaked_items(df.limit(0), bench).count() == 0 and D.leaked_items(df, bench.limit(0)).count() == 0
    assert D.drop_leaking(df, bench.limit(0)).count() == 8
