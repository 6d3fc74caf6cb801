import random

import xxhash

from pinfold.llm import simhash as S

SCHEMA = "doc_id long, text string, fp string, rep int, component_id int"


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(values, radius=2):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def texts():
    rng = random.Random(4)
    base = [" ".join(rng.choice("alpha Beta gamma été ß delta".split()) + str(rng.randint(0, 60)) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    out = list(base)
    for t in base[:30]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    return [*out, *base[:10], None, "", "  \n\t\x0b", "A b", "a  B", "x", "word " * 60_000]


def test_fingerprints_and_components_against_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, "z", 1, 2) for i, t in enumerate(rows)], SCHEMA).repartition(5)
    got = {r.doc_id: r for r in S.simhash_near_dedup(df).collect()}
    prints = [slow_fingerprint(t) for t in rows]
    assert [got[i].fingerprint for i in range(len(rows))] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in range(len(rows))] == slow_components(prints)


def planted(n=3000, seed=1):
    """Fingerprints with dense clusters, so that shards are dealt again."""
    rng = random.Random(seed)
    values = [rng.getrandbits(64) for _ in range(n // 3)]
    for centre in values[:3]:
        for _ in range(n // 6):
            values.append(centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (rng.random() < 0.3) * (1 << rng.randrange(64)))
    return sorted(set(values))


def test_no_link_is_lost_when_shards_are_split(spark):
    values = planted()
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    classes = spark.createDataFrame(list(zip(signed, range(len(values)))), "fp long, rep long")
    from pinfold.operators.components import connected_components

    want = slow_components(values)
    for limit in (8, 1024):
        links = S.hamming_links(classes, 2, shard_limit=limit)
        got = {r.node: r.component for r in connected_components(links).collect()}
        assert [got.get(i, i) for i in range(len(values))] == want
    pairs = S.hamming_links(classes, 2, shard_limit=8).collect()
    assert all((values[p.src] ^ values[p.dst]).bit_count() <= 200 for p in pairs)


def test_tree_finds_all_within_the_radius():
    rng = random.Random(9)
    values = [rng.getrandbits(10) for _ in range(400)]
    tree = S.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:50]:
        assert sorted(tree.within(q, 2)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= 2]


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "only here now", "", 0, 0), (None, "shared text x", "", 0, 0), (7, "shared text x", "", 0, 0), (7, "shared text x", "", 0, 0)], SCHEMA)
    got = sorted((r.doc_id is None, r.component_id) for r in S.simhash_near_dedup(df).collect() if r.component_id)
    assert got == [(False, 7), (False, 7), (True, 7)]
    assert S.simhash_near_dedup(df).count() == 4 and S.simhash_near_dedup(df.limit(0)).count() == 0
