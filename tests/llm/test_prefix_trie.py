import hashlib
import random
import re
import zlib

import pytest

from pinfold.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, part int, key string, n int, id string"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def rebuilt(rows):
    own = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv_id, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(c / 20) * 20
        out[c] = own.get(c - base, [])[:h] + turns[h:]
    return out


def slow(rows):
    """(conv_id, depth, parent, n, children, leaves, saved, ends) of every node."""
    convs = rebuilt(rows)
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids, leaves, saved = {}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        if node:
            kids[node[:-1]] = kids.get(node[:-1], 0) + 1
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in kids
            saved[node[:d]] += (len(who) - 1) * (words(node[-1][1]) if node else 0)
    out = []
    for node, who in members.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), kids.get(node, 0), leaves[node], saved[node], digest))
    return out


def conversations(seed, n=160, most=7, longest=0):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        c = c * 3 if c % 2 else c
        pool = [(rng.choice(["user", "assistant", None]), rng.choice(["", "one", "one  two\tthree", None, "é ü"])) for _ in range(3)]
        for t in range(rng.randint(1, most)):
            role, text = pool[rng.randrange(3)] if rng.random() < 0.4 else ("user", "hello there")
            rows.append((c, t, role, text))
    for c in range(longest):
        rows += [(5000 + c, t, "user", f"turn {t if t < 150 - c else (c, t)}") for t in range(200)]
    return rows


def compare(spark, rows, parts=4):
    df = spark.createDataFrame([(*r, 1, "k", 2, "i") for r in rows], SCHEMA).repartition(parts)
    got = [tuple(r) for r in P.prefix_trie(df).collect()]
    key = lambda r: tuple((x is not None, x) if x is not None else (False, 0) for x in r)
    assert sorted(got, key=key) == sorted(slow(rows), key=key)


@pytest.fixture
def many_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_against_brute_force_in_one_range(spark):
    compare(spark, conversations(1))


def test_against_brute_force_in_many_ranges(spark, many_ranges):
    compare(spark, conversations(2, longest=12))


def test_nulls_ties_repeats_and_missing_families(spark):
    rows = [(None, 0, "user", "nobody"), (7, None, "user", "first"), (7, 0, None, None), (7, 0, "user", "b"), (7, 0, "user", "a"), (7, 0, "user", "a")]
    rows += [(21, 0, "user", "of a family without its head"), (-3, 0, "user", "x"), (-3, 1, "user", "y " * 50_000), (-25, 2, "", "x"), (-20, 0, "user", "z"), (2**61, 0, "u", "t")]
    rows += [(c, t, "user", f"same {t}") for c in range(40, 60) for t in range(2)]
    compare(spark, rows)


def test_one_conversation_and_empty_table(spark):
    compare(spark, [(3, 0, "user", "alone")])
    assert P.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_lists_of_ends_are_hashed_in_stretches(spark):
    ids = [5, *range(-9000, 9000, 3), 10**12]
    df = spark.createDataFrame([(f"n{i % 2}", i) for i in ids], "id string, conv_id long").repartition(5)
    got = {r.id: r.ends_sha256 for r in P.end_hashes(df).collect()}
    assert got == {f"n{k}": hashlib.sha256(",".join(str(i) for i in sorted(ids) if i % 2 == k).encode()).hexdigest() for k in (0, 1)}


def turn(letter):
    return hashlib.sha256(letter.encode()).digest()[: P.TURN]


@pytest.mark.parametrize("seed", range(30))
def test_ranges_agree_on_the_points_they_share(seed):
    """Random sequences cut into random ranges: the parts of all points add up."""
    rng = random.Random(seed)
    texts = {"".join(rng.choice("aab") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 60))}
    texts |= {("a" * 30)[: rng.randint(20, 30)] + rng.choice("abc") for _ in range(rng.randint(0, 6))}
    size = {c: k + 1 for k, c in enumerate("abc")}
    items = sorted((b"".join(map(turn, t)), rng.randint(1, 3), k, [size[c] for c in t], t) for k, t in enumerate(texts))
    cuts = sorted({0, *(rng.randrange(len(items)) for _ in range(rng.randint(0, 9)))})
    ranges = [items[a:b] for a, b in zip(cuts, [*cuts[1:], len(items)])]
    batch = P._rows("part int, key binary", [(k, x[0]) for k, r in enumerate(ranges) for x in r])
    summaries = [row for b in P._summaries(iter([batch])) for row in zip(*(c.to_pylist() for c in b.columns))]
    sums = {}
    for (_, _, before, after, left, right), items_ in zip(P.fold_borders(summaries), ranges):
        trie = P.PatriciaRange(before, after, left, right)
        for key, n, conv_id, w, _ in items_:
            trie.add(key, n, conv_id, w)
        trie.finish()
        for node, parent, depth, n, conv_id, leaves, every, new, upto, suffix in trie.done:
            s = sums.setdefault(node, [(parent, depth, upto, suffix), 0, conv_id, 0, 0, 0])
            assert s[0] == (parent, depth, upto, suffix)
            s[1:] = [s[1] + n, min(s[2], conv_id), s[3] + leaves, s[4] + every, s[5] + new]
    prefixes = {t[:d] for t in texts for d in range(len(t) + 1)}
    kids = {p: sum(q[:-1] == p for q in prefixes if q) for p in prefixes}
    points = {p for p in prefixes if p == "" or p in texts or kids[p] > 1}
    assert {P._hex_id(b"".join(map(turn, p))) for p in points} == set(sums)
    value = lambda p: sum(size[c] for c in p)
    for p in points:
        (_, depth, upto, _), n, conv_id, leaves, every, new = sums[P._hex_id(b"".join(map(turn, p)))]
        under = [x for x in items if x[4].startswith(p)]
        assert (depth, upto, n, conv_id) == (len(p), value(p), sum(x[1] for x in under), min(x[2] for x in under))
        assert leaves == sum(kids[q] == 0 for q in prefixes if q.startswith(p))
        assert every == sum(x[1] * value(x[4]) for x in under)
        assert new == sum(size[q[-1]] for q in prefixes if q.startswith(p) and q != p)
