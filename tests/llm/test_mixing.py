import random
import re

from pinfold.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, size string, rn int"


def rows(n=400, seed=3):
    rng = random.Random(seed)
    sources = ["b", "a", "Z", "é", None, "tiny"]
    out = []
    for i in range(n):
        s = rng.choices(sources, [30, 10, 10, 5, 3, 1])[0]
        out.append((i, None if i % 50 == 0 else "w x  y\n" * rng.randint(0, 40 if s != "tiny" else 2), s))
    return [*out, (7, "dup dup", "a"), (7, "dup dup", "a"), (None, "no id here", "b"), (None, "no id here", "b"), (n, "long " * 100_000, "Z")]


def slow_targets(sizes):
    """Share, cap and share again until no target is above its cap."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(full.values())
        target = {s: left * w[s] / sum(w[f] for f in free) for s in free}
        over = [s for s in free if target[s] > 3 * sizes[s]]
        if not over:
            return {**full, **target}
        full.update({s: 3 * sizes[s] for s in over})


def test_targets_and_takes(spark):
    data = rows()
    df = spark.createDataFrame([(*r, "x", 0) for r in data], SCHEMA).repartition(6)
    got = M.mix_sources(df).collect()
    assert len(got) == len(data)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(r.size for r in got) == sorted(size(t) for _, t, _ in data)
    totals = {}
    for _, t, s in data:
        totals[s] = totals.get(s, 0) + size(t)
    want = slow_targets(totals)
    by = {}
    for r in got:
        s = next(k for k, v in totals.items() if v == r.source_size)
        assert abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        by[s] = by.get(s, 0) + r.taken
    for s, t in want.items():
        assert abs(by[s] - t) <= max(0.03 * t, 3 * max(1, totals[s] // 64))
    assert sorted(map(tuple, got)) == sorted(map(tuple, M.mix_sources(df.repartition(2)).collect())) if None not in [r.doc_id for r in got] else True
    again = M.mix_sources(df.repartition(2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_schedule_keeps_proportions_in_every_prefix(spark):
    df = spark.createDataFrame([(f"d{i} " * 50, "abc"[i % 3], i) for i in range(300)], "text string, source string, doc_id long")
    sizes = df.select(M.word_count(df.text).alias("size"), "source")
    t = M.source_targets(sizes.groupBy("source").sum("size").withColumnRenamed("sum(size)", "source_size"))
    s = t.selectExpr("rn", "source_size div 16 as blocks", "cast(floor(target * 16 / 16) as bigint) as need")
    turns = M.slot_schedule(s).orderBy("slot").collect()
    share = {r.rn: r.target for r in t.collect()}
    whole = sum(share.values())
    for cut in (200, 500, len(turns)):
        for rn, target in share.items():
            held = sum(x.rn == rn for x in turns[:cut])
            assert abs(held - cut * target / whole) < 6
    for rn in share:
        assert [x.turn for x in turns if x.rn == rn] == list(range(sum(x.rn == rn for x in turns)))


def test_empty_tables_and_empty_texts(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert M.mix_sources(df).collect() == []
    df = spark.createDataFrame([(1, "", "a", "", 0), (2, None, None, "", 0)], SCHEMA)
    assert sorted((r.doc_id, r.size, r.taken) for r in M.mix_sources(df).collect()) == [(1, 0, 0), (2, 0, 0)]
