import hashlib
import random

import pytest

from pinfold.llm import exact_dedup as E

SCHEMA = "doc_id long, text string, n int, content string, path int, class_id string"


def slow(rows):
    """(doc_id, keep_id, size, sha) of every row, and how many rows each group keeps."""
    fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(fold(text), []).append(doc_id)
    out = []
    for doc_id, text in rows:
        ids = groups[fold(text)]
        known = [i for i in ids if i is not None]
        out.append((doc_id, max(known) if known else None, len(ids), hashlib.sha256(fold(text).encode()).hexdigest()))
    return out, len(groups)


def table(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, 1, "x", 2, "y") for i, t in rows], SCHEMA).repartition(parts)


def compare(spark, rows, **options):
    got = E.exact_dedup(table(spark, rows), **options).collect()
    want, groups = slow(rows)
    order = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=order) == sorted(want, key=order)
    kept = [r for r in got if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept)
    assert len(kept) == groups == len({r.text_sha256 for r in kept})


def rows(seed=3):
    rng = random.Random(seed)
    base = ["".join(rng.choice("aAbÉß \n") for _ in range(rng.randint(0, 9))) for _ in range(300)]
    out = [(i, t) for i, t in enumerate(base)] + [(1000 + i, t.swapcase() if t.isascii() else t) for i, t in enumerate(base[:120])]
    out += [(2000 + i, "The SAME text") for i in range(200)] + [(None, "the same text"), (None, "nobody"), (None, "Nobody"), (None, None)]
    return [*out, (7000, None), (7001, ""), (7001, ""), (7002, "word " * 50_000), (7003, "WORD " * 50_000), (7003, "É"), (7004, "é")]


@pytest.mark.parametrize("options", [{}, {"table_bytes": 300, "window_bytes": 200}, {"table_bytes": 40, "window_rows": 3}])
def test_against_brute_force_at_any_size_of_tables(spark, options):
    compare(spark, rows(), **options)


def test_equal_keys_do_not_make_equal_contents():
    table = E.ContentTable()
    contents = [str(i).encode() for i in range(500)]
    assert [table.find(7, c) for c in contents] == list(range(500))
    assert [table.find(7, c) for c in contents] == list(range(500))
    assert table.bytes == sum(map(len, contents))


def test_full_buckets_are_spilled_and_dealt_again(spark, monkeypatch):
    spilled = []
    real = E.materialise
    monkeypatch.setattr(E, "materialise", lambda df, label: spilled.append(label) or real(df, label))
    many = [(i, f"text {i % 400}") for i in range(1200)]
    compare(spark, many, table_bytes=60)
    assert "dedup-spill" in spilled
    spilled.clear()
    # digests that agree in their first 22 bits are dealt again and again
    spill = spark.createDataFrame([(i, i, True, bytes([0] * 31 + [i % 250]), (i % 250) << 34, 8, 1, i, f"text {i % 250:3}".encode()) for i in range(500)], E.SPILL)
    got = E.content_classes(spill, 60).collect()
    assert sorted((r.class_id, r.keep_id, r.group_size) for r in got) == [(i, i % 250 + 250, 2) for i in range(500)]
    assert spilled.count("dedup-spill") >= 4
    # copies of one text fill no table, however many there are
    spilled.clear()
    compare(spark, [(i, "one text of some length") for i in range(900)], table_bytes=60, window_rows=10)
    assert "dedup-spill" not in spilled


def test_empty_table_and_schema(spark):
    got = E.exact_dedup(table(spark, []).limit(0))
    assert got.count() == 0
    assert got.dtypes == [("doc_id", "bigint"), ("keep_id", "bigint"), ("group_size", "bigint"), ("kept", "boolean"), ("text_sha256", "string")]
