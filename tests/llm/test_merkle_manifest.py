import hashlib
import zlib

import pytest

from pinfold.llm import merkle_manifest as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, pos int, leaf int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    written = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return digest(*map(written, (row[0], row[3], row[2], row[4], text)))


def climb(hashes):
    """The levels of one tree, the leaves first."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        at = levels[-1]
        levels.append([digest(*at[k : k + 8]) for k in range(0, len(at), 8)])
    return levels


def slow(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of every row."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[g] = climb([leaf(r, r[1]) for r in groups[g]])
    upper = climb([trees[g][-1][0] for g in names])
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            changed = r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            made, beside = leaf(r, lower(r[1]) if changed else r[1]), []
            for levels, at in ((trees[g], i), (upper, k)):
                for hashes in levels[:-1]:
                    run = hashes[at - at % 8 : at - at % 8 + 8]
                    beside += run[: at % 8] + run[at % 8 + 1 :]
                    run[at % 8] = made
                    made, at = digest(*run), at // 8
            root = upper[-1][0]
            out.append((r[0], trees[g][0][i], trees[g][-1][0], root, digest(*beside), made, made == root))
    return out


def compare(spark, rows, parts=5):
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA).repartition(parts)
    got = [tuple(r) for r in M.merkle_manifest(df).collect()]
    key = lambda r: tuple((x is not None, x) if x is not None else (False, 0) for x in r)
    assert sorted(got, key=key) == sorted(slow(rows), key=key)


def row(i, lang, text="Some Text"):
    return (i, text, lang, f"src{i % 3}" if i else None, i)


def test_groups_of_all_heights(spark):
    rows = []
    for lang, n in (("aa", 1), ("bb", 7), ("cc", 8), ("dd", 9), ("ee", 64), ("ff", 65), ("gg", 600), ("é", 3), (None, 12), ("", 2), ("Zz", 1)):
        rows += [row(len(rows) * 5 + k, lang, f"Text {k} Ünï") for k in range(n)]
    compare(spark, rows)


@pytest.mark.parametrize("lang", ["en", None])
def test_one_group_and_one_row(spark, lang):
    compare(spark, [row(4, lang)])
    compare(spark, [row(i, lang, "abc") for i in range(9)])


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [row(3, "en"), row(3, "en"), row(3, "en", "Other"), (None, "No Id", "en", None, None), (None, None, "en", None, None), (3, None, None, None, None), (9, "", "en", "", 0)]
    compare(spark, [*rows, row(12, "de", "Long Word " * 100_000), row(-5, "de"), row(2**62, "de")])


def test_many_groups(spark):
    compare(spark, [row(i, f"l{i % 70}") for i in range(150)])


def test_empty_table(spark):
    assert M.merkle_manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_slots_are_excised_and_spliced(spark):
    h = [digest(str(k)) for k in range(3)]
    df = spark.createDataFrame([([("".join(h), 1), ("".join(h[:2]), 0)], "x" * 64)], "path array<struct<pre:string,slot:int>>, leaf string")
    got = df.select(M.siblings(df.path), M.folded(df.path, df.leaf)).first()
    assert got[0] == h[0] + h[2] + h[1]
    assert got[1] == digest(digest(h[0], "x" * 64, h[2]), h[1])
