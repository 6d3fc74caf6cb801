import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from pinfold.functions import matching as X
from pinfold.functions import text as T
from pinfold.operators import name_pairs as N


@pytest.mark.parametrize("alphabet,longest", [("ab", 30), ("abcd", 60), ("the quick brown", 260), ("abcdefghijklmnopqrstuvwxyz0123456789 éß", 420), ("ab", 230)])
def test_ratio_is_that_of_the_standard_library(alphabet, longest):
    rng = random.Random(len(alphabet) + longest)
    for _ in range(400):
        a = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest)))
        b = list(a) if rng.random() < 0.5 else [rng.choice(alphabet) for _ in range(rng.randint(0, longest))]
        for _ in range(rng.randint(0, 6)):
            if b:
                b[rng.randrange(len(b))] = rng.choice(["", rng.choice(alphabet), rng.choice(alphabet) * 2])
        b = "".join(b)
        assert X.ratio(a, b) == SequenceMatcher(None, a, b).ratio(), (a, b)


NAMES = ["The First Baptist Church, Inc.", "the", "The Inc", "St. Mary's Co LLC", "A_b  c\td", "2nd Mt Zion Ltd. co", "", None, "Église Saint-Éloi", "ﬁrst ½ Church", "église", "Inc Grace Corp", "THE THE inc", "x\x1cy", " wide space "]


def test_normal_names_without_python_where_they_are_plain(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    got = {r.name: r.normal for r in N.with_normal(df, "name", "normal").collect()}
    assert got == {n: T.normal_name(n) for n in NAMES}


def pairs():
    rng = random.Random(5)
    base = ["grace bible fellowship", "saint john lutheran", "mount zion", "hope", "first presbyterian of the valley", "Église Saint Éloi", "", "The Inc"]
    out = []
    for i in range(600):
        a = rng.choice(base)
        b = list(rng.choice([a, a, rng.choice(base)]))
        for _ in range(rng.randint(0, 3)):
            if b:
                b[rng.randrange(len(b))] = rng.choice(["", "x", "q ", "é"])
        out.append((i, a, "".join(b)))
    return [*out, (900, None, "x"), (901, None, None)]


def slow_similar(a, b):
    x, y = T.normal_name(a), T.normal_name(b)
    if not x or not y:
        return False
    s, t = set(x.split()), set(y.split())
    return x == y or len(s & t) / len(s | t) >= 0.85 or SequenceMatcher(None, x, y).ratio() >= 0.92


def test_similar_pairs_and_how_few_need_the_matcher(spark):
    rows = pairs()
    df = spark.createDataFrame(rows, "id long, a string, b string").repartition(3)
    got = {r.id: r.similar for r in N.with_similar(df, "a", "b").collect()}
    assert got == {i: slow_similar(a, b) for i, a, b in rows}
    assert 50 < sum(got.values()) < len(rows)
    # the bounds reject most pairs of different names before any Python
    told = N.with_verdict(N.with_normal(N.with_normal(df, "a", "x"), "b", "y"), "x", "y")
    left = {r.id for r in told.where(F.col("verdict").isNull()).collect()}
    assert len(left) < 0.5 * len(rows)
