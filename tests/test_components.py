import random

from pinfold.operators import components as K


def slow(pairs):
    return K._roots([(a, b) for a, b in pairs if a is not None and b is not None and a != b])


def rounds(monkeypatch):
    labels = []
    real = K.materialise
    monkeypatch.setattr(K, "materialise", lambda df, label: labels.append(label) or real(df, label))
    return labels


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long").repartition(8)


def found(df):
    return {r.node: r.component for r in df.collect()}


def graph(seed, n=1500):
    rng = random.Random(seed)
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(n // 2)] + [(5000 + i, 5001 + i) for i in range(300)] + [(7000, 7001 + i) for i in range(200)]
    return [*pairs, (3, 3), (None, 4), (9, None), *pairs[:50]]


def test_roots_are_the_smallest_nodes():
    assert K._roots([(5, 3), (9, 5), (1, 2), (2, 9)]) == {1: 1, 2: 1, 3: 1, 5: 1, 9: 1}
    assert K._roots([]) == {}


def test_contraction_changes_no_component(spark, monkeypatch):
    pairs = graph(1)
    monkeypatch.setattr(K, "FOREST_EDGES", 100)
    for contract in (False, True):
        assert found(K.connected_components(edges(spark, pairs), contract=contract)) == slow(pairs)
    assert K.contracted(spark.createDataFrame([(2, 1), (3, 2), (3, 1)], "u long, v long").coalesce(1), 2).count() <= 3
    assert K.connected_components(edges(spark, []), contract=True).count() == 0


def test_a_long_chain_takes_half_the_rounds(spark, monkeypatch):
    labels = rounds(monkeypatch)
    chain = spark.range(0, 40_000).selectExpr("id AS src", "id + 1 AS dst").repartition(8)
    took = []
    for contract in (False, True):
        labels.clear()
        out = K.connected_components(chain, contract=contract)
        assert out.count() == 40_001 and out.where("component <> 0").count() == 0
        took.append(labels.count("cc-round"))
    assert 2 * took[1] <= took[0]


def test_merging_is_connecting_all_at_once(spark):
    pairs = [p for p in graph(2) if None not in p]
    random.Random(3).shuffle(pairs)
    forest = K.connected_components(edges(spark, pairs[:400]), contract=True)
    for part in (pairs[400:700], pairs[700:701], [], pairs[701:]):
        forest = K.materialise(K.merge_components(forest, edges(spark, part)), "test-forest")
    assert found(forest) == slow(pairs) and forest.count() == len(slow(pairs))
