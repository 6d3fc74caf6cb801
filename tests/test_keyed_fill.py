import random

import pytest

from pinfold.streaming import keyed_fill as K


@pytest.fixture
def keyed_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, K.STORE)
    yield
    spark.conf.set(key, old)


def slow(directory, batches, radius):
    known, gaps = [(r, a, o) for _, r, a, o in directory], []
    for batch in batches:
        for i, r, a, o in sorted(batch):
            if not any(r == s and K.metres(a, o, c, d) <= radius for s, c, d in known):
                gaps.append(i)
            known.append((r, a, o))
    return sorted(gaps)


def test_a_restarted_query_tells_no_gap_twice(spark, tmp_path, keyed_store):
    rng = random.Random(4)
    pin = lambda i: (i, rng.randrange(2), 40 + rng.random() * 0.03, -75 + rng.random() * 0.03)
    directory, batches = [pin(i) for i in range(25)], [[pin(100 * b + i) for i in range(40)] for b in (1, 2, 3)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    held = spark.createDataFrame(directory, K.PIN)
    for batch in batches:
        spark.createDataFrame(batch, K.PIN).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(K.PIN).parquet(source)
        query = K.keyed_gap_fill(stream, held, 300.0).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = sorted(r.row_id for r in spark.read.parquet(out).collect())
    assert got == slow(directory, batches, 300.0) and 20 < len(got) < 120
