import corpus_pipeline as P
from pyspark.sql import functions as F

HEX = "1ebc9e654e72c3a9f00b7d6a1b4f812088970e66"


def test_stages_take_effect(spark, tmp_path):
    word = lambda i, j: f"w{(i * 7 + j * j) % 97}x{i % 5}"
    docs = []
    for i in range(300):
        t = " ".join(word(i, j) + ("###" if i % 5 == 1 else "") for j in range(60)) + (" nasty" if i % 5 == 2 else "") + f" tail{i} end{i} stop{i}"
        docs.append((i, t, "en", f"src{i % 4}", len(t)))
    clean = [d for d in docs if d[0] % 5 == 0]
    docs += [(1000 + k, clean[3][1], "en", "src0", 5) for k in range(4)]
    docs += [(2000, clean[4][1] + " " + " ".join(f"q{j}" for j in range(20)), "en", "src1", 9), (2001, clean[5][1] + f' token = "{HEX}"', "en", "src1", 9)]
    docs += [(None, "", "en", None, 0), (2002, None, None, None, None)]
    names = "doc_id long, text string, lang string, source string, n_chars long, taken int"
    spark.createDataFrame([(*d, 1) for d in docs], names).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d[0], 0 if d[0] % 5 == 1 else 1, 1 if d[0] % 5 == 2 else 0) for d in docs[:300]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(f"q{j}" for j in range(20)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf = str(tmp_path)
    table = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES[:-1]:
        table = stage(spark, table, sf)
        assert table.columns == P.COLUMNS
        table = table.cache()
        kept[name] = {r.doc_id: r for r in table.collect()}
    quality = kept["quality classifier"]
    assert sum(i % 5 in (1, 2) for i in quality if i is not None and i < 300) <= 3
    assert sum(i % 5 not in (1, 2) for i in quality if i is not None and i < 300) >= 175
    assert not set(kept["simhash near-dedup"]) & {1000, 1001, 1002, 1003}
    assert 2000 in kept["simhash near-dedup"] and 2000 not in kept["benchmark decontamination"]
    last = kept["secret scans"]
    assert last[2001].text.endswith('token = "[SECRET]"') and last[2001].n_chars == len(last[2001].text)
    out = P.run(spark, sf)
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"] and out.count() == len(last)
    assert out.agg(F.sum("taken")).first()[0] > 0
    assert P.ORACLE_SQL is None and len(P.STAGES) == 5


def test_empty_documents(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
