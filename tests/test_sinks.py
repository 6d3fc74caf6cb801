import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from pinfold.functions import geo
from pinfold.functions import rules as R
from pinfold.functions import text as T
from pinfold.operators import review as V
from pinfold.operators.sampling import click_stack
from pinfold.sources import web as W
from pinfold.sources.document_sink import PlacesDocument
from pinfold.sources.paged import PagedFeatures

PIN = "name string, rel int, lat double"


def published(folder):
    return sorted(f for f in os.listdir(folder)) if folder.exists() else []


def test_a_document_its_twin_and_its_summary_come_together(spark, tmp_path):
    spark.dataSource.register(PlacesDocument)
    folder = tmp_path / "out"
    df = spark.range(0, 50).select(F.concat(F.lit("é\""), "id").alias("name"), (F.col("id") % 3).cast("int").alias("rel"), (F.col("id") / 4).alias("lat")).repartition(5)
    df.write.format("places_document").option("count_by", "rel").mode("overwrite").save(str(folder))
    assert published(folder) == ["places.json", "places.json.gz", "summary.json"]
    raw = (folder / "places.json").read_bytes()
    assert gzip.decompress((folder / "places.json.gz").read_bytes()) == raw
    doc, told = json.loads(raw), json.loads((folder / "summary.json").read_text())
    assert doc["k"] == ["name", "rel", "lat"] and sorted(map(tuple, doc["p"])) == sorted(map(tuple, df.collect()))
    assert told["n"] == 50 and told["by"] == {"0": 17, "1": 17, "2": 16}
    with pytest.raises(Exception, match="holds a document"):
        df.write.format("places_document").mode("append").save(str(folder))
    df.limit(0).write.format("places_document").mode("overwrite").save(str(folder))
    assert json.loads((folder / "places.json").read_text())["p"] == []


def test_a_failing_task_leaves_what_was_there(spark, tmp_path):
    spark.dataSource.register(PlacesDocument)
    folder = tmp_path / "out"
    good = spark.createDataFrame([("a", 1, 2.0)], PIN)
    good.write.format("places_document").mode("overwrite").save(str(folder))
    before = {f: (folder / f).read_bytes() for f in published(folder)}
    bad = spark.range(0, 40, 1, 4).select(F.col("id").cast("string").alias("name"), F.lit(1).alias("rel"), F.when(F.col("id") == 33, F.raise_error(F.lit("broken row")).cast("double")).otherwise(F.lit(1.0)).alias("lat"))
    with pytest.raises(Exception, match="broken row"):
        bad.write.format("places_document").mode("overwrite").save(str(folder))
    assert {f: (folder / f).read_bytes() for f in published(folder)} == before


def limited(offset, size, columns):
    """A service that never gives more than three rows, and says so."""
    return [{"NAME": f"n{i}"} for i in range(offset, min(offset + min(size, 3), 11))], offset + 3 < 11


def broken(offset, size, columns):
    raise OSError("down")


def filtered(offset, size, columns, where):
    rows = [{"NAME": f"n{i}", "X": float(i)} for i in range(40)]
    ask = {"=": lambda a, b: a == b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "in": lambda a, b: a in b}
    for column, operator, value in where:
        rows = [r for r in rows if ask[operator](r[column], value)]
    assert len(rows) <= 10, "the filter was not pushed"
    return rows[offset : offset + size]


@pytest.mark.parametrize("options", [{"page": "5"}, {"page": "5", "total": "11"}, {"page": "4", "fetch": "tests.test_sinks:broken,tests.test_sinks:limited"}])
def test_pages_cut_at_a_limit_are_read_on(spark, options):
    spark.dataSource.register(PagedFeatures)
    df = spark.read.format("paged_features").options(**{"fetch": "tests.test_sinks:limited", **options}).schema("NAME string").load()
    assert sorted(r.NAME for r in df.collect()) == sorted(f"n{i}" for i in range(11))


def test_no_endpoint_is_an_error(spark):
    spark.dataSource.register(PagedFeatures)
    df = spark.read.format("paged_features").options(fetch="tests.test_sinks:broken", attempts="2", wait="0").schema("NAME string").load()
    with pytest.raises(Exception, match="no endpoint"):
        df.collect()


def test_filters_reach_the_service(spark):
    spark.dataSource.register(PagedFeatures)
    key = "spark.sql.python.filterPushdown.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        df = spark.read.format("paged_features").options(fetch="tests.test_sinks:filtered", where="true", page="3").schema("NAME string, X double").load()
        got = df.where("X >= 4 and X < 12 and NAME in ('n5', 'n7', 'n30')")
        assert sorted(r.NAME for r in got.collect()) == ["n5", "n7"]
    finally:
        spark.conf.set(key, old)


def test_counters_fill_while_rows_are_written(spark, tmp_path):
    rows = [(1, "FIRST BAPTIST CHURCH", "", 40.0, -75.0, "PA", "X"), (2, "MASJID", "", 40.0, -75.0, "PA", "X"), (3, "UNKNOWN", "", 40.0, -75.0, "PA", "X"), (4, "MASJID", "", 1.0, 1.0, "ZZ", "X")]
    places = R.baked(spark.createDataFrame(rows, "row_id long, name string, code string, lat double, lon double, state string, city string"))
    told, counters = R.observed(places)
    told.write.parquet(str(tmp_path / "places"))
    got = counters.get
    assert got["n"] == 4
    assert {k: v for k, v in got.items() if v and k != "n"} == {r["class"]: r.n for r in R.bake_counters(places).collect()}


def test_names_in_the_order_of_people(spark):
    names = ["zebra", "Éclair", "eclair", "Eclair b", "apple", "Äpfel", "apple", "Zoo", "éclair a", "10 x", "Éclair au chocolat", None, "ecl"]
    df = spark.createDataFrame([(i, n, 0, 0.0, 0.0, False) for i, n in enumerate(names)], "row_id long, name string, rel int, x double, y double, synthetic boolean")
    got = [r.name for r in click_stack(df, 0.0, 0.0).orderBy("nth").collect()]
    assert got == [None, "10 x", "Äpfel", "apple", "apple", "ecl", "eclair", "Éclair", "éclair a", "Éclair au chocolat", "Eclair b", "zebra", "Zoo"]


def test_escaped_names_in_scripts(spark):
    page = r'{"lat":40.5,"lng":-75.1,"name":"Café \"Zion\" \/ St","slug":"s1"}'
    pattern = r'\{"lat":(-?[\d.]+),"lng":(-?[\d.]+),"name":"((?:[^"\\]|\\.)*)","slug":"([^"]*)"\}'
    assert [r.name for r in W.parse_points(spark.createDataFrame([(page,)], "html string"), "html", pattern).collect()] == ['Café "Zion" / St']


def test_buildings_of_a_name_in_a_state(spark):
    rows = [(3, "St Mary Cathedral", "KY", 38.0, -85.0, 90.0), (1, "Saint Mary Cathedral", "KY", 37.0, -84.0, 800.0), (2, "St Mary Cathedral", "KY", 37.0, -84.0, 801.0), (4, "Cathedral", "KY", 37.0, -84.0, 5.0), (5, "St Mary Cathedral", "IN", 39.0, -86.0, 5.0)]
    got = V.landmark_places(spark.createDataFrame(rows, "row_id long, name string, state string, lat double, lon double, span_m double")).collect()
    assert sorted((r.state, r.key, [p.row_id for p in r.places]) for r in got) == [("IN", "CATHEDRAL MARY ST", [5]), ("KY", "CATHEDRAL MARY ST", [1, 3])]


def test_small_column_functions(spark):
    row = spark.range(1).select(
        T.base_class(F.lit("christian_baptist_x")).alias("a"), T.base_class(F.lit("plain")).alias("b"), geo.valid_county(F.lit(" n/a ")).alias("c"), geo.valid_county(F.lit("Adair")).alias("d"), geo.valid_county(F.lit(None)).alias("e"),
        geo.in_box(F.lit(40.0), F.lit(-75.0), (40.0, 41.0, -75.0, -74.0)).alias("f"), geo.in_country(F.lit(21.3), F.lit(-157.8), F.lit("HI")).alias("g"), geo.in_country(F.lit(40.0), F.lit(-75.0), F.lit("HI")).alias("h"), geo.in_country(F.lit(40.0), F.lit(-75.0), F.lit("XX")).alias("i"),
    ).first()
    assert tuple(row) == ("christian", "plain", False, True, False, True, True, False, False)
