from pyspark.sql import functions as F

from pinfold.runtime import broadcast_checked, discard, materialise, scratch_dir


def test_materialised_tables_are_files_and_go(spark):
    df = spark.range(10).withColumn("t", F.lit("x"))
    held = materialise(df, "t")
    assert held.schema.names == ["id", "t"] and held.count() == 10
    assert held.inputFiles()[0].removeprefix("file://").startswith(scratch_dir(spark).removeprefix("file:"))
    path = held._pinfold_path
    discard(held)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def test_only_small_tables_are_broadcast(spark):
    small = spark.range(10).withColumn("t", F.lit("x"))
    large = spark.range(3000).withColumn("t", F.repeat(F.lit("x"), 4000))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(spark.range(5).join(broadcast_checked(small, "t"), "id")).lower()
    assert "broadcast" not in plan(spark.range(5).join(broadcast_checked(large, "t"), "id")).lower()
