from pyspark.sql import functions as F

from spanwise import runtime


def test_blank(spark):
    rows = [(None, True), ("", True), (" \t\n 　", True), ("x", False), (" . ", False)]
    df = spark.createDataFrame(rows, "x string, want boolean")
    assert df.where(runtime.is_blank(F.col("x")) != F.col("want")).count() == 0


def test_hot_join_equals_a_join(spark):
    left = spark.range(6000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 500).alias("k"), "id")
    right = runtime.materialize(left.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low")))
    for share in (2, 4096):
        out = runtime.hot_join(left, right, "k", share)
        assert out.count() == 6000 and out.agg(F.sum("low")).first()[0] == left.join(right, "k").agg(F.sum("low")).first()[0]
    assert runtime.hot_join(left.limit(0), right.limit(0), "k").count() == 0


def test_materialize_cuts_lineage(spark):
    df = runtime.materialize(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.agg(F.sum("x")).first()[0] == 90
    assert "ExistingRDD" in df._jdf.queryExecution().toString()
