"""Keep-first does not depend on the partitioning of its input."""

from pyspark.sql import functions as F

from provena.operators.dedup import keep_first


def test_keep_first_partition_independent(spark):
    df = spark.range(0, 2000).select((F.col("id") % 37).alias("k"), F.col("id").alias("_seq"),
                                     (F.col("id") * 7 % 101).alias("v"))
    df = df.withColumn("k", F.when(F.col("k") == 0, F.lit(None)).otherwise(F.col("k")))
    results = []
    for n in (1, 4, 17):
        got = keep_first(df.repartition(n), ["k"], ["_seq"]).orderBy(F.col("k").asc_nulls_first()).collect()
        results.append([tuple(r) for r in got])
    assert results[0] == results[1] == results[2]
    assert len(results[0]) == 37


def test_keep_first_plans_group_limit(spark):
    df = spark.range(0, 100).select((F.col("id") % 3).alias("k"), F.col("id").alias("_seq"))
    plan = keep_first(df, ["k"], ["_seq"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
