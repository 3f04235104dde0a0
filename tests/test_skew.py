"""Joins with hot keys: the rows of a plain join, spread evenly."""

from statistics import median

import pytest
from pyspark.sql import functions as F

from folioscope import fixed_values as V, schemas
from folioscope.operators import skew, votes
from folioscope.session import stored


def sides(spark):
    left = spark.range(20_000).select(
        F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 3000).cast("long").alias("k"), F.col("id").alias("x"))
    right = spark.range(2500).select((F.col("id") + 5).alias("k"), F.col("id").alias("y")).unionByName(spark.createDataFrame([(7, -1), (None, -2)], "k long, y long"))
    return stored(left), stored(right)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("sent", [100, 0])
def test_equal_to_a_plain_join(spark, how, sent):
    left, right = sides(spark)
    assert skew.heavy(left, ["k"], least=500)
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert rows(skew.join(left, right, ["k"], how, least=500, sent_rows=sent)) == rows(left.join(right, ["k"], how))


def test_other_joins_are_refused(spark):
    left, right = sides(spark)
    with pytest.raises(ValueError):
        skew.join(left, right, ["k"], "full")


def test_no_task_holds_half_of_the_votes(spark, monkeypatch):
    """Half of all votes are on one hit."""
    monkeypatch.setattr(skew, "LEAST", 100)
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.enabled", "false")
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    own.conf.set("spark.sql.shuffle.partitions", "8")
    cast = own.range(40_000, numPartitions=8).select(
        F.lit("u").alias("evaluator"), F.lit(V.APPROACH_JOINT).alias("approach_id"), F.lit("q").alias("query"),
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 900)).alias("result_id"), (F.col("id") % 3 == 0).alias("liked"))
    hits = own.createDataFrame([(V.APPROACH_JOINT, "q", "hot", "text", 1, 0.5)] + [(V.APPROACH_JOINT, "q", f"r{i}", "text", 1, 0.1) for i in range(900)],
                               "approach_id string, query string, id string, type string, page int, score double")
    own.conf.set("spark.sql.files.openCostInBytes", "0")
    monkeypatch.setattr(skew.join, "__defaults__", ("inner", skew.SHARE, 100, skew.SENT_ROWS))
    out = votes.events(hits, cast, now=F.lit("t"))
    assert out.columns == schemas.EVALUATION.fieldNames() and out.count() == 40_000
    sizes = [r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes) <= 2 * median(sizes)
