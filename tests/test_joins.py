import pytest
from pyspark.sql import functions as F

from siltstone.operators import joins
from siltstone.session import settle


def skewed(spark):
    """A third of the rows on key 7, many equal rows and NULL keys among them."""
    rows = [(7, "same") for _ in range(300)] + [(i % 50, f"r{i}") for i in range(500)] + [(None, "n")] * 100
    return spark.createDataFrame(rows, "k int, v string").repartition(4)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_equals_the_plain_join(spark, how, monkeypatch):
    left = skewed(spark)
    right = spark.createDataFrame([(i, f"x{i}") for i in range(0, 60, 7)] + [(7, "again")], "k int, w string")
    plain = sorted(map(str, left.join(right, "k", how).collect()))
    known = settle(right)
    for fits in (True, False):
        monkeypatch.setattr(joins, "fits_broadcast", lambda *a, fits=fits: fits)
        assert sorted(map(str, joins.lookup_join(left, known, ["k"], how).collect())) == plain
    assert sorted(map(str, joins.lookup_join(left, right, ["k"], how).collect())) == plain


def test_adaptive_execution_splits_a_hot_key(spark):
    """What the plain join relies on: the partition of a hot key is read in pieces."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        left = spark.range(0, 60_000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), F.sha1(F.col("id").cast("string")).alias("v"))
        joined = joins.lookup_join(left, spark.range(60_000).withColumnRenamed("id", "k"), ["k"])
        assert joined.write.format("noop").mode("overwrite").save() is None
        rows = joined.collect()
        assert len(rows) == 60_000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_size_check(spark):
    stored = settle(spark.range(100).withColumn("t", F.lit("abcd")))
    assert (stored.rows, stored.size) == (100, 1200)
    assert not joins.fits_broadcast(stored, rows=99) and joins.fits_broadcast(stored)
    assert not joins.fits_broadcast(stored, size=1199)
    assert settle(spark.range(5).where("id < 0")).rows == 0
