import statistics

import pytest
from pyspark.sql import functions as F

from grainsift.operators import dedup, skew
from grainsift.operators.profile import Whiskers
from grainsift.operators.quantiles import quantiles
from grainsift.operators.skew import hot_keys, join_unique


def exact(df, probs):
    return df.agg(F.percentile("x", F.array(*[F.lit(p) for p in probs]))).first()[0]


@pytest.mark.parametrize("shape", ["uniform", "skewed", "third_is_one_value", "two_values"])
def test_narrowing_equals_builtin(spark, shape):
    n = F.col("id")
    u = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1000.0
    x = {
        "uniform": u,
        "skewed": F.exp(u / 60.0),
        "third_is_one_value": F.when(n % 3 == 0, 500.0).otherwise(u),
        "two_values": F.when(n % 2 == 0, 1.0).otherwise(2.0),
    }[shape]
    df = spark.range(20_001).select(x.alias("x"))
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    assert quantiles(df, "x", probs, max_values=500) == pytest.approx(exact(df, probs), rel=1e-12)


def test_even_count_interpolates_and_nulls_are_ignored(spark):
    df = spark.createDataFrame([(1.0,), (None,), (4.0,), (2.0,), (3.0,)], "x double")
    assert quantiles(df, "x", [0.5]) == [2.5]
    assert quantiles(df, "x", [0.5], max_values=1) == [2.5]
    assert quantiles(df.filter("x IS NULL"), "x", [0.25, 0.5]) == [None, None]


def test_approximate_median_is_near(spark):
    df = spark.range(10_000).select(F.col("id").cast("double").alias("x"))
    assert quantiles(df, "x", [0.5], approx=True)[0] == pytest.approx(statistics.median(range(10_000)), rel=0.01)


def test_whiskers_of_an_empty_column():
    w = Whiskers(None, None)
    assert w.iqr is None and w.lower is None and w.upper is None


def _skewed(spark):
    """A third of the rows share one key, another part has none."""
    key = F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 11 == 1, None).otherwise(F.col("id") % 2000)
    return spark.range(12_000).select(key.alias("k"), "id")


def test_hot_keys_are_found_and_bounded(spark):
    df = _skewed(spark)
    hot = hot_keys(df, ["k"], small_rows=100)
    hashes = {r[0] for r in df.filter("k = 5 OR k IS NULL").select(skew.key_hash(["k"])).distinct().collect()}
    assert hashes & {h for h, _ in hot}
    assert len(hot) <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert hot_keys(df, ["k"]) == []  # small tables are not sampled


@pytest.mark.parametrize("how", ["inner", "left_semi"])
def test_salted_join_equals_plain_join(spark, rows_of, how):
    left = _skewed(spark).repartition(6)
    right = spark.createDataFrame([(5, "a"), (7, "b"), (None, "c"), (1999, "d")], "k bigint, name string")
    salted = join_unique(left, right, ["k"], how, small_rows=100)
    plain = join_unique(left, right, ["k"], how)
    assert rows_of(salted) == rows_of(plain)
    assert salted.columns == (["k", "id", "name"] if how == "inner" else ["k", "id"])
    assert salted.filter("k IS NULL").count() == left.filter("k IS NULL").count()


def test_salt_spreads_one_key(spark):
    left = _skewed(spark).repartition(6)
    hot = spark.createDataFrame(hot_keys(left, ["k"], 100), "__hash bigint, parts int")
    parts = left.filter("k = 5").withColumn("__hash", skew.key_hash(["k"])).join(F.broadcast(hot), "__hash")
    salts = parts.select(F.pmod(F.spark_partition_id(), "parts").alias("s")).distinct().count()
    assert salts > 1


def test_duplicate_members_with_hot_key(spark, rows_of, monkeypatch):
    df = _skewed(spark)
    plain = rows_of(dedup.duplicate_members(df, ["k"]))
    monkeypatch.setattr(skew, "SMALL_ROWS", 100)
    monkeypatch.setattr(dedup, "join_unique", lambda *a: join_unique(*a, small_rows=100))
    assert rows_of(dedup.duplicate_members(df, ["k"])) == plain
