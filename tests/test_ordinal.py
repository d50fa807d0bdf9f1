"""Positions and forward fill against a plain global window, with many small buckets."""

import pytest
from pyspark.sql import Window, functions as F

from grainsift.operators import ordinal
from grainsift.operators.ordinal import forward_fill_column, with_ordinal


def global_position(df, *keys):
    return df.withColumn("_ord", (F.row_number().over(Window.orderBy(*keys)) - 1).cast("bigint"))


def test_position_equals_global_window(spark, rows_of):
    df = spark.range(5000).select(
        (F.col("id") * 7919 % 5003).alias("k"), F.xxhash64("id").alias("v")
    )
    got = with_ordinal(df, ["k"], rows_per_bucket=300)
    assert rows_of(got) == rows_of(global_position(df, "k"))


def test_position_descending_puts_nulls_last(spark, rows_of):
    df = spark.range(3000).select(
        F.when(F.col("id") % 10 != 0, F.col("id") * 31 % 3001).alias("k"), "id"
    )
    got = with_ordinal(df, ["k", "id"], descending=True, rows_per_bucket=250)
    expected = global_position(df, F.col("k").desc_nulls_last(), F.col("id").desc())
    assert rows_of(got) == rows_of(expected)
    got = with_ordinal(df, ["k", "id"], rows_per_bucket=250)
    expected = global_position(df, F.col("k").asc_nulls_last(), F.col("id"))
    assert rows_of(got) == rows_of(expected)


@pytest.mark.parametrize("kind", ["string", "date", "timestamp", "timestamp_ntz", "decimal(12,2)", "double"])
def test_position_on_other_key_types(spark, rows_of, kind):
    n = F.col("id") * 37 % 2003
    key = {
        "string": F.lpad(n.cast("string"), 6, "0"),
        "date": F.date_add(F.lit("2000-01-01").cast("date"), n.cast("int")),
        "timestamp": F.timestamp_seconds(n * 3607),
        "timestamp_ntz": F.timestamp_seconds(n * 3607).cast("timestamp_ntz"),
    }.get(kind, n.cast(kind))
    df = spark.range(2000).select(key.alias("k"), "id")
    got = with_ordinal(df, ["k"], rows_per_bucket=150)
    assert rows_of(got) == rows_of(global_position(df, "k"))


def test_hot_key_is_split_over_buckets(spark):
    """A third of the rows share one key but differ elsewhere."""
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 42).otherwise(F.col("id") % 4001).alias("k"), "id"
    )
    cut = ordinal._bucketed(df, ["k"], True, 500)
    sizes = [r["count"] for r in cut.rows.groupBy("__bucket").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 1500
    got = with_ordinal(df, ["k"], rows_per_bucket=500)
    assert got.count() == 9000
    assert got.agg(F.count_distinct("_ord"), F.min("_ord"), F.max("_ord")).first() == (9000, 0, 8999)
    # positions agree with the order of keys
    step = F.col("k") - F.lag("k").over(Window.orderBy("_ord"))
    assert got.select(step.alias("s")).filter("s < 0").count() == 0


def test_copies_of_one_row_are_collapsed_and_restored(spark, monkeypatch, rows_of):
    """A third of the table is one and the same row."""
    monkeypatch.setattr(ordinal, "COPIES_PER_CHUNK", 100)
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 1000).otherwise(F.col("id")).alias("k")
    )
    cut = ordinal._bucketed(df, ["k"], True, 400)
    assert cut.collapsed
    assert max(r["count"] for r in cut.rows.groupBy("__bucket").count().collect()) < 1000
    got = with_ordinal(df, ["k"], rows_per_bucket=400)
    assert rows_of(got) == rows_of(global_position(df, "k"))


def fill_by_window(df, column, order, partition=()):
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def test_forward_fill_carries_over_buckets(spark, rows_of):
    df = spark.range(4000).select(
        "id", F.when(F.col("id") % 901 == 450, F.col("id") * 2).alias("v")
    )
    got = forward_fill_column(df, "v", ["id"], rows_per_bucket=200)
    assert rows_of(got) == rows_of(fill_by_window(df, "v", "id"))
    assert got.filter("v IS NULL").count() == 450  # nothing above the first value


def test_forward_fill_stays_inside_partitions(spark, rows_of):
    """One partition holds most rows, some are empty, one has a NULL key."""
    p = (
        F.when(F.col("id") % 3 != 0, 7)
        .when(F.col("id") % 50 == 0, None)
        .otherwise(F.col("id") % 40)
    )
    df = spark.range(5000).select(
        "id", p.alias("p"), F.when(F.col("id") % 97 == 5, F.col("id")).alias("v")
    )
    got = forward_fill_column(df, "v", ["id"], ["p"], rows_per_bucket=300)
    assert rows_of(got) == rows_of(fill_by_window(df, "v", "id", ["p"]))


def test_forward_fill_with_copies(spark, rows_of, monkeypatch):
    monkeypatch.setattr(ordinal, "COPIES_PER_CHUNK", 50)
    copied = F.col("id") % 2 == 0
    df = spark.range(3000).select(
        F.when(copied, 1501).otherwise(F.col("id")).alias("k"),
        F.when(copied, None).when(F.col("id") % 7 == 1, F.col("id")).alias("v"),
    )
    got = forward_fill_column(df, "v", ["k"], rows_per_bucket=200)
    filled = got.filter("k = 1501 AND v IS NOT NULL")
    # the copies sort before or after the one real row 1501, but alike
    assert got.count() == 3000
    assert filled.agg(F.count_distinct("v")).first()[0] <= 2
    other = fill_by_window(df.filter("k <> 1501"), "v", "k").filter("k < 1501")
    assert rows_of(got.filter("k < 1501")) == rows_of(other)


def test_result_does_not_depend_on_partitioning(spark, rows_of):
    df = spark.range(3000).select((F.col("id") * 13 % 997).alias("k"), "id")
    a = with_ordinal(df.repartition(7), ["k", "id"], rows_per_bucket=200)
    b = with_ordinal(df.repartition(2), ["k", "id"], rows_per_bucket=1000)
    assert rows_of(a) == rows_of(b)


def test_empty_table(spark):
    df = spark.range(0).withColumn("v", F.col("id"))
    assert with_ordinal(df, ["id"]).count() == 0
    assert forward_fill_column(df, "v", ["id"]).count() == 0


def test_order_is_required(spark):
    with pytest.raises(ValueError):
        with_ordinal(spark.range(3), [])
    with pytest.raises(ValueError):
        forward_fill_column(spark.range(3), "id", [])


def test_one_order_on_every_path(spark, rows_of):
    """Ties, copies and long texts: equal results for all partitionings and bucket sizes."""
    base = spark.range(600).select(
        (F.col("id") % 5).alias("k"), F.concat(F.lit("x" * 80), (F.col("id") % 3).cast("string")).alias("t"),
        F.when(F.col("id") % 4 != 0, (F.col("id") % 9).cast("double")).otherwise(float("nan")).alias("v"))
    seen = {name: set() for name in ("position", "text", "fill")}
    for parts in (1, 3, 7):
        for rows in (40, 150, 10_000):
            df = base.repartition(parts, "v")
            seen["position"].add(str(rows_of(with_ordinal(df, ["k"], rows_per_bucket=rows))))
            seen["text"].add(str(rows_of(with_ordinal(df, ["t"], descending=True, rows_per_bucket=rows))))
            seen["fill"].add(str(rows_of(forward_fill_column(df, "v", ["k"], rows_per_bucket=rows))))
    assert all(len(results) == 1 for results in seen.values())
