"""Batches that are repeated, missing or empty leave the same tables as one pass over all rows."""

import random

from pyspark.sql import functions as F

from grainsift.operators import dedup, rules
from grainsift.session import new_work_dir
from grainsift.streaming import batches as B

RULES = [rules.value_range("x", 0, 50), rules.not_null("t"), rules.categorical("t", ["a", "b"])]


def some(spark, n=400):
    rng = random.Random(9)
    rows = [(k, rng.choice([None, rng.randrange(-10, 60)]), rng.choice(["a", "b", "c", None])) for k in range(n)]
    return spark.createDataFrame(rows, "k int, x int, t string").repartition(3, "k")


def test_both_halves_survive_repeats(spark, rows_of):
    df, path = some(spark), new_work_dir(spark, "halves")
    write = B.quarantine_writer(path, RULES)
    assert B.committed(spark, path).count() == 0
    parts = [df.filter(F.col("k") % 3 == i) for i in range(3)]
    write(parts[0], 0)
    write(df, 1)  # a batch that did not come to its end as it was, and is repeated
    write(parts[1], 1)
    write(parts[2], 2)
    write(parts[2], 2)
    write(df.limit(0), 3)
    good, bad = rules.quarantine(df, RULES)
    assert rows_of(B.good_rows(spark, path)) == rows_of(good)
    assert rows_of(B.bad_rows(spark, path)) == rows_of(bad)
    report = rules.rules_report(df, RULES).drop("bad_values")
    assert rows_of(B.rule_totals(spark, path)) == rows_of(report)
    assert {r.batch_id: r.rows for r in B.committed(spark, path).collect()} == {
        0: parts[0].count(), 1: parts[1].count(), 2: parts[2].count(), 3: 0}
    parts[0].withColumn("violated_rules", F.array().cast("array<int>")).withColumn("obeys", F.lit(True)).write.partitionBy("obeys").parquet(
        f"{path}/rows/batch_id=9")  # written, not committed
    assert B.good_rows(spark, path).count() == good.count()


def test_duplicates_over_batches(spark, rows_of):
    df, path = some(spark), new_work_dir(spark, "dups")
    keys = ["x", "t"]
    write = B.dedup_writer(path, keys, ["k"])
    parts = [df.filter(F.col("k").between(a, b - 1)) for a, b in ((0, 90), (90, 90), (90, 310), (310, 400))]
    for i, part in enumerate(parts):
        write(part, i)
    for i in (0, 2, 3, 2):  # repeats see only what came before them
        write(parts[i], i)
    assert rows_of(B.first_rows(spark, path)) == rows_of(dedup.remove_duplicates(df, keys, "first", ["k"]))
    assert rows_of(B.duplicate_totals(spark, path)) == rows_of(dedup.duplicate_report(df, keys))
    target = new_work_dir(spark, "compact")
    B.compact_sizes(spark, path, target)
    assert rows_of(B.duplicate_totals(spark, target)) == rows_of(dedup.duplicate_report(df, keys))
    B.dedup_writer(target, keys, ["k"])(parts[0].union(spark.createDataFrame([(999, 7777, "new")], df.schema)), 4)
    assert [r.k for r in B.first_rows(spark, target).collect()] == [999]


def test_whole_rows_over_batches(spark, rows_of):
    df, path = some(spark).withColumn("t", F.repeat("t", 40)), new_work_dir(spark, "rows")
    write = B.dedup_writer(path)
    write(df, 0)
    write(df.union(df), 1)
    assert rows_of(B.first_rows(spark, path)) == rows_of(df)
    assert B.duplicate_totals(spark, path).first().duplicates == 2 * df.count()
