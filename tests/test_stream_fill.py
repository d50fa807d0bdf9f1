"""Forward fill on a stream: state between batches, late rows, expiry."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from grainsift.session import new_work_dir
from grainsift.streaming import streams as X
from grainsift.streaming.fill import fill_forward_stream

T0 = dt.datetime(2024, 1, 1)


def run(spark, batches, **options):
    """batches: lists of (id, key, minutes, value)."""
    folder, work = new_work_dir(spark, "fill"), new_work_dir(spark, "out")
    schema = "id int, key string, ts timestamp, v double"
    for rows in batches:
        data = [(i, k, None if m is None else T0 + dt.timedelta(minutes=m), v) for i, k, m, v in rows]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    filled = fill_forward_stream(stream, "v", ["key"], "ts", ["id"], **options)
    assert filled.columns == ["id", "key", "ts", "v", "late"]
    X.append_to(filled, f"{work}/rows", f"{work}/checkpoint").awaitTermination()
    out = spark.read.parquet(f"{work}/rows")
    assert all(r.ts is None or r.ts >= T0 for r in out.collect())
    return {r.id: (r.v, r.late) for r in out.collect()}


def test_values_are_carried_and_late_rows_marked(spark):
    got = run(spark, [
        [(1, "a", 0, None), (2, "a", 1, 5.0), (3, "b", 1, float("nan")), (4, "a", 2, None), (5, None, 2, 9.0)],
        [(6, "a", 30, None), (7, "b", 30, 7.0), (8, "a", 1, None), (9, None, 31, None)],
        [(11, "a", 40, 6.0), (10, "a", 40, None), (12, "b", 41, None), (13, "a", 41, None)],
    ])
    assert got == {
        1: (None, False), 2: (5.0, False), 3: (None, False), 4: (5.0, False), 5: (9.0, False),
        6: (5.0, False), 7: (7.0, False), 8: (None, True), 9: (9.0, False),
        10: (5.0, False), 11: (6.0, False), 12: (7.0, False), 13: (6.0, False)}


def test_state_expires(spark):
    day = 24 * 60
    got = run(spark, [
        [(1, "a", 0, 5.0), (2, "b", 0, 6.0)],
        [(3, "b", 3 * day, None)],
        [(4, "b", 3 * day + 1, 1.0)],
        [(5, "a", 3 * day + 2, None), (6, "b", 3 * day + 2, None)],
    ], expire_seconds=86400)
    assert got[3] == (None, False) or got[3] == (6.0, False)  # the watermark has not passed before this batch
    assert got[5] == (None, False)  # a has been silent for three days
    assert got[6] == (1.0, False)


def test_keys_share_calls_and_states(spark):
    keys = [f"k{i}" for i in range(60)] + [None, ""]
    first = [(i, k, i % 5, float(i) if i % 3 else None) for i, k in enumerate(keys)]
    second = [(100 + i, k, 30 + i % 7, None) for i, k in enumerate(keys)] + [(900, "k1", 0, None)]
    one = run(spark, [first, second], parts=1)  # all keys in one state
    assert one == run(spark, [first, second])
    for i in range(len(keys)):
        assert one[i] == one[100 + i] == (float(i) if i % 3 else None, False)
    assert one[900] == (None, True)


def test_expiry_is_by_key_in_a_shared_state(spark):
    day = 24 * 60
    got = run(spark, [
        [(1, "a", 0, 5.0), (2, "b", 0, 6.0)], [(3, "b", 3 * day, None)], [(4, "b", 3 * day + 1, 1.0)],
        [(5, "a", 3 * day + 2, None), (6, "b", 3 * day + 2, None)]], expire_seconds=86400, parts=1)
    assert got[5] == (None, False) and got[6] == (1.0, False)


def test_refusals(spark):
    stream = spark.readStream.format("rate").load().withColumn("late", F.lit(1))
    with pytest.raises(ValueError, match="already"):
        fill_forward_stream(stream, "value", ["late"], "timestamp")
