"""Mergeable states, bounded summaries and positions in files against plain computations."""

import math
import random

import pytest
from pyspark.sql import functions as F

from grainsift.operators import positions, profile, states
from grainsift.session import new_work_dir
from grainsift.sources.tables import table

from sample_tables import SF


def numbers(spark, n=3000):
    rng = random.Random(2)
    rows = [(f"d{k % 5}", rng.choice([None, float(rng.randrange(400)), math.nan]), rng.choice(["a", "b", None, "c" * 99]), k) for k in range(n)]
    return spark.createDataFrame(rows, "day string, x double, t string, k bigint")


EXACT = ["position", "column", "type", "non_null", "missing", "missing_pct", "min", "max", "mean", "std"]


def test_merged_states_equal_the_whole(spark, rows_of):
    df = numbers(spark)
    whole = states.profile_of_state(states.profile_state(df.drop("day")))
    parts = states.profile_state(df, ["day"])
    assert parts.count() == 15
    merged = states.profile_of_state(states.merge_states(parts))
    close = lambda a, b: a == b or (isinstance(a, float) and math.isclose(a, b, rel_tol=1e-9))
    for a, b in zip(rows_of(whole.select(*EXACT)), rows_of(merged.select(*EXACT))):
        assert all(close(x, y) for x, y in zip(a, b))
    estimate = {r.column: r for r in merged.collect()}
    exact = df.filter(~F.isnan("x")).agg(F.count_distinct("x")).first()[0]
    assert abs(estimate["x"].distinct_estimate - exact) <= states.DISTINCT_ERROR * exact
    assert estimate["t"].distinct_estimate == 3 and estimate["t"].std is None and estimate["t"].median_estimate is None
    q = {r.column: r.quantiles for r in states.state_quantiles(states.merge_states(parts), [0.1, 0.9]).collect()}
    assert set(q) == {"x", "k"} and abs(q["k"][0] - 300) <= 30 and abs(q["k"][1] - 2700) <= 30
    by_day = states.profile_of_state(states.merge_states(parts, ["day"]))
    assert by_day.columns[0] == "day" and by_day.filter("column = 'k'").agg(F.sum("non_null")).first()[0] == 3000


def test_states_of_days_are_saved_once(spark, rows_of):
    df, folder = numbers(spark), new_work_dir(spark, "states")
    for day in ("d0", "d1", "d1", "d2"):  # a day that is repeated replaces itself
        states.save_state(states.profile_state(df.filter(F.col("day") == day).drop("day")), folder, day)
    loaded = states.load_states(spark, folder)
    assert {r.part for r in loaded.select("part").collect()} == {"d0", "d1", "d2"}
    merged = states.merge_states(loaded).filter("column = 'k'").first()
    assert merged.rows == df.filter("day in ('d0', 'd1', 'd2')").count()


def test_empty_states(spark):
    empty = numbers(spark).limit(0)
    rows = states.profile_of_state(states.profile_state(empty.drop("day"))).collect()
    assert [(r.non_null, r.missing, r.mean, r.std, r.median_estimate) for r in rows] == [(0, 0, None, None, None)] * 3
    nulls = spark.createDataFrame([(None,), (math.nan,)], "x double")
    assert states.profile_of_state(states.profile_state(nulls)).first().missing == 2
    with pytest.raises(ValueError, match="clash"):
        states.profile_state(nulls.withColumn("rows", F.lit(1)), ["rows"])


def test_distinct_keys(spark):
    rng = random.Random(1)
    keys = [rng.randrange(-50_000, 50_000) for _ in range(6000)] + [None, 0, -1, 32767, 32768, -32768, -32769]
    df = spark.createDataFrame([(k, i % 3) for i, k in enumerate(keys)], "k bigint, part int")
    parts = states.key_state(df, "k", ["part"])
    assert states.count_keys(parts).first()[0] == len({k for k in keys if k is not None})
    for r in states.count_keys(parts, ["part"]).collect():
        assert r.distinct_keys == len({k for i, k in enumerate(keys) if k is not None and i % 3 == r.part})
    assert states.count_keys(states.key_state(df.limit(0), "k")).first()[0] == 0
    far = spark.createDataFrame([(k * 10**12,) for k in range(100)], "k bigint")
    with pytest.raises(ValueError, match="too far apart"):
        states.key_state(far, "k")
    with pytest.raises(ValueError, match="no integer"):
        states.key_state(spark.createDataFrame([("a",)], "k string"), "k")


@pytest.mark.parametrize("kind", ["few", "skewed", "unique", "ties", "long", "empty"])
def test_two_passes_give_the_top_values(spark, rows_of, kind):
    rng = random.Random(3)
    values = {"few": [rng.choice("abc") for _ in range(500)] + [None],
              "skewed": [f"h{min(int(rng.paretovariate(0.3)), 10**9)}" for _ in range(20_000)],
              "unique": [f"u{k}" for k in range(3000)], "ties": [f"t{k % 40}" for k in range(4000)],
              "long": [f"{'x' * 200}{k % 12}" for k in range(900)] + ["short"] * 5, "empty": [None]}[kind]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(4)
    for m in (40, 1000):
        assert rows_of(profile.top_values_two_pass(df, "v", candidates=m)) == rows_of(profile.top_values(df, "v"))
    ints = df.select(F.length("v").alias("v"))
    assert rows_of(profile.top_values_two_pass(ints, "v")) == rows_of(profile.top_values(ints, "v"))


def several_files(spark, n=1000, files=7):
    """Rows k in an order of their own, over files of uneven sizes; one of them is empty."""
    folder = new_work_dir(spark, "files")
    order = list(range(n))
    random.Random(5).shuffle(order)
    cuts = [0, 1, 1, 300, 310, 640, 900, n][: files + 1]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        rows = [(k, None if k % 3 else k) for k in order[a:b]]
        spark.createDataFrame(rows, "k int, v int").coalesce(1).write.parquet(f"{folder}/part={i}")
    return spark.read.parquet(folder), order


def test_positions_in_several_files(spark, capsys):
    df, order = several_files(spark)
    placed = positions.with_source_ordinal(df.select("k", (F.col("v") * 2).alias("w")))
    assert placed.columns == ["k", "w", "_ord"]
    assert [r.k for r in placed.orderBy("_ord").collect()] == order
    assert sorted(r._ord for r in placed.collect()) == list(range(1000))
    placed.explain()
    plan = capsys.readouterr().out
    assert "Sort " not in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan
    some = positions.with_source_ordinal(df.filter("k % 2 = 0")).orderBy("_ord").collect()
    assert [r.k for r in some] == [k for k in order if k % 2 == 0]
    assert [r.k for r in positions.head_of_source(df, 20).collect()] == order[:20]


@pytest.mark.parametrize("bucket", [10, 50_000])
def test_forward_fill_in_source_order(spark, bucket):
    df, order = several_files(spark)
    filled = {r.k: r.v for r in positions.forward_fill_source(df, "v", rows_per_bucket=bucket).collect()}
    last = None
    for k in order:
        last = last if k % 3 else k
        assert filled[k] == last


def test_positions_need_files(spark):
    with pytest.raises(ValueError, match="not read from files"):
        positions.with_source_ordinal(spark.range(3).toDF("k"))
    with pytest.raises(ValueError, match="already"):
        positions.with_source_ordinal(table(spark, SF, "orders"), "o_orderkey")
    with pytest.raises(ValueError, match="negative"):
        positions.head_of_source(table(spark, SF, "orders"), -1)
