import pytest
from pyspark.sql import functions as F

from grainsift.operators import compare, dedup, score as Q, skew
from grainsift.operators.inject import pick_golden
from grainsift.sources.tables import table

from sample_tables import SF


@pytest.fixture(scope="module")
def truth(spark):
    return table(spark, SF, "orders")


def test_truth_scores_itself(spark, truth):
    golden = pick_golden(truth, "o_orderkey", 5)
    row = Q.score(truth, truth, truth, key=["o_orderkey"], golden=golden).first()
    for d in ("missing_fixed", "duplicates_removed", "type_correctness", "value_accuracy", "data_preservation", "golden_row_integrity"):
        assert row[d] == 1.0, d
    assert row["constraint_compliance"] == 0.8 and row["step_efficiency"] == 0.5
    assert row["composite"] == pytest.approx(0.9 + 0.1 * 0.8 - 0.05 * 0.5)
    by_position = Q.score(truth, truth, truth, order_by=["o_orderkey"]).first()
    assert by_position["value_accuracy"] == 1.0
    with pytest.raises(ValueError):
        Q.score(truth, truth, truth)


def test_a_removed_row_shifts_positions_but_not_keys(spark):
    rows = [(i, f"v{i}") for i in range(10)]
    truth = spark.createDataFrame(rows, "k int, v string")
    current = truth.filter("k <> 0")
    assert compare.accuracy_by_key(current, truth, ["k"]).first()["accuracy"] == 1.0
    by_position = compare.accuracy_by_position(current, truth, ["k"]).first()
    # 1..9 meet 0..8: no text is equal, and no number is within 1 %
    assert tuple(by_position) == (18, 0.0, 0.0)
    many = compare.accuracy_by_position(truth, truth, ["k"], rows_per_bucket=3).first()
    assert tuple(many) == (20, 20.0, 1.0)


def test_positional_over_buckets_equals_one_bucket(spark, truth):
    current = truth.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")))
    one = compare.accuracy_by_position(current, truth, ["o_orderkey"]).first()
    many = compare.accuracy_by_position(current, truth, ["o_orderkey"], rows_per_bucket=100).first()
    assert one["cells"] == many["cells"] and one["matched"] == pytest.approx(many["matched"])


def test_repeated_keys_do_not_multiply(spark):
    truth = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    current = spark.createDataFrame([(1, "a")] * 5 + [(2, "x")], "k int, v string")
    assert tuple(compare.accuracy_by_key(current, truth, ["k"]).first()) == (12, 11.0, pytest.approx(11 / 12))


def test_keys_of_another_type(spark):
    truth = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    current = spark.createDataFrame([("1", "a"), ("x", "b"), (None, "c")], "k string, v string")
    assert tuple(compare.accuracy_by_key(current, truth, ["k"]).first()) == (2, 2.0, 1.0)
    back = compare.accuracy_by_key(truth, current, ["k"]).first()
    assert tuple(back) == (2, 2.0, 1.0)


def test_long_texts_are_told_apart(spark):
    import hashlib

    long = "x" * 70
    mark = "#" + hashlib.sha256(long.encode()).hexdigest()
    texts = [long, long, mark, mark[1:], "x" * 64, "x" * 65, "é" * 40, None, None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    row = dedup.duplicate_report(df).first()
    assert (row["rows"], row["duplicates"], row["members"], row["groups"]) == (10, 2, 4, 2)
    assert sorted(r[0] or "" for r in dedup.duplicate_members(df).collect()) == ["", "", long, long]
    assert dedup.remove_duplicates(df, keep="none").count() == 6


def test_keyed_accuracy_with_a_hot_key(spark, monkeypatch):
    truth = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    current = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 2000).alias("k"),
        F.when(F.col("id") % 3 == 0, 10).otherwise(-1).cast("bigint").alias("v"))
    plain = compare.accuracy_by_key(current, truth, ["k"]).first()
    salted = lambda left, right, keys: skew.join_unique(left, right, keys, small_rows=100)
    monkeypatch.setattr(compare, "join_unique", salted)
    assert compare.accuracy_by_key(current, truth, ["k"]).first() == plain


def brute_force_found(current, golden, columns):
    found = 0
    for g in golden:
        for c in current:
            same = sum(str(g[x]).strip().lower() == str(c[x]).strip().lower() for x in columns)
            if same / len(columns) > 0.8:
                found += 1
                break
    return found


@pytest.mark.parametrize("width", [1, 4, 5, 6, 9, 10, 11, 12])
def test_golden_rows_equal_brute_force(spark, width):
    """Rows with 0 to 3 spoiled cells at moving places."""
    columns = [f"c{j}" for j in range(width)]
    cell = lambda j: F.concat(F.lit(f" V{j}-"), F.col("id").cast("string"))
    golden = spark.range(40).select("id", *[cell(j).alias(c) for j, c in enumerate(columns)])
    spoiled = lambda j: F.pmod(F.lit(j) - F.col("id"), F.lit(width)) < F.pmod(F.col("id"), F.lit(4))
    current = golden.select("id", *[
        F.when(spoiled(j), "bad").otherwise(F.lower(F.trim(c))).alias(c) for j, c in enumerate(columns)])
    got = compare.golden_report(current, golden, "id", columns).first()
    expected = brute_force_found(current.collect(), golden.collect(), columns)
    assert tuple(got) == (40, expected)


def test_golden_rows_and_empty_table(spark, truth):
    golden = pick_golden(truth, "o_orderkey", 5)
    assert tuple(compare.golden_report(truth.limit(0), golden, "o_orderkey").first()) == (5, 0)
    none = compare.golden_report(truth, golden.limit(0), "o_orderkey")
    assert Q.golden_share(none).first()[0] == 1.0
    assert compare.golden_report(truth.select(F.lit(1).alias("other")), golden, "o_orderkey").first()["found"] == 0


def test_golden_rows_of_mixed_types(spark):
    golden = spark.createDataFrame([(1, 5.0, "2024-01-02"), (2, 7.0, "2024-01-03")], "k int, x double, d string")
    current = spark.createDataFrame([("1", "5", "2024-01-02"), ("2", "8", "2024-01-03")], "k string, x string, d string")
    assert tuple(compare.golden_report(current, golden, "k").first()) == (2, 1)
    dated = current.withColumn("d", F.to_date("d"))
    assert tuple(compare.golden_report(dated, golden, "k", dates=True).first()) == (2, 1)


def test_types(spark):
    truth = spark.range(1).select("id", F.lit("x").alias("s"), F.lit(1.5).alias("x"), F.lit(1).alias("gone"))
    current = spark.range(1).select(F.col("id").cast("double"), F.lit(1).alias("s"), F.lit(2).alias("x"))
    assert compare.type_share(current, truth) == 0.5
    got = {r["column"]: r["matches"] for r in compare.type_report(current, truth).collect()}
    assert got == {"id": True, "s": False, "x": True, "gone": False}


def test_efficiency():
    assert [Q.step_efficiency(s, b) for s, b in ((0, 30), (5, 0), (8, 50), (25, 50), (50, 50))] == [0.5, 0.5, 1.0, 0.75, 0.1]


@pytest.mark.parametrize("gain, effect", [(0.02, 0.07), (0.5, 0.15), (0.0, 0.001), (-0.005, 0.001), (-0.05, -0.1), (-0.5, -0.2)])
def test_bounded_effect(spark, gain, effect):
    assert spark.range(1).select(Q.bounded_effect(F.lit(gain))).first()[0] == pytest.approx(effect)


def test_progress(spark):
    df = spark.createDataFrame([(10, 4, 0), (10, 12, 0), (10, 0, 5), (3, 9, 3)], "b int, c int, t int")
    got = [r[0] for r in df.select(Q.progress(F.col("b"), F.col("c"), F.col("t"))).collect()]
    assert got == [0.6, 0.0, 1.0, 1.0]


def test_dropped_and_extra_columns_are_reported(spark, truth):
    current = truth.drop("o_custkey").withColumn("note", F.lit(1)).unionByName(truth.limit(3), allowMissingColumns=True).drop("o_custkey")
    row = Q.score(current, truth, truth, key=["o_orderkey"]).first()
    assert (row["extra_rows"], row["dropped_columns"], row["extra_columns"]) == (3, 1, 1)


def test_keep_variants(spark, rows_of):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, None, 3), (None, "d", 4), (None, "e", 5)], "k int, v string, o int")
    first = dedup.remove_duplicates(df, ["k"], "first", ["o"])
    assert sorted(r["o"] for r in first.collect()) == [1, 3, 4]
    last = dedup.remove_duplicates(df, ["k"], "last", ["o"])
    assert sorted(r["o"] for r in last.collect()) == [2, 3, 5]
    none = dedup.remove_duplicates(df, ["k"], "none")
    assert rows_of(none) == [(2, None, 3)]
    assert rows_of(dedup.remove_duplicates(first, ["k"], "first", ["o"])) == rows_of(first)
    for bad in ({"subset": ["k"]}, {"keep": "some"}, {"subset": ["zz"]}):
        with pytest.raises(ValueError):
            dedup.remove_duplicates(df, **bad)


def test_maps_are_refused(spark):
    df = spark.range(1).select(F.create_map(F.lit("a"), F.lit(1)).alias("m"))
    with pytest.raises(ValueError, match="map"):
        dedup.remove_duplicates(df)
