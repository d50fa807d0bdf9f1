"""Cell-level semantics on small literal tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from grainsift.functions import cells, text
from grainsift.functions.schema import typed_literal
from grainsift.functions.numbers import number
from grainsift.operators import columns as C, fill, profile, rows as R
from grainsift.sources.tables import nan_to_null, table

from sample_tables import SF


def column(df, name="c"):
    return [r[0] for r in df.select(name).collect()]


def frame(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"c {kind}").coalesce(1)


def test_numeric_text(spark):
    given = [" 5 ", "1e5", ".5", "5.", "-3.25", "1d", "1_000", "0x10", "1,000", "inf", "nan", "", None, "abc"]
    df = frame(spark, given)
    got = column(df.select(number(df, "c").alias("c")))
    assert got == [5.0, 1e5, 0.5, 5.0, -3.25] + [None] * 9


def test_nan_counts_as_missing(spark):
    df = frame(spark, [1.0, float("nan"), None], "double")
    assert column(nan_to_null(df)) == [1.0, None, None]
    assert profile.missing_report(df).first()["missing"] == 2
    assert column(fill.fill_missing(df, "c", "mean")) == [1.0, 1.0, 1.0]


def test_cast_float_strips_text_but_not_numbers(spark):
    assert column(C.fix_dtype(frame(spark, ["$12.5", "n/a", "1,000", "--5", None]), "c", "float")) == [
        12.5, None, 1000.0, None, None]
    assert column(C.fix_dtype(frame(spark, [1e16, 1e-05], "double"), "c", "float")) == [1e16, 1e-05]


def test_cast_int_nulls_fractions_and_can_round(spark):
    df = frame(spark, ["7", "7.5", "-2.5", "$3", "12345678901234567", "x", None])
    assert column(C.fix_dtype(df, "c", "int")) == [7, None, None, 3, 12345678901234567, None, None]
    assert column(C.fix_dtype(df, "c", "int", rounding="floor"))[1:3] == [7, -3]
    assert column(C.fix_dtype(df, "c", "int", rounding="truncate"))[1:3] == [7, -2]
    report = C.coercion_report(df, "c", "int").first()
    assert (report["non_null"], report["coercion_errors"]) == (6, 3)


def test_cast_string_keeps_null(spark):
    assert column(C.fix_dtype(frame(spark, [1, None], "int"), "c", "str")) == ["1", None]


def test_cast_datetime_formats(spark):
    df = frame(spark, ["2023-01-15", "15/01/2023", "01-15-2023", " 15 Jan 2023 ", "2023-02-30", "soon", None])
    day = dt.datetime(2023, 1, 15)
    assert column(C.fix_dtype(df, "c", "datetime")) == [day] * 4 + [None] * 3
    stamped = frame(spark, ["20230115 10:30:00", "2023"])
    assert column(C.fix_dtype(stamped, "c", "datetime", formats=["yyyyMMdd HH:mm:ss"])) == [
        dt.datetime(2023, 1, 15, 10, 30), None]


def test_dates_do_not_depend_on_the_session_time_zone(spark):
    df = frame(spark, ["2018-11-04"])  # midnight did not exist in this zone
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
        assert column(C.fix_dtype(df, "c", "datetime")) == [dt.datetime(2018, 11, 4)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_title_and_strip(spark):
    df = frame(spark, ["usb-c hub", "o'neil 3rd éa", "ALL CAPS", "", None])
    assert column(C.standardize(df, "c", "titlecase")) == ["Usb-C Hub", "O'Neil 3Rd Éa", "All Caps", "", None]
    df = frame(spark, [" \t a b \n", "\x1fx", None])
    assert column(C.standardize(df, "c", "strip")) == ["a b", "x", None]


def test_replace_compares_in_the_column_type(spark):
    assert column(C.replace_value(frame(spark, [5.0, None], "double"), "c", "5", "6")) == [6.0, None]
    with pytest.raises(ValueError):
        C.replace_value(frame(spark, [5.0], "double"), "c", 5, "six")
    with pytest.raises(ValueError):
        C.replace_value(frame(spark, [5], "int"), "c", 5, 2**40)


def test_regex_replace_references_and_errors(spark):
    df = frame(spark, ["ab12", None])
    assert column(C.regex_replace(df, "c", r"([a-z]+)(\d+)", r"\2-\g<1>$")) == ["12-ab$", None]
    assert column(C.regex_replace(df, "c", r"(?P<word>[a-z]+)", r"<\g<word>>")) == ["<ab>12", None]
    with pytest.raises(ValueError, match="invalid regular expression"):
        C.regex_replace(df, "c", "([", "")


def test_clip(spark):
    assert column(C.clip(frame(spark, ["5", "-1", "99", "x", None]), "c", 0, 10)) == [5.0, 0.0, 10.0, None, None]
    with pytest.raises(ValueError):
        C.clip(frame(spark, ["5"]), "c", 10, 0)


def test_row_conditions_and_nulls(spark):
    df = frame(spark, ["an", "Banana", None, "5", "50"])
    assert column(R.remove_rows(df, "c", "contains", "an")) == [None, "5", "50"]
    assert column(R.remove_rows(df, "c", "not_equals", "an")) == ["an"]
    assert column(R.remove_rows(df, "c", "not_equals", "an", keep_nulls=True)) == ["an", None]
    assert column(R.remove_rows(df, "c", "equals", "an")) == ["Banana", None, "5", "50"]
    assert column(R.remove_rows(df, "c", "less_than", "10")) == ["an", "Banana", None, "50"]
    assert column(R.remove_rows(df, "c", "greater_than", 10)) == ["an", "Banana", None, "5"]
    for bad in (("less_than", "ten"), ("contains", "(["), ("about", "x")):
        with pytest.raises(ValueError):
            R.remove_rows(df, "c", *bad)


@pytest.mark.parametrize("kind", ["int", "bigint", "double", "decimal(9,2)", "string"])
def test_numeric_bounds_on_any_type(spark, kind):
    df = spark.createDataFrame([(i,) for i in (-3, 0, 2, 3, 7)] + [(None,)], "n int")
    df = df.select(F.col("n").cast(kind).alias("c"), "n").coalesce(1)
    for value, low, high in ((2, [2, 3, 7], [-3, 0, 2]), (2.5, [3, 7], [-3, 0, 2]), ("-0.5", [0, 2, 3, 7], [-3])):
        assert column(R.remove_rows(df, "c", "less_than", value), "n") == [*low, None]
        assert column(R.remove_rows(df, "c", "greater_than", value), "n") == [*high, None]


def test_nan_is_kept_by_numeric_bounds(spark):
    df = frame(spark, [float("nan"), 1.0], "double")
    for condition in ("less_than", "greater_than"):
        assert R.remove_rows(df, "c", condition, 5 if condition == "less_than" else 0).count() == 1


def test_conditions_reach_the_scan(spark, capsys):
    orders = table(spark, SF, "orders")
    for condition, column_, value in (
        ("less_than", "o_totalprice", 1000), ("greater_than", "o_custkey", 50),
        ("equals", "o_orderstatus", "F"), ("not_equals", "o_orderstatus", "F"),
    ):
        R.remove_rows(orders, column_, condition, value).select("o_orderkey").explain()
        plan = capsys.readouterr().out
        assert "PushedFilters: [" in plan and "PushedFilters: []" not in plan, condition
        assert f"ReadSchema: struct<o_orderkey:bigint,{column_}" in plan or "o_orderkey" in plan


def test_sort_and_view(spark):
    df = frame(spark, [2, None, 3, 1], "int")
    assert column(R.sort_rows(df, "c")) == [1, 2, 3, None]
    assert column(R.sort_rows(df, "c", "desc")) == [3, 2, 1, None]
    assert column(R.view_rows(df, 2, ["c"])) == [1, 2]
    assert R.view_rows(spark.range(200), 50, ["id"]).count() == 50
    with pytest.raises(ValueError):
        R.view_rows(spark.range(200), 51)
    with pytest.raises(ValueError):
        R.view_rows(df, -3)


def test_columns_by_exact_name(spark):
    df = frame(spark, ["x"]).withColumn("odd name.1", F.lit(1))
    assert C.rename_column(df, "odd name.1", "d").columns == ["c", "d"]
    assert C.drop_column(df, "odd name.1").columns == ["c"]
    assert column(C.standardize(df, "odd name.1", "strip"), "`odd name.1`") == ["1"]
    for call in (
        lambda: C.rename_column(df, "C", "d"), lambda: C.rename_column(df, "c", "odd name.1"),
        lambda: C.drop_column(df, "nope"),
    ):
        with pytest.raises(ValueError):
            call()


def test_fill_strategies(spark):
    df = frame(spark, ["b", "a", None, "a", "b"])
    assert column(fill.fill_missing(df, "c", "mode"))[2] == "a"  # a tie goes to the smallest
    assert column(fill.fill_missing(df, "c", "constant", "z"))[2] == "z"
    with pytest.raises(ValueError):
        fill.fill_missing(df, "c", "mean")
    with pytest.raises(ValueError):
        fill.fill_missing(frame(spark, [1, None], "int"), "c", "constant", "many")
    with pytest.raises(ValueError):
        fill.fill_missing(df, "c", "constant")
    mixed = frame(spark, ["1", "x", None, "3"])
    assert column(fill.fill_missing(mixed, "c", "median")) == [1.0, 2.0, 2.0, 3.0]
    assert column(fill.fill_missing(frame(spark, [None, None]), "c", "mode")) == [None, None]
    report = fill.fill_report(df, "c", "mode").first()
    assert tuple(report) == ("c", 1, 1, 0)


def test_empty_table_has_no_percentages(spark):
    df = frame(spark, [], "int")
    assert [r["missing_pct"] for r in profile.profile_table(df).collect()] == [None]
    assert profile.profile_numeric(df, "c").first()["median"] is None
    assert profile.table_shape(df).first()["duplicate_pct"] is None


def test_approximate_profile_agrees_on_counts(spark):
    df = frame(spark, ["a", "b", None, "a", "x" * 100])
    exact, rough = profile.profile_table(df), profile.profile_table(df, approx=True)
    assert tuple(exact.first()) == tuple(rough.first()) == (0, "c", "string", 4, 1, 20.0, 3)


def score(spark, truth, current, t_kind, c_kind, **options):
    df = spark.createDataFrame([(truth, current)], f"t {t_kind}, c {c_kind}")
    s = cells.cell_score(
        F.col("t"), df.schema["t"].dataType, F.col("c"), df.schema["c"].dataType, **options
    )
    return df.select(s).first()[0]


def test_cell_score(spark):
    assert score(spark, " Male ", "male", "string", "string") == 1.0
    assert score(spark, None, None, "string", "string") == 1.0
    assert score(spark, "a", None, "string", "string") == 0.0
    assert score(spark, 100.0, 100.5, "double", "double") == 0.8
    assert score(spark, 100.0, 101.0, "double", "double") == 0.0  # 1 % is no longer near
    assert score(spark, "100", "100.5", "string", "string") == 0.8
    assert score(spark, 45, 45.0, "int", "double") == 1.0
    assert score(spark, 45, "45.0", "int", "string") == 1.0
    assert score(spark, 45, 45.0, "int", "double", strict_text=True) == 0.8
    assert score(spark, 0, 0.0, "int", "double", strict_text=True) == 0.0
    day = dt.datetime(2023, 1, 15)
    assert score(spark, "2023-01-15", day, "string", "timestamp_ntz") == 0.0
    assert score(spark, "2023-01-15", day, "string", "timestamp_ntz", dates=True) == 1.0


def test_typed_literals(spark):
    schema = spark.range(1).select(
        F.lit(True).alias("b"), F.current_date().alias("d"), F.lit(1).cast("decimal(9,2)").alias("n")
    ).schema
    row = spark.range(1).select(
        typed_literal("true", schema["b"].dataType),
        typed_literal("2024-02-29", schema["d"].dataType),
        typed_literal("1.50", schema["n"].dataType),
    ).first()
    assert row[0] is True and row[1] == dt.date(2024, 2, 29) and float(row[2]) == 1.5
    with pytest.raises(ValueError):
        typed_literal("2024-02-30", schema["d"].dataType)


def test_java_replacement():
    assert text.java_replacement(r"$5 \1 \g<2>") == r"\$5 $1 $2"
