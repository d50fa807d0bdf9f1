"""SQL functions give what the column expressions give."""

from pyspark.sql import functions as F

from grainsift.functions import dates, numbers, sql_functions, text
from grainsift.operators import rules

ODD = [None, "", " 5 ", "1e5", ".5", "5.", "1d", "1_000", "inf", "NaN", "1e999", "$1,234.50", "-", "a'b\\c", " x y　", "usb-c hub o'neil 3rd éa",
       "2023-01-15", "15/01/2023", "01-15-2023", "15 Jan 2023", "2023-13-45", "2023-01-15 10:20:30", " 2023-01-15T10:20:30 ", "2023-1-5", "ÀB çd"]


def test_functions_equal_expressions(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string")
    names = sql_functions.register(spark)
    assert names == ["gs_number_or_null", "gs_number_in_text", "gs_strip", "gs_title", "gs_parse_time"]
    assert sql_functions.register(spark) == names  # again
    df.createOrReplaceTempView("odd")
    got = spark.sql("SELECT i, " + ", ".join(f"{n}(t) AS c{k}" for k, n in enumerate(names)) + " FROM odd ORDER BY i").collect()
    t = F.col("t")
    stripped = F.regexp_replace(t, numbers.NON_NUMBER_CHARS, "")
    wanted = df.select("i", numbers.parse_number(t).alias("c0"), numbers.parse_number(stripped).alias("c1"), text.strip(t).alias("c2"),
                       text.title(t).alias("c3"), dates.parse_timestamp(t).alias("c4")).orderBy("i").collect()
    assert list(map(tuple, got)) == list(map(tuple, wanted))
    assert got[2].c0 == 5.0 and got[6].c0 is None and got[11].c1 == 1234.5 and got[15].c3 == "Usb-C Hub O'Neil 3Rd Éa"
    own = sql_functions.register(spark, "other_")
    assert spark.sql(f"SELECT {own[2]}(' a ')").first()[0] == "a"


def test_report_function(spark, rows_of, capsys):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (9, "c"), (30, None)], "x int, t string")
    report = rules.rules_report(df, [rules.value_range("x", 0, 10), rules.not_null("t"), rules.not_null("x"), rules.pattern("t", "[a-z]")])
    sql_functions.register_report(report, "my_report")
    every = spark.sql("SELECT * FROM my_report()")
    assert rows_of(every) == rows_of(report)
    assert rows_of(spark.sql("SELECT rule_id FROM my_report(0.7D)")) == [(0,)]
    df.limit(0).createOrReplaceTempView("my_report_other")
    every.explain()
    assert "Python" not in capsys.readouterr().out
