import pytest
from pyspark.sql import functions as F

from grainsift.operators import columns as C, dedup, inject as I, rules as R
from grainsift.sources import dirty as D
from grainsift.sources.scenarios import SCENARIOS, prepare
from grainsift.sources.tables import from_rows, table

from sample_tables import SF


def people(spark):
    return spark.createDataFrame(
        [("a@x.org", 30.0, 1, 2), ("no mail", -5.0, 3, 2), (None, None, 2, 2), ("b@y.com", 130.0, None, 1)],
        "email string, age double, hi int, lo int",
    )


RULES = [
    R.rule_from_dict({"type": "range", "column": "age", "min": 0, "max": 120}),
    R.rule_from_dict({"type": "not_null", "column": "email", "description": "needed"}),
    R.rule_from_dict({"type": "pattern", "column": "email", "pattern": r".*@.*\..*"}),
    R.rule_from_dict({"type": "cross_column", "column_a": "hi", "column_b": "lo", "relation": "greater_than"}),
    R.rule_from_dict({"type": "categorical", "column": "email", "allowed_values": ["a@x.org"]}),
    R.not_null("absent"),
]


def test_report_counts(spark):
    rows = {r["rule_id"]: r for r in R.rules_report(people(spark), RULES).collect()}
    assert [(rows[i]["checked"], rows[i]["violations"]) for i in range(6)] == [
        (3, 2), (4, 1), (3, 1), (3, 2), (3, 2), (0, 0)]
    assert rows[4]["bad_values"] == 2 and rows[0]["bad_values"] is None
    assert rows[5]["pass_rate"] is None
    assert R.rules_report(people(spark), RULES, only_violated=True).count() == 5


def test_compliance(spark):
    got = R.rules_compliance(people(spark), RULES).first()[0]
    assert got == pytest.approx((1 / 3 + 3 / 4 + 2 / 3 + 1 / 3 + 1 / 3 + 0) / 6)
    assert R.rules_compliance(people(spark), []).first()[0] == 0.8
    empty = people(spark).limit(0)
    assert R.rules_compliance(empty, RULES).first()[0] == pytest.approx(1 / 6)


def test_pattern_is_anchored_at_the_start_only(spark):
    df = spark.createDataFrame([("ab12x",), ("x ab12",), (None,)], "c string")
    assert R.rules_report(df, [R.pattern("c", "ab|zz")]).first()["violations"] == 1


@pytest.mark.parametrize("relation, bad", [
    ("greater_than", 2), ("greater_or_equal", 1), ("less_than", 2), ("less_or_equal", 1),
    ("equal", 2), ("not_equal", 1)])
def test_relations(spark, relation, bad):
    df = spark.createDataFrame([(1, 2), (2, 2), (3, 2), (None, 2)], "a int, b int")
    assert R.rules_report(df, [R.cross_column("a", "b", relation)]).first()["violations"] == bad


def test_unknown_relation_and_kind(spark):
    with pytest.raises(ValueError):
        R.rules_report(people(spark), [R.cross_column("hi", "lo", "near")])
    with pytest.raises(ValueError):
        R.rules_report(people(spark), [R.Rule("magic", "age")])


def test_quarantine_splits_all_rows(spark):
    good, bad = R.quarantine(people(spark), RULES)
    assert good.columns == people(spark).columns
    assert [r["email"] for r in good.collect()] == ["a@x.org"] or good.count() + bad.count() == 4
    broken = {r["email"]: r["violated_rules"] for r in bad.collect()}
    assert broken["no mail"] == [0, 2, 4] and broken[None] == [1, 3]


def test_invalid_categories_against_a_table(spark, rows_of):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "c string")
    allowed = spark.createDataFrame([("a",), ("z",)], "v string")
    assert rows_of(R.invalid_categories(df, "c", allowed)) == [("b", 2)]
    assert rows_of(R.invalid_categories(df, "c", ["a"])) == [("b", 2)]


# --- injection ---------------------------------------------------------------


def test_copies_then_dedup_restore_the_table(spark, rows_of):
    orders = table(spark, SF, "orders")
    dirty = I.inject_duplicates(orders, "o_orderkey", 0.2)
    assert dirty.count() > orders.count()
    assert rows_of(dedup.remove_duplicates(dirty)) == rows_of(orders)


def test_dates_and_their_repair(spark, rows_of):
    orders = table(spark, SF, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("d"))
    made = I.inject(orders, "o_orderkey", [I.date_formats("d", 0.5, ["dd/MM/yyyy", "MM-dd-yyyy", "dd MMM yyyy"])])
    assert made.issues.count() > 300
    repaired = C.fix_dtype(made.table, "d", "datetime").withColumn("d", F.col("d").cast("date").cast("string"))
    assert rows_of(repaired) == rows_of(orders)


def test_sign_flip_and_abs(spark, rows_of):
    events = table(spark, SF, "events").select("event_id", "value")
    dirty = I.inject(events, "event_id", [I.sign_flip("value", 0.3)]).table
    assert dirty.filter("value < 0").count() > 0
    assert rows_of(dirty.withColumn("value", F.abs("value"))) == rows_of(events)


def test_selection_does_not_depend_on_partitioning(spark, rows_of):
    events = table(spark, SF, "events")
    errors = [I.nulls("value", 0.1), I.outliers("value", 0.1, 1e4, 2e4)]
    a = I.inject(events, "event_id", errors, 7, duplicate_rate=0.1)
    b = I.inject(events.repartition(5), "event_id", errors, 7, duplicate_rate=0.1)
    assert rows_of(a.table) == rows_of(b.table) and rows_of(a.issues) == rows_of(b.issues)
    other = I.inject(events, "event_id", errors, 8, duplicate_rate=0.1)
    assert rows_of(a.table) != rows_of(other.table)


def test_issues_explain_every_difference(spark):
    events = table(spark, SF, "events").select("event_id", "value", "event_type")
    errors = [I.nulls("event_type", 0.2), I.respell("event_type", 0.2, [F.upper]), I.sign_flip("value", 0.1)]
    made = I.inject(events, "event_id", errors)
    both = made.table.alias("d").join(events.alias("c"), "event_id")
    for column in ("value", "event_type"):
        changed = both.filter(~F.col(f"d.{column}").eqNullSafe(F.col(f"c.{column}"))).count()
        noted = made.issues.filter(F.col("column") == column).select("row_key").distinct().count()
        assert changed == noted > 0
    assert made.table.schema == events.schema


def test_copies_first_leaves_copies_clean(spark):
    events = table(spark, SF, "events").select("event_id", "value")
    made = I.inject(events, "event_id", [I.sign_flip("value", 1.0)], duplicate_rate=0.5, copies_first=True)
    twice = made.table.groupBy("event_id").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    assert twice.filter("n = 2 AND NOT (lo < 0 AND hi > 0)").count() == 0


def test_typos_only_hit_listed_values(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 2 == 0, "Chicago").otherwise("Boston").alias("city"))
    made = I.inject(df, "id", [I.variants("city", 1.0, {"Chicago": ["chicgo", "Chcago"]})])
    values = {r[0]: r[1] for r in made.table.groupBy("city").count().collect()}
    assert values["Boston"] == 250 and set(values) == {"Boston", "chicgo", "Chcago"}


def test_near_copies(spark):
    df = spark.range(400).select("id", F.lit("Ann Bell").alias("name")).unionByName(
        spark.createDataFrame([(1000, None), (1001, "Cher")], "id bigint, name string"))
    made = I.inject_near_duplicates(df, "id", "name", 1.0, lambda k: k + 5000)
    names = {r[0] for r in made.table.filter("id >= 5000").select("name").collect()}
    assert names == {"A. Bell", "Ann  Bell", "ann bell", "Ann Bel"}
    assert made.table.count() == 802 and made.issues.count() == 400


def test_odd_rows(spark):
    customers = table(spark, SF, "customer")
    odd = [{"c_custkey": -1, "c_name": "Null Fisher"}]
    grown = I.add_odd_rows(customers, odd)
    assert tuple(I.surviving_rows(grown, odd, "c_custkey").first()) == (1, 1)
    assert tuple(I.surviving_rows(customers, odd, "c_custkey").first()) == (1, 0)
    with pytest.raises(ValueError):
        I.add_odd_rows(customers, [{"nope": 1}])


def test_golden_choice_is_stable(spark, rows_of):
    orders = table(spark, SF, "orders")
    a, b = I.pick_golden(orders, "o_orderkey", 8), I.pick_golden(orders.repartition(4), "o_orderkey", 8)
    assert a.count() == 8 and rows_of(a) == rows_of(b)


def _clean_table(spark, name):
    i = F.col("id")
    base = spark.range(2000)
    if name == "customer_records":
        return base.select(
            i.alias("customer_id"), F.concat(F.lit("P "), i.cast("string")).alias("name"), F.format_string("p%d@x.org", i).alias("email"),
            (i % 80).alias("age"), F.lit("Chicago").alias("city"), F.lit("2023-01-15").alias("signup_date"))
    if name == "sales_transactions":
        return base.select(
            F.format_string("TXN-%d", i).alias("transaction_id"), F.lit("Display").alias("category"),
            (i % 900 + 10).cast("double").alias("price"), (i % 20 + 1).alias("quantity"),
            F.lit("2023-03-04").alias("date"), F.lit("North").alias("region"))
    return base.select(
        F.format_string("PAT-%d", i).alias("patient_id"), F.lit("Ann Bell").alias("name"),
        F.lit("1980-05-06").alias("dob"), F.when(i % 2 == 0, "Male").otherwise("Female").alias("gender"),
        F.lit("A+").alias("blood_type"), F.lit(170.0).alias("height_cm"), F.lit(75.0).alias("weight_kg"),
        (i % 60 + 100).alias("bp_systolic"), F.lit(70).cast("bigint").alias("bp_diastolic"),
        F.lit("Asthma").alias("diagnosis"), F.lit("Albuterol").alias("medication"), F.lit("2024-02-03").alias("visit_date"))


@pytest.mark.parametrize("name", SCENARIOS)
def test_scenarios(spark, name):
    clean = _clean_table(spark, name)
    made = prepare(clean, name)
    assert R.rules_compliance(clean, made.scenario.rules).first()[0] == 1.0
    assert R.rules_compliance(made.dirty, made.scenario.rules).first()[0] < 1.0
    assert made.dirty.columns == clean.columns and made.dirty.count() > clean.count()
    assert made.golden.count() == made.scenario.golden_rows
    kinds = {r[0] for r in made.issues.select("kind").distinct().collect()}
    assert kinds == {i.kind for i in made.scenario.injections} | {"duplicate"} | (
        {"near_duplicate"} if made.scenario.near_duplicate_name else set())
    with pytest.raises(ValueError):
        prepare(clean, "no such scenario")


def test_dirty_orders_have_the_specified_errors(spark):
    d = D.orders_dirty(spark, "/root/testdata/sf0.01")
    row = d.agg(
        F.count("*"), F.count_if(F.col("o_totalprice").isNull()), F.count_if(F.col("o_orderpriority").isNull()),
        F.count_if((F.col("o_totalprice") < 0) | (F.col("o_totalprice") > 500000)),
        F.count_if(F.col("price_text").startswith("$")), F.count_if(F.col("price_text") == "n/a"),
        F.count_distinct("o_orderpriority"))
    assert tuple(row.first()) == (16250, 1500, 856, 426, 976, 396, 15)


def test_from_rows(spark):
    df = from_rows(spark, [{"a": 1}, {"b": "x"}], "a int, b string")
    assert [tuple(r) for r in df.collect()] == [(1, None), (None, "x")]


def test_rules_keep_types(spark):
    big = 2**53
    df = spark.sql(f"""SELECT CAST({big} + id AS BIGINT) AS n, CAST({big} + id AS DECIMAL(38,0)) AS d,
      DATE'2024-01-01' + CAST(id AS INT) AS a, '2024-01-02 00:00:00' AS b, array(id) AS xs FROM range(3)""")
    counts = lambda rule: tuple(R.rules_report(df, [rule]).select("checked", "violations").first())
    assert counts(R.value_range("n", high=big)) == (3, 2) and counts(R.value_range("d", low=big + 1)) == (3, 1)
    assert counts(R.value_range("a", "2024-01-02", "2024-01-02")) == (3, 2)
    assert counts(R.cross_column("a", "b", "greater_or_equal")) == (3, 1)
    for rule in (R.value_range("xs", 0, 1), R.cross_column("a", "n"), R.value_range("a", 1, 2)):
        with pytest.raises(ValueError):
            R.rules_report(df, [rule])


def test_no_odd_rows(spark):
    df = spark.range(3)
    assert I.add_odd_rows(df, []) is df
