import pytest
from pyspark.sql import functions as F

from grainsift.operators import columns as C, dedup, rules as R
from grainsift.plans import recipe
from grainsift.plans.recipe import custom, step
from grainsift.session import new_work_dir, shared_dir
from grainsift.sources import dirty as D
from grainsift.sources.tables import table, table_stream
from grainsift.streaming import streams as X

from sample_tables import SF

STEPS = [
    step("profile"),
    step("standardize", column="p", method="strip"),
    step("remove_rows", column="x", condition="less_than", value=0),
    step("fill_missing", column="p", strategy="constant", value="none"),
    step("rename_column", old="p", new="q"),
]


def small(spark):
    return spark.createDataFrame([(1, " a", -1.0), (2, "b", 5.0), (3, None, 7.0)], "k int, p string, x double")


def test_run_and_undo(spark, rows_of):
    df = small(spark)
    assert rows_of(recipe.run(df, STEPS)) == [(2, "b", 5.0), (3, "none", 7.0)]
    assert recipe.run(df, STEPS).columns == ["k", "q", "x"]
    assert rows_of(recipe.run(df, recipe.undo(STEPS, 2))) == [(2, "b", 5.0), (3, None, 7.0)]
    assert recipe.undo(STEPS[:1]) == STEPS[:1]
    undone = [*STEPS, step("undo"), step("undo"), step("undo"), step("undo"), step("undo")]
    assert rows_of(recipe.run(df, undone)) == rows_of(df)
    assert rows_of(recipe.run(df, STEPS, materialize_after=["remove_rows"])) == rows_of(recipe.run(df, STEPS))


def test_log(spark):
    log = [tuple(r) for r in recipe.lineage(small(spark), STEPS).drop("command").orderBy("step").collect()]
    assert log == [
        (1, "profile", False, 3, 3, 0),
        (2, "standardize", True, 3, 3, 1),
        (3, "remove_rows", True, 3, 2, 0),
        (4, "fill_missing", True, 2, 2, 1),
        (5, "rename_column", True, 2, 2, 0),
    ]
    summary = recipe.lineage_summary(recipe.lineage(small(spark), STEPS)).first()
    assert tuple(summary) == (5, 1, 4, 0, -1)


def test_run_with_log_shares_materialised_tables(spark, rows_of):
    result, log = recipe.run_with_log(small(spark), STEPS, materialize_after=["remove_rows"])
    assert rows_of(result) == rows_of(recipe.run(small(spark), STEPS))
    assert rows_of(log) == rows_of(recipe.lineage(small(spark), STEPS))


def test_log_with_branches_after_undo(spark):
    steps = [
        step("clip", column="x", lower=0, upper=6),
        step("undo"),
        step("clip", column="x", lower=0, upper=100),
        step("fix_dtype", column="x", target="int"),
        step("replace", column="p", old="zzz", new="y"),
        custom("double", lambda df: df.unionAll(df)),
    ]
    log = [tuple(r) for r in recipe.lineage(small(spark), steps).drop("command").orderBy("step").collect()]
    assert log == [
        (1, "clip", True, 3, 3, 2),
        (2, "undo", True, 3, 3, 0),
        (3, "clip", True, 3, 3, 1),
        (4, "fix_dtype", True, 3, 3, 0),  # 0.0, 5.0 and 7.0 keep their value
        (5, "replace", False, 3, 3, 0),
        (6, "double", True, 3, 6, None),
    ]


def test_log_of_an_undo_of_nothing(spark):
    steps = [step("undo"), step("remove_rows", column="x", condition="less_than", value=0), step("undo"), step("undo")]
    log = [tuple(r) for r in recipe.lineage(small(spark), steps).drop("command").orderBy("step").collect()]
    assert log == [
        (1, "undo", False, 3, 3, 0),
        (2, "remove_rows", True, 3, 2, 0),
        (3, "undo", True, 2, 3, 0),
        (4, "undo", False, 3, 3, 0),
    ]


def test_json_and_unknown_operations(spark):
    steps = recipe.steps_from_json('[{"op": "drop_column", "column": "x"}, {"op": "view"}]')
    assert recipe.run(small(spark), steps).columns == ["k", "p"]
    with pytest.raises(ValueError, match="unknown operation"):
        recipe.run(small(spark), [step("explode_everything")])
    with pytest.raises(ValueError):
        recipe.lineage(small(spark), [])
    assert recipe.run(small(spark), []).count() == 3


def test_shared_dir_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert new_work_dir(spark, "a") != new_work_dir(spark, "a")


# --- streams -----------------------------------------------------------------


def drain(spark, stream):
    work = new_work_dir(spark, "test")
    X.append_to(stream, f"{work}/out", f"{work}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{work}/out")


def test_cleaning_a_stream_equals_cleaning_the_table(spark, rows_of):
    def clean(df):
        dirty = D.events_dirty_from(df)
        return C.clip(C.standardize(dirty, "event_type", "titlecase"), "value", 0, 100)

    streamed = drain(spark, clean(table_stream(spark, SF, "events")))
    assert rows_of(streamed) == rows_of(clean(table(spark, SF, "events")))


def test_stream_dedup_equals_batch(spark, rows_of):
    events = table_stream(spark, SF, "events").drop("props")
    repeated = events.withColumn("n", F.explode(F.sequence(F.lit(0), F.col("event_id") % 2))).drop("n")
    once = drain(spark, X.dedup_stream(repeated, ["event_id"], "ts"))
    batch = dedup.remove_duplicates(table(spark, SF, "events").drop("props"))
    assert rows_of(once.withColumn("ts", F.col("ts").cast("timestamp_ntz"))) == rows_of(batch)


def test_windowed_rules_over_several_batches(spark, rows_of):
    """The same windows are updated by later files; the newest row of each wins."""
    source = new_work_dir(spark, "events")
    events = D.events_dirty(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    for part in range(3):
        events.filter(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    counted = X.windowed_rule_counts(stream, D.EVENT_RULES, "ts", "1 day", "60 days")
    work = new_work_dir(spark, "test")
    X.upsert_to(counted, f"{work}/out", f"{work}/checkpoint").awaitTermination()
    got = X.latest(spark, f"{work}/out", ["window_start", "rule_id"])
    assert spark.read.parquet(f"{work}/out").select("batch_id").distinct().count() == 3
    total = got.groupBy("rule_id").agg(F.sum("checked"), F.sum("violations"))
    report = R.rules_report(events, D.EVENT_RULES).select("rule_id", "checked", "violations")
    assert rows_of(total) == rows_of(report)


def test_work_folders_are_deleted_on_request(spark, rows_of):
    from grainsift.session import delete_folders, materialized, work_folders

    before = len(work_folders())
    first = materialized(small(spark), "one")
    second = materialized(first, "two")
    one, two = work_folders()[before:]
    delete_folders(spark, [one, one, "/tmp/never-made-here"])
    assert rows_of(second) == rows_of(small(spark)) and work_folders()[before:] == [two]
    assert not any(one in f for f in second.inputFiles())
