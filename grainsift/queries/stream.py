"""Queries that run a stream over all events and return what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import columns as C, rows as R, rules
from ..session import new_work_dir
from ..sources import dirty as D
from ..sources.tables import table, table_stream
from ..streaming import batches as B, streams as X
from ..streaming.fill import fill_forward_stream
from . import sql as S
from .registry import query


def _events(spark, folder):
    """Zone-less times become instants in the session zone and are cut into days there."""
    if spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        own, partitions = spark.newSession(), spark.conf.get("spark.sql.shuffle.partitions")
        own.conf.set("spark.sql.session.timeZone", "UTC")  # the caller's own zone stays as it is
        own.conf.set("spark.sql.shuffle.partitions", partitions)
        spark = own
    return table_stream(spark, folder, "events")


def _stored(spark, stream):
    spark, work = stream.sparkSession, new_work_dir(spark, "stream")
    X.append_to(stream, f"{work}/out", f"{work}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{work}/out")


@query("stream_clean", f"""WITH {S.EVENTS_DIRTY}
SELECT event_id, ts, user_id, upper(event_type) AS event_type,
  CASE WHEN value IS NOT NULL THEN greatest(least(value, 1000), 0) END AS value, props
FROM events_dirty WHERE event_type <> 'error'""")
def stream_clean(spark, folder):
    events = D.events_dirty_from(_events(spark, folder))
    kept = R.remove_rows(events, "event_type", "equals", "error")
    return _stored(spark, C.clip(C.standardize(kept, "event_type", "uppercase"), "value", 0, 1000))


@query("stream_dedup", "SELECT * FROM events")
def stream_dedup(spark, folder):
    events = _events(spark, folder)
    # every third event arrives twice
    twice = F.explode(F.sequence(F.lit(0), F.when(F.col("event_id") % 3 == 0, 1).otherwise(0)))
    repeated = events.withColumn("copy", twice).drop("copy")
    once = X.dedup_stream(repeated, ["event_id"], "ts", "2 hours")
    return _stored(spark, once.withColumn("ts", F.col("ts").cast("timestamp_ntz")))


@query("stream_quarantine", f"""WITH {S.EVENTS_DIRTY}
SELECT event_id, value, concat_ws(',', CASE WHEN value < 0 OR value > 1000 THEN '0' END,
  CASE WHEN value IS NULL THEN '1' END) AS violated_rules
FROM events_dirty WHERE value IS NULL OR value < 0 OR value > 1000""")
def stream_quarantine(spark, folder):
    events = D.events_dirty_from(_events(spark, folder))
    bad = rules.quarantine(events, D.EVENT_RULES)[1]
    as_text = F.concat_ws(",", F.transform("violated_rules", lambda i: i.cast("string")))
    return _stored(spark, bad.select("event_id", "value", as_text.alias("violated_rules")))


def _window_sql(rule_id: int, kind: str, checked: str, bad: str) -> str:
    return f"""SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, {rule_id} AS rule_id, '{kind}' AS type,
  'value' AS "column", {checked} AS checked, count(*) FILTER (WHERE {bad}) AS violations
FROM events_dirty GROUP BY 1"""


@query("stream_rules_by_window", f"""WITH {S.EVENTS_DIRTY}, c AS (
{_window_sql(0, 'range', 'count(value)', 'value < 0 OR value > 1000')} UNION ALL
{_window_sql(1, 'not_null', 'count(*)', 'value IS NULL')})
SELECT *, round((checked - violations) / CAST(checked AS DOUBLE), 6) AS pass_rate FROM c""")
def stream_rules_by_window(spark, folder):
    events = D.events_dirty_from(_events(spark, folder))
    counted = X.windowed_rule_counts(events, D.EVENT_RULES, "ts", "1 day")
    spark, work = counted.sparkSession, new_work_dir(spark, "stream")
    X.upsert_to(counted, f"{work}/out", f"{work}/checkpoint").awaitTermination()
    X.compact(spark, f"{work}/out", ["window_start", "rule_id"], f"{work}/compact")
    rows = X.latest(spark, f"{work}/compact", ["window_start", "rule_id"])
    return rows.withColumn("pass_rate", F.round("pass_rate", 6))


def _in_batches(spark, df, part, n=3):
    """The table as a stream of ``n`` batches: the rows with part = 0, 1, ... in turn."""
    folder = new_work_dir(spark, "arriving")
    for k in range(n):
        df.filter(part == k).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _written(spark, stream, writer_of):
    work = new_work_dir(spark, "batches")
    B.write_batches(stream, writer_of(f"{work}/out"), f"{work}/checkpoint").awaitTermination()
    return f"{work}/out"


@query("stream_both_halves", f"""WITH {S.EVENTS_DIRTY}
SELECT event_id, value, concat_ws(',', CASE WHEN value < 0 OR value > 1000 THEN '0' END,
  CASE WHEN value IS NULL THEN '1' END) AS violated_rules FROM events_dirty""")
def stream_both_halves(spark, folder):
    """Three batches split in one pass each; the halves together are the whole table."""
    events = D.events_dirty(spark, folder)
    out = _written(spark, _in_batches(spark, events, F.col("event_id") % 3), lambda p: B.quarantine_writer(p, D.EVENT_RULES))
    as_text = F.concat_ws(",", F.transform("violated_rules", lambda i: i.cast("string")))
    good = B.good_rows(spark, out).select("event_id", "value", F.lit("").alias("violated_rules"))
    return good.union(B.bad_rows(spark, out).select("event_id", "value", as_text.alias("violated_rules")))


@query("stream_rule_totals", f"""WITH {S.EVENTS_DIRTY},
c AS (SELECT 0 AS rule_id, 'range' AS type, 'value' AS "column", count(value) AS checked,
    count(*) FILTER (WHERE value < 0 OR value > 1000) AS violations FROM events_dirty
  UNION ALL SELECT 1, 'not_null', 'value', count(*), count(*) FILTER (WHERE value IS NULL) FROM events_dirty)
SELECT *, round((checked - violations) / CAST(checked AS DOUBLE), 6) AS pass_rate FROM c""")
def stream_rule_totals(spark, folder):
    """Counts observed while three batches were written, one row per batch and rule, summed."""
    events = D.events_dirty(spark, folder)
    out = _written(spark, _in_batches(spark, events, F.col("event_id") % 3), lambda p: B.quarantine_writer(p, D.EVENT_RULES))
    return B.rule_totals(spark, out).withColumn("pass_rate", F.round("pass_rate", 6))


@query("stream_duplicate_totals", f"""WITH {S.ORDERS_DIRTY}
SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates,
  CAST(coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS BIGINT) AS members, count(CASE WHEN n > 1 THEN 1 END) AS groups,
  round(sum(n - 1) * CAST(100 AS DOUBLE) / sum(n), 1) AS duplicate_pct
FROM (SELECT count(*) AS n FROM orders_dirty GROUP BY o_custkey, o_orderpriority, o_totalprice) AS t""")
def stream_duplicate_totals(spark, folder):
    """Copies that arrive in different batches are found from the keys of earlier ones."""
    orders, keys = D.orders_dirty(spark, folder), ["o_custkey", "o_orderpriority", "o_totalprice"]
    stream = _in_batches(spark, orders, F.pmod(F.col("o_orderkey"), F.lit(3)))
    return B.duplicate_totals(spark, _written(spark, stream, lambda p: B.dedup_writer(p, keys, ["o_orderkey"])))


@query("stream_dedup_first", """
SELECT o_custkey, o_orderstatus, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2""")
def stream_dedup_first(spark, folder):
    """The first order of each customer and status, over three batches in the order of the keys."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    top = orders.agg(F.max("o_orderkey")).first()[0] + 1
    stream = _in_batches(spark, orders, F.floor(F.col("o_orderkey") * 3 / top))
    out = _written(spark, stream, lambda p: B.dedup_writer(p, ["o_custkey", "o_orderstatus"], ["o_orderkey"]))
    return B.first_rows(spark, out).select("o_custkey", "o_orderstatus", "o_orderkey")


@query("stream_fill_forward", f"""WITH {S.EVENTS_DIRTY}
SELECT event_id, user_id, last_value(value IGNORE NULLS) OVER (
  PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value, false AS late FROM events_dirty""")
def stream_fill_forward(spark, folder):
    """Four batches in the order of time; the last value of each user is carried from batch to batch."""
    events = D.events_dirty(spark, folder).select("event_id", "ts", "user_id", "value")
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(second), F.max(second)).first()
    stream = _in_batches(spark, events, F.floor((second - low) * 4 / (high - low + 1)), 4)
    filled = fill_forward_stream(stream, "value", ["user_id"], "ts", ["event_id"])
    return _stored(spark, filled.drop("ts"))
