"""Queries on cleaning operators."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import numbers
from ..operators import columns as C, dedup, fill, ordinal, rows as R
from ..sources import dirty as D
from ..sources.tables import table
from . import sql as S
from .registry import query

WITH_ORDERS = f"WITH {S.ORDERS_DIRTY}"
BIG_OFFSET = 2**53 + 1  # keys beyond it are not all numbers of type DOUBLE
BIG = f"(o_orderkey + {BIG_OFFSET})"


def _big_keys(spark, folder):
    return table(spark, folder, "orders").withColumn("o_orderkey", F.col("o_orderkey") + BIG_OFFSET)


# --- filling -----------------------------------------------------------------


@query("fill_mean", f"""{WITH_ORDERS} SELECT * REPLACE (
  round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM orders_dirty)), 4) AS o_totalprice)
FROM orders_dirty""")
def fill_mean(spark, folder):
    filled = fill.fill_missing(D.orders_dirty(spark, folder), "o_totalprice", "mean")
    return filled.withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("fill_median", f"""{WITH_ORDERS} SELECT * REPLACE (
  round(coalesce(o_totalprice, (SELECT median(o_totalprice) FROM orders_dirty)), 4) AS o_totalprice)
FROM orders_dirty""")
def fill_median(spark, folder):
    filled = fill.fill_missing(D.orders_dirty(spark, folder), "o_totalprice", "median")
    return filled.withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("fill_mode", f"""{WITH_ORDERS}, m AS (
  SELECT o_orderpriority AS v FROM orders_dirty WHERE o_orderpriority IS NOT NULL
  GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT * REPLACE (coalesce(o_orderpriority, (SELECT v FROM m)) AS o_orderpriority) FROM orders_dirty""")
def fill_mode(spark, folder):
    return fill.fill_missing(D.orders_dirty(spark, folder), "o_orderpriority", "mode")


@query("fill_constant", f"""{WITH_ORDERS}
SELECT * REPLACE (coalesce(o_orderpriority, 'UNKNOWN') AS o_orderpriority) FROM orders_dirty""")
def fill_constant(spark, folder):
    return fill.fill_missing(D.orders_dirty(spark, folder), "o_orderpriority", "constant", "UNKNOWN")


@query("fill_forward", f"""{WITH_ORDERS}
SELECT * REPLACE (last_value(o_totalprice IGNORE NULLS) OVER (
  ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o_totalprice)
FROM orders_dirty""")
def fill_forward(spark, folder):
    return fill.fill_missing(
        D.orders_dirty(spark, folder), "o_totalprice", "forward_fill", order_by=["o_orderkey"]
    )


@query("fill_forward_per_user", f"""WITH {S.EVENTS_DIRTY}
SELECT * REPLACE (last_value(value IGNORE NULLS) OVER (
  PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value)
FROM events_dirty""")
def fill_forward_per_user(spark, folder):
    return fill.fill_missing(
        D.events_dirty(spark, folder), "value", "forward_fill",
        order_by=["event_id"], partition_by=["user_id"],
    )


@query("fill_report", f"""{WITH_ORDERS}
SELECT 'o_orderpriority' AS "column", count(*) - count(o_orderpriority) AS missing_before,
  count(*) - count(o_orderpriority) AS filled, CAST(0 AS BIGINT) AS remaining FROM orders_dirty""")
def fill_report(spark, folder):
    return fill.fill_report(D.orders_dirty(spark, folder), "o_orderpriority", "mode")


# --- duplicates --------------------------------------------------------------


@query("dedup_full", f"{WITH_ORDERS} SELECT DISTINCT * FROM orders_dirty")
def dedup_full(spark, folder):
    return dedup.remove_duplicates(D.orders_dirty(spark, folder))


def _first_sql(direction: str) -> str:
    return f"""{WITH_ORDERS} SELECT * EXCLUDE (n) FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey
    ORDER BY o_orderdate {direction}, o_orderkey {direction}) AS n FROM orders_dirty) AS t WHERE n = 1"""


@query("dedup_first", _first_sql("ASC"))
def dedup_first(spark, folder):
    return dedup.remove_duplicates(
        D.orders_dirty(spark, folder), ["o_custkey"], "first", ["o_orderdate", "o_orderkey"]
    )


@query("dedup_last", _first_sql("DESC"))
def dedup_last(spark, folder):
    return dedup.remove_duplicates(
        D.orders_dirty(spark, folder), ["o_custkey"], "last", ["o_orderdate", "o_orderkey"]
    )


@query("dedup_none", f"""{WITH_ORDERS} SELECT o.* FROM orders_dirty o JOIN (
  SELECT o_custkey, o_orderpriority FROM orders_dirty GROUP BY 1, 2 HAVING count(*) = 1) u
ON o.o_custkey = u.o_custkey AND o.o_orderpriority IS NOT DISTINCT FROM u.o_orderpriority""")
def dedup_none(spark, folder):
    return dedup.remove_duplicates(
        D.orders_dirty(spark, folder), ["o_custkey", "o_orderpriority"], "none"
    )


# --- casts -------------------------------------------------------------------

_PRICE_NUMBER = S.number(S.stripped("price_text"))


@query("cast_int", f"""{WITH_ORDERS}
SELECT * REPLACE (CAST({_PRICE_NUMBER} AS BIGINT) AS price_text) FROM orders_dirty""")
def cast_int(spark, folder):
    return C.fix_dtype(D.orders_dirty(spark, folder), "price_text", "int")


@query("cast_float", f"""{WITH_ORDERS}
SELECT * REPLACE ({_PRICE_NUMBER} AS price_text) FROM orders_dirty""")
def cast_float(spark, folder):
    return C.fix_dtype(D.orders_dirty(spark, folder), "price_text", "float")


@query("cast_string", f"""{WITH_ORDERS}
SELECT * REPLACE (CAST(o_custkey AS VARCHAR) AS o_custkey) FROM orders_dirty""")
def cast_string(spark, folder):
    return C.fix_dtype(D.orders_dirty(spark, folder), "o_custkey", "str")


@query("cast_datetime", f"""{WITH_ORDERS}
SELECT * REPLACE ({S.parsed_date('date_text')} AS date_text) FROM orders_dirty""")
def cast_datetime(spark, folder):
    return C.fix_dtype(D.orders_dirty(spark, folder), "date_text", "datetime")


@query("cast_errors", f"""{WITH_ORDERS}
SELECT 'price_text' AS "column", 'int' AS target, count(price_text) AS non_null,
  count(*) FILTER (WHERE price_text IS NOT NULL AND ({_PRICE_NUMBER}) IS NULL) AS coercion_errors
FROM orders_dirty""")
def cast_errors(spark, folder):
    return C.coercion_report(D.orders_dirty(spark, folder), "price_text", "int")


@query("numeric_or_null", f"""{WITH_ORDERS}
SELECT o_orderkey, {S.number('price_text')} AS price FROM orders_dirty""")
def numeric_or_null(spark, folder):
    orders = D.orders_dirty(spark, folder)
    return orders.select("o_orderkey", numbers.number(orders, "price_text").alias("price"))


# --- replacing and standardising ---------------------------------------------


@query("replace_exact", """
SELECT * REPLACE (CASE WHEN p_brand = 'Brand#1' THEN 'Brand#01' ELSE p_brand END AS p_brand) FROM part""")
def replace_exact(spark, folder):
    return C.replace_value(table(spark, folder, "part"), "p_brand", "Brand#1", "Brand#01")


@query("replace_map", """
SELECT * REPLACE (CASE p_type WHEN 'ECONOMY' THEN 'STANDARD' WHEN 'STANDARD' THEN 'ECONOMY'
  ELSE p_type END AS p_type) FROM part""")
def replace_map(spark, folder):
    swap = {"ECONOMY": "STANDARD", "STANDARD": "ECONOMY"}
    return C.replace_values(table(spark, folder, "part"), "p_type", swap)


@query("regex_replace", r"""
SELECT * REPLACE (regexp_replace(c_name, '([A-Za-z]+)#0*(\d)', '\1 $\2', 'g') AS c_name) FROM customer""")
def regex_replace(spark, folder):
    return C.regex_replace(
        table(spark, folder, "customer"), "c_name", r"([A-Za-z]+)#0*(\d)", r"\1 $\2"
    )


@query("regex_replace_text", r"""
SELECT * REPLACE (regexp_replace(text, '\s+', ' ', 'g') AS text) FROM documents""")
def regex_replace_text(spark, folder):
    return C.regex_replace(table(spark, folder, "documents"), "text", r"\s+", " ")


@query("cells_changed", r"""
SELECT 'c_name' AS "column", count(*) AS rows,
  count(*) FILTER (WHERE regexp_replace(c_name, '#00*', '#', 'g') <> c_name) AS changed FROM customer""")
def cells_changed(spark, folder):
    return C.change_report(
        table(spark, folder, "customer"), "c_name", F.regexp_replace("c_name", "#00*", "#")
    )


@query("std_lower", "SELECT * REPLACE (lower(c_name) AS c_name) FROM customer")
def std_lower(spark, folder):
    return C.standardize(table(spark, folder, "customer"), "c_name", "lowercase")


@query("std_upper", "SELECT * REPLACE (upper(p_name) AS p_name) FROM part")
def std_upper(spark, folder):
    return C.standardize(table(spark, folder, "part"), "p_name", "uppercase")


def _title_sql(column: str) -> str:
    runs = f"regexp_extract_all({column}, '(\\p{{L}}+|[^\\p{{L}}]+)', 1)"
    return f"array_to_string(list_transform({runs}, lambda x: upper(left(x, 1)) || lower(substr(x, 2))), '')"


@query("std_title", f"{WITH_ORDERS} SELECT * REPLACE ({_title_sql('o_orderpriority')} AS o_orderpriority) FROM orders_dirty")
def std_title(spark, folder):
    return C.standardize(D.orders_dirty(spark, folder), "o_orderpriority", "titlecase")


@query("std_strip", f"{WITH_ORDERS} SELECT * REPLACE ({S.strip('o_orderpriority')} AS o_orderpriority) FROM orders_dirty")
def std_strip(spark, folder):
    return C.standardize(D.orders_dirty(spark, folder), "o_orderpriority", "strip")


@query("std_consolidation", f"""{WITH_ORDERS}
SELECT 'o_orderpriority' AS "column", count(DISTINCT o_orderpriority) AS before,
  count(DISTINCT upper(o_orderpriority)) AS after,
  count(DISTINCT o_orderpriority) - count(DISTINCT upper(o_orderpriority)) AS consolidated
FROM orders_dirty""")
def std_consolidation(spark, folder):
    return C.consolidation_report(D.orders_dirty(spark, folder), "o_orderpriority", "uppercase")


# --- removing rows, clipping, columns, order ---------------------------------


def _remove(condition: str, value: object, column: str = "o_totalprice"):
    return lambda spark, folder: R.remove_rows(D.orders_dirty(spark, folder), column, condition, value)


def _kept_sql(removed: str) -> str:
    return f"{WITH_ORDERS} SELECT * FROM orders_dirty WHERE NOT coalesce({removed}, false)"


query("rows_remove_equals", _kept_sql("o_orderstatus = 'F'"))(_remove("equals", "F", "o_orderstatus"))
query("rows_remove_not_equals", f"{WITH_ORDERS} SELECT * FROM orders_dirty WHERE o_orderpriority = '5-LOW'")(
    _remove("not_equals", "5-LOW", "o_orderpriority"))
query("rows_remove_less_than", _kept_sql("o_totalprice < 1000"))(_remove("less_than", 1000))
query("rows_remove_greater_than", _kept_sql("o_totalprice > 500000"))(_remove("greater_than", 500000))
query("rows_remove_contains", _kept_sql("regexp_matches(o_orderpriority, 'urg|high', 'i')"))(
    _remove("contains", "urg|high", "o_orderpriority"))


@query("clip_range", f"""WITH {S.EVENTS_DIRTY}
SELECT * REPLACE (CASE WHEN value IS NOT NULL THEN greatest(least(value, 1000), 0) END AS value)
FROM events_dirty""")
def clip_range(spark, folder):
    return C.clip(D.events_dirty(spark, folder), "value", 0, 1000)


@query("clip_report", f"""WITH {S.EVENTS_DIRTY}
SELECT 'value' AS "column", count(*) FILTER (WHERE value < 0 OR value > 1000) AS clipped FROM events_dirty""")
def clip_report(spark, folder):
    return C.clip_report(D.events_dirty(spark, folder), "value", 0, 1000)


@query("rename_column", f"{WITH_ORDERS} SELECT * RENAME (price_text AS price) FROM orders_dirty")
def rename_column(spark, folder):
    return C.rename_column(D.orders_dirty(spark, folder), "price_text", "price")


@query("drop_column", f"{WITH_ORDERS} SELECT * EXCLUDE (date_text) FROM orders_dirty")
def drop_column(spark, folder):
    return C.drop_column(D.orders_dirty(spark, folder), "date_text")


@query("view_head", f"{WITH_ORDERS} SELECT * FROM orders_dirty ORDER BY o_orderkey, o_totalprice LIMIT 10")
def view_head(spark, folder):
    return R.view_rows(D.orders_dirty(spark, folder), 10, ["o_orderkey"])


@query("sort_nulls_last", f"""{WITH_ORDERS} SELECT *,
  row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey DESC) - 1 AS position
FROM orders_dirty""")
def sort_nulls_last(spark, folder):
    # the position is what makes the order visible in an unordered comparison
    orders = D.orders_dirty(spark, folder)
    placed = ordinal.with_ordinal(
        orders, ["o_totalprice", "o_orderkey"], "position", descending=True
    )
    return R.sort_rows(placed, "o_totalprice", "desc", ["o_orderkey"])


@query("rows_remove_before_date", "SELECT * FROM orders WHERE NOT o_orderdate < TIMESTAMP '1998-01-01'")
def rows_remove_before_date(spark, folder):
    return R.remove_rows(table(spark, folder, "orders"), "o_orderdate", "less_than", "1998-01-01")


@query("clip_bigint", f"""
SELECT * REPLACE (greatest(least(CAST({BIG} AS BIGINT), 9007199254760001), 9007199254741003) AS o_orderkey) FROM orders""")
def clip_bigint(spark, folder):
    return C.clip(_big_keys(spark, folder), "o_orderkey", 9007199254741003, 9007199254760001)


@query("fill_median_bigint", f"""
WITH b AS (SELECT * REPLACE (CASE WHEN o_orderkey % 10 <> 3 THEN CAST({BIG} AS BIGINT) END AS o_orderkey) FROM orders)
SELECT * REPLACE (coalesce(CAST(o_orderkey AS DECIMAL(29,10)),
  CAST(CAST((SELECT quantile_cont(CAST(o_orderkey AS DOUBLE), 0.5) FROM b) AS BIGINT) AS DECIMAL(29,10))) AS o_orderkey) FROM b""")
def fill_median_bigint(spark, folder):
    orders = table(spark, folder, "orders")
    gaps = orders.withColumn("o_orderkey", F.when(F.col("o_orderkey") % 10 != 3, F.col("o_orderkey") + BIG_OFFSET))
    return fill.fill_missing(gaps, "o_orderkey", "median")


@query("sort_rows", f"""{WITH_ORDERS}
SELECT * FROM orders_dirty ORDER BY o_totalprice DESC NULLS LAST, o_orderkey DESC""")
def sort_rows(spark, folder):
    return R.sort_rows(D.orders_dirty(spark, folder), "o_totalprice", "desc", ["o_orderkey"])


@query("row_ordinal_ties", """
SELECT *, min(position) OVER (PARTITION BY o_orderdate) AS first_of_day,
  max(position) OVER (PARTITION BY o_orderdate) AS last_of_day
FROM (SELECT o_orderdate, row_number() OVER (ORDER BY o_orderdate) - 1 AS position FROM orders) AS p""")
def row_ordinal_ties(spark, folder):
    """Many buckets and tied keys: positions of each day, whatever rows they belong to."""
    placed = ordinal.with_ordinal(table(spark, folder, "orders"), ["o_orderdate"], "position", rows_per_bucket=500)
    day = Window.partitionBy("o_orderdate")
    return placed.select("o_orderdate", "position", F.min("position").over(day).alias("first_of_day"),
                         F.max("position").over(day).alias("last_of_day"))


@query("row_ordinal_copies", f"""{WITH_ORDERS}
SELECT *, row_number() OVER (ORDER BY o_orderstatus, o_custkey % 3, o_orderkey) - 1 AS position
FROM (SELECT o_orderstatus, o_custkey % 3 AS o_custkey, CAST(1 AS BIGINT) AS o_orderkey FROM orders_dirty) AS d""")
def row_ordinal_copies(spark, folder):
    """A few rows with thousands of complete copies each, over many buckets."""
    few = D.orders_dirty(spark, folder).select(
        "o_orderstatus", (F.col("o_custkey") % 3).alias("o_custkey"), F.lit(1).cast("bigint").alias("o_orderkey"))
    return ordinal.with_ordinal(few, ["o_orderstatus", "o_custkey"], "position", rows_per_bucket=400)


@query("fill_forward_ties", "SELECT event_id, user_id FROM events")
def fill_forward_ties(spark, folder):
    """Equal order keys in many buckets: a table filled from two partitionings is the same."""
    events = table(spark, folder, "events").withColumn("v", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    filled = [ordinal.forward_fill_column(e, "v", ["user_id"], rows_per_bucket=n)
              for e, n in ((events, 300), (events.repartition(7, "props"), 900))]
    both = filled[0].select("event_id", "user_id", F.col("v").alias("a")).join(
        filled[1].select("event_id", F.col("v").alias("b")), "event_id")
    return both.filter(F.col("a").eqNullSafe(F.col("b"))).select("event_id", "user_id")


@query("row_ordinal", """
SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS _ord FROM orders""")
def row_ordinal(spark, folder):
    return ordinal.with_ordinal(table(spark, folder, "orders"), ["o_orderdate", "o_orderkey"])
