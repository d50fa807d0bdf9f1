"""Queries on error injection and scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inject as I
from ..sources import dirty as D
from ..sources.scenarios import Scenario, prepare
from ..sources.tables import table
from . import sql as S
from .registry import query

SEED = 42


@query("orders_dirty_view", f"WITH {S.ORDERS_DIRTY} SELECT * FROM orders_dirty")
def orders_dirty_view(spark, folder):
    return D.orders_dirty(spark, folder)


@query("inject_nulls", f"""
SELECT o_orderkey, o_custkey, o_orderstatus,
  CASE WHEN {S.selected('o_orderkey', SEED, 'missing0', 0.1)} THEN NULL ELSE o_totalprice END AS o_totalprice,
  o_orderdate,
  CASE WHEN {S.selected('o_orderkey', SEED, 'missing1', 0.05)} THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM orders""")
def inject_nulls(spark, folder):
    errors = [I.nulls("o_totalprice", 0.10), I.nulls("o_orderpriority", 0.05)]
    return I.inject(table(spark, folder, "orders"), "o_orderkey", errors, SEED).table


@query("inject_duplicates", f"""
SELECT * FROM orders UNION ALL
SELECT * FROM orders WHERE {S.selected('o_orderkey', SEED, 'duplicate', 0.08)}""")
def inject_duplicates(spark, folder):
    return I.inject_duplicates(table(spark, folder, "orders"), "o_orderkey", 0.08, SEED)


@query("inject_issues", f"""
SELECT CAST(event_id AS VARCHAR) AS row_key, 'event_type' AS "column", 'missing' AS kind,
  event_type AS original, CAST(NULL AS VARCHAR) AS injected
FROM events WHERE {S.selected('event_id', SEED, 'missing0', 0.05)}
UNION ALL
SELECT CAST(event_id AS VARCHAR), 'user_id', 'negative_value', CAST(user_id AS VARCHAR),
  CAST(-abs(user_id) AS VARCHAR)
FROM events WHERE {S.selected('event_id', SEED, 'negative_value1', 0.03)}
UNION ALL
SELECT CAST(event_id AS VARCHAR), NULL, 'duplicate', NULL, NULL
FROM events WHERE {S.selected('event_id', SEED, 'duplicate', 0.04)}""")
def inject_issues(spark, folder):
    errors = [I.nulls("event_type", 0.05), I.sign_flip("user_id", 0.03)]
    made = I.inject(
        table(spark, folder, "events"), "event_id", errors, SEED, duplicate_rate=0.04
    )
    return made.issues


SEGMENT_TYPOS = {
    "BUILDING": ["BUILDNG", "building", "BULIDING"],
    "FURNITURE": ["FURNITUR", "Furniture"],
    "HOUSEHOLD": ["HOUSE HOLD", "household", "HOUSHOLD", "HOSUEHOLD"],
}


def _sql_list(values):
    return [f"'{v}'" for v in values]


_TYPO_CASES = " ".join(
    f"WHEN {S.selected('c_custkey', SEED, 'typo0', 0.2)} AND c_mktsegment = '{value}' "
    f"THEN {S.pick(_sql_list(ways), 'c_custkey', SEED, 'typo0')}"
    for value, ways in SEGMENT_TYPOS.items()
)


@query("inject_typos", f"""
SELECT c_custkey, c_name, c_nationkey, c_acctbal,
  CASE {_TYPO_CASES} ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def inject_typos(spark, folder):
    errors = [I.variants("c_mktsegment", 0.2, SEGMENT_TYPOS)]
    return I.inject(table(spark, folder, "customer"), "c_custkey", errors, SEED).table


@query("inject_currency_text", f"""
SELECT p_partkey, p_name, p_brand, p_type,
  CASE WHEN {S.selected('p_partkey', SEED, 'type_error0', 0.05)} THEN '$' ELSE '' END
    || CAST(p_size AS VARCHAR) AS p_size, p_retailprice FROM part""")
def inject_currency_text(spark, folder):
    errors = [I.currency_text("p_size", 0.05)]
    return I.inject(table(spark, folder, "part"), "p_partkey", errors, SEED).table


_DATE_WAYS = [f"strftime(o_orderdate, '{f}')" for f in ("%d/%m/%Y", "%m-%d-%Y", "%d %b %Y")]


@query("inject_date_formats", f"""
SELECT o_orderkey, o_custkey,
  CASE WHEN {S.selected('o_orderkey', SEED, 'date_format0', 0.3)}
       THEN {S.pick(_DATE_WAYS, 'o_orderkey', SEED, 'date_format0')}
       ELSE strftime(o_orderdate, '%Y-%m-%d') END AS o_orderdate FROM orders""")
def inject_date_formats(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").cast("string").alias("o_orderdate")
    )
    errors = [I.date_formats("o_orderdate", 0.3, ["dd/MM/yyyy", "MM-dd-yyyy", "dd MMM yyyy"])]
    return I.inject(orders, "o_orderkey", errors, SEED).table


@query("inject_sign_flip", f"""
SELECT l_orderkey, l_linenumber,
  CASE WHEN {S.selected('l_orderkey', SEED, 'negative_value0', 0.025)} THEN -abs(l_quantity)
       ELSE l_quantity END AS l_quantity FROM lineitem""")
def inject_sign_flip(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return I.inject(lines, "l_orderkey", [I.sign_flip("l_quantity", 0.025)], SEED).table


@query("inject_outliers", f"""
SELECT event_id, ts, user_id, event_type,
  CASE WHEN {S.selected('event_id', SEED, 'outlier0', 0.015)}
       THEN round(CAST(50000 AS DOUBLE) + CAST(49999 AS DOUBLE) * {S.unit('event_id', SEED, 'outlier0v')}, 2)
       ELSE value END AS value, props FROM events""")
def inject_outliers(spark, folder):
    errors = [I.outliers("value", 0.015, 50000, 99999)]
    return I.inject(table(spark, folder, "events"), "event_id", errors, SEED).table


_WAYS = ["lower(o_orderpriority)",
         "replace(replace(o_orderpriority, '+', ' positive'), '-', ' negative')"]


@query("inject_category_variants", f"""
SELECT o_orderkey, CASE WHEN {S.selected('o_orderkey', SEED, 'category_variant0', 0.04)}
  THEN {S.pick(_WAYS, 'o_orderkey', SEED, 'category_variant0')}
  ELSE o_orderpriority END AS o_orderpriority FROM orders""")
def inject_category_variants(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    errors = [I.respell("o_orderpriority", 0.04, [F.lower, I.spelled_sign])]
    return I.inject(orders, "o_orderkey", errors, SEED).table


@query("inject_logic_errors", f"""
SELECT l_orderkey, l_linenumber, l_extendedprice,
  CASE WHEN {S.selected('l_orderkey', SEED, 'logic_error0', 0.01)}
       THEN l_extendedprice + (10 + {S.draw('l_orderkey', SEED, 'logic_error0v')} % 31)
       ELSE l_quantity END AS l_quantity FROM lineitem""")
def inject_logic_errors(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"
    )
    errors = [I.logic_error("l_quantity", "l_extendedprice", 0.01)]
    return I.inject(lines, "l_orderkey", errors, SEED).table


_FIRST, _LAST = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
_NAME_WAYS = [
    f"left({_FIRST}, 1) || '. ' || {_LAST}",
    f"{_FIRST} || '  ' || {_LAST}",
    f"lower({_FIRST}) || ' ' || lower({_LAST})",
    f"{_FIRST} || ' ' || left({_LAST}, length({_LAST}) - 1)",
]


@query("inject_near_duplicates", f"""
SELECT * FROM part UNION ALL
SELECT p_partkey + 1000000000, {S.pick(_NAME_WAYS, 'p_partkey', SEED, 'near_duplicate')},
  p_brand, p_type, p_size, p_retailprice
FROM part WHERE p_name LIKE '% %' AND {S.selected('p_partkey', SEED, 'near_duplicate', 0.02)}""")
def inject_near_duplicates(spark, folder):
    made = I.inject_near_duplicates(
        table(spark, folder, "part"), "p_partkey", "p_name", 0.02,
        lambda key: key + 1_000_000_000, SEED,
    )
    return made.table


ODD_CUSTOMERS = [
    {"c_custkey": -1, "c_name": "Null Fisher", "c_nationkey": 0, "c_acctbal": 45.0, "c_mktsegment": "BUILDING"},
    {"c_custkey": -2, "c_name": "None Yamada", "c_nationkey": 1, "c_acctbal": 28.0, "c_mktsegment": "MACHINERY"},
    {"c_custkey": -3, "c_name": "Na Lee", "c_nationkey": 2, "c_acctbal": 0.0, "c_mktsegment": "FURNITURE"},
]
_ODD_SQL = """
SELECT * FROM customer UNION ALL SELECT -1, 'Null Fisher', 0, 45.0, 'BUILDING'
UNION ALL SELECT -2, 'None Yamada', 1, 28.0, 'MACHINERY'
UNION ALL SELECT -3, 'Na Lee', 2, 0.0, 'FURNITURE'"""


@query("inject_odd_rows", _ODD_SQL)
def inject_odd_rows(spark, folder):
    return I.add_odd_rows(table(spark, folder, "customer"), ODD_CUSTOMERS)


@query("odd_rows_surviving", f"""
WITH c AS ({_ODD_SQL}) SELECT CAST(3 AS BIGINT) AS odd_rows, count(DISTINCT c_custkey) AS surviving
FROM c WHERE c_custkey IN (-1, -2, -3) AND NOT c_acctbal < 10""")
def odd_rows_surviving(spark, folder):
    with_odd = I.add_odd_rows(table(spark, folder, "customer"), ODD_CUSTOMERS)
    cleaned = with_odd.filter(~(F.col("c_acctbal") < 10))
    return I.surviving_rows(cleaned, ODD_CUSTOMERS, "c_custkey")


@query("pick_golden_rows", f"""
SELECT * FROM orders ORDER BY {S.digest('o_orderkey', SEED, 'golden')}, o_orderkey LIMIT 15""")
def pick_golden_rows(spark, folder):
    return I.pick_golden(table(spark, folder, "orders"), "o_orderkey", 15, SEED)


ORDERS_SCENARIO = Scenario(
    "orders: missing prices, negative prices, misspelt priorities, copies",
    key="o_orderkey",
    injections=(
        I.nulls("o_totalprice", 0.05),
        I.sign_flip("o_totalprice", 0.025),
        I.respell("o_orderpriority", 0.04, [F.lower, I.spelled_sign]),
    ),
    rules=D.ORDER_RULES, budget=50, golden_rows=8, duplicate_rate=0.08,
)


@query("scenario_dirty", f"""
WITH once AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
    CASE WHEN {S.selected('o_orderkey', SEED, 'missing0', 0.05)} THEN NULL
         WHEN {S.selected('o_orderkey', SEED, 'negative_value1', 0.025)} THEN -abs(o_totalprice)
         ELSE o_totalprice END AS o_totalprice,
    o_orderdate,
    CASE WHEN {S.selected('o_orderkey', SEED, 'category_variant2', 0.04)}
         THEN {S.pick(_WAYS, 'o_orderkey', SEED, 'category_variant2')}
         ELSE o_orderpriority END AS o_orderpriority
  FROM orders)
SELECT * FROM once UNION ALL
SELECT * FROM once WHERE {S.selected('o_orderkey', SEED, 'duplicate', 0.08)}""")
def scenario_dirty(spark, folder):
    return prepare(table(spark, folder, "orders"), ORDERS_SCENARIO, SEED).dirty
