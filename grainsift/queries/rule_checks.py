"""Queries on business rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fill, rules as R
from ..sources import dirty as D
from ..sources.tables import table
from . import sql as S
from .registry import query

_PRIORITIES = ", ".join(f"'{p}'" for p in D.PRIORITIES)
_SEGMENTS = ", ".join(f"'{s}'" for s in D.SEGMENTS)


def order_rules_sql(source: str) -> str:
    """rule_id, type, column, checked, violations, bad_values of ORDER_RULES."""
    return f"""
SELECT 0 AS rule_id, 'range' AS type, 'o_totalprice' AS "column", count(o_totalprice) AS checked,
  count(*) FILTER (WHERE o_totalprice < 0 OR o_totalprice > 500000) AS violations,
  CAST(NULL AS BIGINT) AS bad_values FROM {source}
UNION ALL SELECT 1, 'not_null', 'o_orderkey', count(*), count(*) - count(o_orderkey), NULL FROM {source}
UNION ALL SELECT 2, 'categorical', 'o_orderpriority', count(o_orderpriority),
  count(*) FILTER (WHERE o_orderpriority NOT IN ({_PRIORITIES})),
  count(DISTINCT CASE WHEN o_orderpriority NOT IN ({_PRIORITIES}) THEN o_orderpriority END) FROM {source}"""


def _with_rate(counts: str) -> str:
    return f"""SELECT rule_id, type, "column", checked, violations,
  round((checked - violations) / CAST(checked AS DOUBLE), 6) AS pass_rate, bad_values FROM ({counts}) AS c"""


def _rounded(report):
    return report.withColumn("pass_rate", F.round("pass_rate", 6))


@query("rules_report", f"WITH {S.ORDERS_DIRTY} {_with_rate(order_rules_sql('orders_dirty'))}")
def rules_report(spark, folder):
    return _rounded(R.rules_report(D.orders_dirty(spark, folder), D.ORDER_RULES))


_CUSTOMER_COUNTS = f"""
SELECT 0 AS rule_id, 'categorical' AS type, 'c_mktsegment' AS "column", count(c_mktsegment) AS checked,
  count(*) FILTER (WHERE c_mktsegment NOT IN ({_SEGMENTS})) AS violations,
  count(DISTINCT CASE WHEN c_mktsegment NOT IN ({_SEGMENTS}) THEN c_mktsegment END) AS bad_values
FROM customer_dirty
UNION ALL SELECT 1, 'pattern', 'c_name', count(c_name),
  count(*) FILTER (WHERE NOT regexp_matches(c_name, '^(Customer#[0-9]+)')), NULL FROM customer_dirty
UNION ALL SELECT 2, 'not_null', 'c_custkey', count(*), count(*) - count(c_custkey), NULL FROM customer_dirty"""


@query("rules_report_customer", f"WITH {S.CUSTOMER_DIRTY} {_with_rate(_CUSTOMER_COUNTS)}")
def rules_report_customer(spark, folder):
    return _rounded(R.rules_report(D.customer_dirty(spark, folder), D.CUSTOMER_RULES))


@query("rules_report_violated", f"""WITH {S.CUSTOMER_DIRTY}
{_with_rate(_CUSTOMER_COUNTS)} WHERE violations > 0""")
def rules_report_violated(spark, folder):
    customers = D.customer_dirty(spark, folder)
    return _rounded(R.rules_report(customers, D.CUSTOMER_RULES, only_violated=True))


@query("rules_cross_column", _with_rate("""
SELECT 0 AS rule_id, 'cross_column' AS type, 'l_extendedprice,l_quantity' AS "column", count(*) AS checked,
  count(*) FILTER (WHERE l_extendedprice <= l_quantity) AS violations, CAST(NULL AS BIGINT) AS bad_values
FROM lineitem"""))
def rules_cross_column(spark, folder):
    return _rounded(R.rules_report(table(spark, folder, "lineitem"), D.LINEITEM_RULES))


@query("rules_after_median_fill", f"""
WITH {S.ORDERS_DIRTY}, filled AS (SELECT * REPLACE (
  coalesce(o_totalprice, (SELECT median(o_totalprice) FROM orders_dirty)) AS o_totalprice) FROM orders_dirty)
{_with_rate(order_rules_sql('filled'))}""")
def rules_after_median_fill(spark, folder):
    filled = fill.fill_missing(D.orders_dirty(spark, folder), "o_totalprice", "median")
    return _rounded(R.rules_report(filled, D.ORDER_RULES))


def compliance_sql(source: str) -> str:
    return f"""SELECT avg((checked - violations) / CAST(checked AS DOUBLE))
    FROM ({order_rules_sql(source)}) AS c"""


@query("rules_compliance", f"WITH {S.ORDERS_DIRTY} SELECT round(({compliance_sql('orders_dirty')}), 6) AS compliance")
def rules_compliance(spark, folder):
    result = R.rules_compliance(D.orders_dirty(spark, folder), D.ORDER_RULES)
    return result.select(F.round("compliance", 6).alias("compliance"))


@query("rules_bad_categories", f"""
WITH {S.CUSTOMER_DIRTY}
SELECT c_mktsegment AS value, count(*) AS count FROM customer_dirty
WHERE c_mktsegment IS NOT NULL AND c_mktsegment NOT IN ({_SEGMENTS}) GROUP BY 1""")
def rules_bad_categories(spark, folder):
    return R.invalid_categories(D.customer_dirty(spark, folder), "c_mktsegment", D.SEGMENTS)


@query("rules_bad_examples", f"""
WITH {S.CUSTOMER_DIRTY}
SELECT c_mktsegment AS value, count(*) AS count FROM customer_dirty
WHERE c_mktsegment IS NOT NULL AND c_mktsegment NOT IN ({_SEGMENTS}) GROUP BY 1 ORDER BY 1 LIMIT 5""")
def rules_bad_examples(spark, folder):
    return R.invalid_categories(
        D.customer_dirty(spark, folder), "c_mktsegment", D.SEGMENTS, R.BAD_VALUE_EXAMPLES
    )


@query("rules_unknown_keys", """
SELECT o_custkey AS value, count(*) AS count FROM orders
WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1""")
def rules_unknown_keys(spark, folder):
    allowed = table(spark, folder, "supplier").select("s_suppkey")
    return R.invalid_categories(table(spark, folder, "orders"), "o_custkey", allowed)


_DATE_ROWS = """SELECT 0 AS rule_id, 'cross_column' AS type, 'l_shipdate,o_orderdate' AS "column", count(*) AS checked,
  count(*) FILTER (WHERE NOT l_shipdate > o_orderdate) AS violations FROM j
UNION ALL SELECT 1, 'range', 'l_shipdate', count(*),
  count(*) FILTER (WHERE l_shipdate < TIMESTAMP '1996-01-01' OR l_shipdate > TIMESTAMP '2000-12-31') FROM j"""


@query("rules_cross_column_dates", f"""
WITH j AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey), c AS ({_DATE_ROWS})
SELECT *, round((checked - violations) / CAST(checked AS DOUBLE), 6) AS pass_rate FROM c WHERE rule_id = 0""")
def rules_cross_column_dates(spark, folder):
    return _date_report(spark, folder, R.cross_column("l_shipdate", "o_orderdate"))


@query("rules_range_dates", f"""
WITH j AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey), c AS ({_DATE_ROWS})
SELECT * REPLACE (0 AS rule_id), round((checked - violations) / CAST(checked AS DOUBLE), 6) AS pass_rate FROM c WHERE rule_id = 1""")
def rules_range_dates(spark, folder):
    return _date_report(spark, folder, R.value_range("l_shipdate", "1996-01-01", "2000-12-31"))


def _date_report(spark, folder, rule):
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    report = R.rules_report(joined, [rule]).drop("bad_values")
    return report.withColumn("pass_rate", F.round("pass_rate", 6))


_BROKEN = f"""SELECT *, concat_ws(',',
  CASE WHEN o_totalprice < 0 OR o_totalprice > 500000 THEN '0' END,
  CASE WHEN o_orderkey IS NULL THEN '1' END,
  CASE WHEN o_orderpriority NOT IN ({_PRIORITIES}) THEN '2' END) AS violated_rules FROM orders_dirty"""


@query("rules_quarantine_good", f"""
WITH {S.ORDERS_DIRTY}, b AS ({_BROKEN})
SELECT * EXCLUDE (violated_rules) FROM b WHERE violated_rules = ''""")
def rules_quarantine_good(spark, folder):
    return R.quarantine(D.orders_dirty(spark, folder), D.ORDER_RULES)[0]


@query("rules_quarantine_bad", f"""
WITH {S.ORDERS_DIRTY}, b AS ({_BROKEN}) SELECT * FROM b WHERE violated_rules <> ''""")
def rules_quarantine_bad(spark, folder):
    bad = R.quarantine(D.orders_dirty(spark, folder), D.ORDER_RULES)[1]
    as_text = F.concat_ws(",", F.transform("violated_rules", lambda i: i.cast("string")))
    return bad.withColumn("violated_rules", as_text)
