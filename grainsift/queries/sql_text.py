"""Queries written as SQL text over the cleaning functions and report functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sql_functions
from ..operators import rules
from ..sources import dirty as D
from . import sql as S
from .clean import _title_sql
from .registry import query

_VIEW = "gs_orders_dirty"


def _prepared(spark, folder):
    sql_functions.register(spark)
    D.orders_dirty(spark, folder).createOrReplaceTempView(_VIEW)


@query("sql_clean", f"""WITH {S.ORDERS_DIRTY}
SELECT o_orderkey, {S.number('price_text')} AS price, {S.number(S.stripped('price_text'))} AS price_in_text,
  {S.strip('o_orderpriority')} AS priority, {_title_sql('o_orderpriority')} AS title, {S.parsed_date('date_text')} AS day
FROM orders_dirty""")
def sql_clean(spark, folder):
    """Every function in one statement; the same values as the DataFrame expressions."""
    _prepared(spark, folder)
    return spark.sql(f"""SELECT o_orderkey, gs_number_or_null(price_text) AS price, gs_number_in_text(price_text) AS price_in_text,
        gs_strip(o_orderpriority) AS priority, gs_title(o_orderpriority) AS title, gs_parse_time(date_text) AS day FROM {_VIEW}""")


@query("sql_rule_report", f"""WITH {S.ORDERS_DIRTY},
c AS (SELECT 0 AS rule_id, 'range' AS type, 'o_totalprice' AS "column", count(o_totalprice) AS checked,
    count(*) FILTER (WHERE o_totalprice < 0 OR o_totalprice > 500000) AS violations FROM orders_dirty
  UNION ALL SELECT 2, 'categorical', 'o_orderpriority', count(o_orderpriority),
    count(*) FILTER (WHERE o_orderpriority NOT IN ({', '.join(repr(p) for p in D.PRIORITIES)})) FROM orders_dirty)
SELECT *, round((checked - violations) / CAST(checked AS DOUBLE), 6) AS pass_rate FROM c""")
def sql_rule_report(spark, folder):
    """A table function: the rules that less than all checked rows obey."""
    report = rules.rules_report(D.orders_dirty(spark, folder), D.ORDER_RULES).drop("bad_values")
    sql_functions.register_report(report, "gs_order_rules")
    return spark.sql("SELECT * FROM gs_order_rules(1.0D)").withColumn("pass_rate", F.round("pass_rate", 6))
