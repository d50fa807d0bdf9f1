"""Queries on mergeable profile states, bounded summaries and positions in source order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare, positions, profile as P, states as ST
from ..operators.quantiles import quantiles
from ..sources import dirty as D
from ..sources.tables import table
from . import sql as S
from .registry import query

_TYPES = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double", "o_orderdate": "timestamp_ntz",
    "o_orderpriority": "string", "price_text": "string", "date_text": "string",
}


def _state_sql(column: str, kind: str) -> str:
    numeric = kind in ("bigint", "double")
    numbers = (f"CAST(min({column}) AS DOUBLE), CAST(max({column}) AS DOUBLE), round(avg({column}), 4), round(stddev_samp({column}), 2), true"
               if numeric else "CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS BOOLEAN)")
    return f"""SELECT '{column}', '{kind}', count({column}), count(*) - count({column}),
  round((count(*) - count({column})) * CAST(100 AS DOUBLE) / count(*), 1), true, {numbers} FROM orders_dirty"""


@query("profile_state_merged", f"""WITH {S.ORDERS_DIRTY}
SELECT * FROM ({' UNION ALL '.join(_state_sql(c, t) for c, t in _TYPES.items())})
AS s("column", type, non_null, missing, missing_pct, distinct_ok, min, max, mean, std, median_ok)""")
def profile_state_merged(spark, folder):
    """States of three groups merged: exact parts equal the whole, estimates lie within their bounds."""
    orders = D.orders_dirty(spark, folder)
    merged = ST.profile_of_state(ST.merge_states(ST.profile_state(orders, ["o_orderstatus"])))
    exact = P.profile_table(orders).select("column", F.col("distinct_values").alias("exact"))
    off = F.abs(F.col("distinct_estimate") - F.col("exact"))
    bounds = {c: quantiles(orders, c, [0.5 - ST.RANK_ERROR, 0.5 + ST.RANK_ERROR])
              for c, t in _TYPES.items() if t in ("bigint", "double")}
    median_ok = F.lit(None).cast("boolean")
    for c, (low, high) in bounds.items():
        median_ok = F.when(F.col("column") == c, F.col("median_estimate").between(low, high)).otherwise(median_ok)
    return merged.join(exact, "column").select(
        "column", "type", "non_null", "missing", "missing_pct", (off <= ST.DISTINCT_ERROR * F.col("exact")).alias("distinct_ok"),
        "min", "max", F.round("mean", 4).alias("mean"), F.round("std", 2).alias("std"), median_ok.alias("median_ok"))


@query("distinct_keys_merged", """
SELECT 'o_custkey' AS "column", o_orderstatus AS part, count(DISTINCT o_custkey) AS distinct_keys FROM orders GROUP BY 2
UNION ALL SELECT 'o_custkey', 'all', count(DISTINCT o_custkey) FROM orders
UNION ALL SELECT 'l_orderkey', l_returnflag, count(DISTINCT l_orderkey) FROM lineitem GROUP BY 2
UNION ALL SELECT 'l_orderkey', 'all', count(DISTINCT l_orderkey) FROM lineitem""")
def distinct_keys_merged(spark, folder):
    """Exact distinct keys per part and, merged from the parts, of the whole."""
    out = None
    for name, key, part in (("orders", "o_custkey", "o_orderstatus"), ("lineitem", "l_orderkey", "l_returnflag")):
        states = ST.key_state(table(spark, folder, name), key, [part])
        each = ST.count_keys(states, [part]).select(F.lit(key).alias("column"), F.col(part).alias("part"), "distinct_keys")
        whole = ST.count_keys(states).select(F.lit(key).alias("column"), F.lit("all").alias("part"), "distinct_keys")
        out = each.union(whole) if out is None else out.union(each).union(whole)
    return out


@query("profile_topk_two_pass", f"""WITH {S.ORDERS_DIRTY}
SELECT price_text AS value, count(*) AS count FROM orders_dirty WHERE price_text IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def profile_topk_two_pass(spark, folder):
    """One very frequent value among nearly unique ones: the bound does not separate the tenth, all are counted."""
    return P.top_values_two_pass(D.orders_dirty(spark, folder), "price_text")


@query("profile_topk_events", """
SELECT user_id AS value, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def profile_topk_events(spark, folder):
    return P.top_values_two_pass(table(spark, folder, "events"), "user_id")


@query("row_ordinal_source", "SELECT *, row_number() OVER () - 1 AS _ord FROM lineitem")
def row_ordinal_source(spark, folder):
    """Positions as the files hold the rows: no sort and no shuffle of rows."""
    return positions.with_source_ordinal(table(spark, folder, "lineitem"))


@query("view_head_source", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders LIMIT 50")
def view_head_source(spark, folder):
    return positions.head_of_source(table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), 50)


@query("fill_forward_source", f"""WITH {S.EVENTS_DIRTY}, o AS (SELECT *, row_number() OVER () AS i FROM events_dirty)
SELECT * EXCLUDE (i) REPLACE (last_value(value IGNORE NULLS) OVER (
  ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value) FROM o""")
def fill_forward_source(spark, folder):
    return positions.forward_fill_source(D.events_dirty(spark, folder), "value")


@query("score_accuracy_source", f"""WITH {S.EVENTS_DIRTY},
p AS (SELECT d.value AS v, e.value AS t FROM
  (SELECT value, row_number() OVER () AS i FROM events_dirty) d JOIN (SELECT value, row_number() OVER () AS i FROM events) e USING (i)),
s AS (SELECT count(*) * 6 AS cells, round(CAST(sum(5 + CASE WHEN v = t THEN 1
  WHEN t <> 0 AND abs(t - v) / abs(t) < 0.01 THEN 0.8 ELSE 0 END) AS DOUBLE), 4) AS matched FROM p)
SELECT cells, matched, round(matched / cells, 6) AS accuracy FROM s""")
def score_accuracy_source(spark, folder):
    """Row i of one table against row i of the other, in load order."""
    r = compare.accuracy_by_source(D.events_dirty(spark, folder), table(spark, folder, "events"))
    return r.withColumns({"matched": F.round("matched", 4), "accuracy": F.round("accuracy", 6)})
