"""Queries on profiles, missing cells, duplicates and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup, profile as P
from ..sources import dirty as D
from ..sources.tables import table
from . import sql as S
from .registry import query


def _profile_sql(source: str, columns: dict[str, str]) -> str:
    lines = [
        f"""SELECT {i} AS position, '{c}' AS "column", '{t}' AS type, count({c}) AS non_null,
        count(*) - count({c}) AS missing,
        round((count(*) - count({c})) * CAST(100 AS DOUBLE) / count(*), 1) AS missing_pct,
        count(DISTINCT {c}) AS distinct_values FROM {source}"""
        for i, (c, t) in enumerate(columns.items())
    ]
    return " UNION ALL ".join(lines)


ORDER_TYPES = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string",
    "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
    "price_text": "string", "date_text": "string",
}
DOCUMENT_TYPES = {
    "doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint",
}


@query("profile_table", f"WITH {S.ORDERS_DIRTY} {_profile_sql('orders_dirty', ORDER_TYPES)}")
def profile_table(spark, folder):
    return P.profile_table(D.orders_dirty(spark, folder))


@query("profile_documents", _profile_sql("documents", DOCUMENT_TYPES))
def profile_documents(spark, folder):
    return P.profile_table(table(spark, folder, "documents"))


@query("table_shape", f"""
WITH {S.ORDERS_DIRTY}
SELECT CAST(sum(n) AS BIGINT) AS rows, 8 AS columns, CAST(sum(n - 1) AS BIGINT) AS duplicates,
  round(sum(n - 1) * CAST(100 AS DOUBLE) / sum(n), 1) AS duplicate_pct
FROM (SELECT count(*) AS n FROM orders_dirty GROUP BY {', '.join(ORDER_TYPES)}) AS t""")
def table_shape(spark, folder):
    return P.table_shape(D.orders_dirty(spark, folder))


@query("profile_numeric", f"""
WITH {S.ORDERS_DIRTY}
SELECT 'o_totalprice' AS "column", 'double' AS type, count(o_totalprice) AS non_null,
  count(*) - count(o_totalprice) AS missing,
  round((count(*) - count(o_totalprice)) * CAST(100 AS DOUBLE) / count(*), 1) AS missing_pct,
  count(DISTINCT o_totalprice) AS distinct_values, min(o_totalprice) AS min, max(o_totalprice) AS max,
  round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 2) AS std,
  round(median(o_totalprice), 4) AS median
FROM orders_dirty""")
def profile_numeric(spark, folder):
    p = P.profile_numeric(D.orders_dirty(spark, folder), "o_totalprice")
    return p.withColumns({
        "mean": F.round("mean", 4), "std": F.round("std", 2), "median": F.round("median", 4)
    })


@query("profile_bigint", """
SELECT 'o_orderkey' AS "column", 'bigint' AS type, count(*) AS non_null, count(DISTINCT o_orderkey) AS distinct_values,
  min(o_orderkey) + 9007199254740993 AS min, max(o_orderkey) + 9007199254740993 AS max FROM orders""")
def profile_bigint(spark, folder):
    orders = table(spark, folder, "orders").withColumn("o_orderkey", F.col("o_orderkey") + 2**53 + 1)
    return P.profile_numeric(orders, "o_orderkey").select("column", "type", "non_null", "distinct_values", "min", "max")


@query("profile_topk", f"""
WITH {S.ORDERS_DIRTY}
SELECT o_orderpriority AS value, count(*) AS count FROM orders_dirty
WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def profile_topk(spark, folder):
    return P.top_values(D.orders_dirty(spark, folder), "o_orderpriority")


@query("missing_report", f"""
WITH {S.ORDERS_DIRTY}, m AS (
  SELECT 'o_totalprice' AS "column", count(*) - count(o_totalprice) AS missing, count(*) AS n FROM orders_dirty
  UNION ALL SELECT 'o_orderpriority', count(*) - count(o_orderpriority), count(*) FROM orders_dirty
  UNION ALL SELECT 'o_orderdate', count(*) - count(o_orderdate), count(*) FROM orders_dirty
  UNION ALL SELECT 'price_text', count(*) - count(price_text), count(*) FROM orders_dirty)
SELECT "column", missing, round(missing * CAST(100 AS DOUBLE) / n, 1) AS missing_pct,
  CAST(sum(missing) OVER () AS BIGINT) AS total_missing
FROM m WHERE missing > 0""")
def missing_report(spark, folder):
    return P.missing_report(D.orders_dirty(spark, folder))


def _duplicates_sql(source: str, keys: str) -> str:
    return f"""
SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates,
  CAST(coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS BIGINT) AS members,
  count(CASE WHEN n > 1 THEN 1 END) AS groups,
  round(sum(n - 1) * CAST(100 AS DOUBLE) / sum(n), 1) AS duplicate_pct
FROM (SELECT count(*) AS n FROM {source} GROUP BY {keys}) AS t"""


@query("duplicate_report", f"WITH {S.ORDERS_DIRTY} {_duplicates_sql('orders_dirty', ', '.join(ORDER_TYPES))}")
def duplicate_report(spark, folder):
    return dedup.duplicate_report(D.orders_dirty(spark, folder))


@query("duplicate_subset_report", _duplicates_sql("documents", "text"))
def duplicate_subset_report(spark, folder):
    return dedup.duplicate_report(table(spark, folder, "documents"), ["text"])


@query("duplicate_members", f"""
WITH {S.ORDERS_DIRTY}
SELECT o.* FROM orders_dirty o JOIN (
  SELECT o_custkey, o_totalprice, o_orderpriority FROM orders_dirty
  GROUP BY 1, 2, 3 HAVING count(*) > 1) d
ON o.o_custkey IS NOT DISTINCT FROM d.o_custkey
AND o.o_totalprice IS NOT DISTINCT FROM d.o_totalprice
AND o.o_orderpriority IS NOT DISTINCT FROM d.o_orderpriority""")
def duplicate_members(spark, folder):
    return dedup.duplicate_members(
        D.orders_dirty(spark, folder), ["o_custkey", "o_totalprice", "o_orderpriority"]
    )


_WHISKERS = """
q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events_dirty),
w AS (SELECT q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q)
"""


@query("outliers_iqr", f"""
WITH {S.EVENTS_DIRTY}, {_WHISKERS}
SELECT 'value' AS "column", round(q1, 4) AS q1, round(q3, 4) AS q3, round(iqr, 4) AS iqr,
  round(lower, 4) AS lower, round(upper, 4) AS upper,
  (SELECT count(*) FROM events_dirty, w WHERE value < lower OR value > upper) AS outliers
FROM w""")
def outliers_iqr(spark, folder):
    r = P.outlier_report(D.events_dirty(spark, folder), "value")
    return r.withColumns({c: F.round(c, 4) for c in ("q1", "q3", "iqr", "lower", "upper")})


@query("outlier_rows", f"""
WITH {S.EVENTS_DIRTY}, {_WHISKERS}
SELECT events_dirty.* FROM events_dirty, w WHERE value < lower OR value > upper""")
def outlier_rows(spark, folder):
    return P.outlier_rows(D.events_dirty(spark, folder), "value")


@query("outlier_examples", f"""
WITH {S.EVENTS_DIRTY}, {_WHISKERS}
SELECT event_id, value FROM events_dirty, w WHERE value < lower OR value > upper
ORDER BY event_id LIMIT 15""")
def outlier_examples(spark, folder):
    return P.outlier_examples(D.events_dirty(spark, folder), "value", ["event_id"])
