"""Queries on near-duplicate rows and on values snapped to a dictionary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import similar as M
from ..sources import dirty as D
from ..sources.tables import table
from . import sql as S
from .registry import query


def _links(source: str, key: str, text: str, distance: int, more: str = "true") -> str:
    """Per row of a table: rows within the distance and the least key among them, by all pairs."""
    return f"""
SELECT x.{key}, count(y.{key}) AS n_links, least(x.{key}, coalesce(min(y.{key}), x.{key})) AS first_key
FROM {source} x LEFT JOIN {source} y ON x.{key} <> y.{key} AND levenshtein(x.{text}, y.{text}) <= {distance} AND {more}
GROUP BY x.{key}"""


@query("near_duplicates", f"WITH {S.CUSTOMER_DIRTY} {_links('customer_dirty', 'c_custkey', 'c_name', 2)}")
def near_duplicates(spark, folder):
    found = M.near_duplicates(D.customer_dirty(spark, folder), "c_name", "c_custkey", 2)
    return found.select("c_custkey", "n_links", "first_key")


@query("near_duplicate_pairs", f"""WITH {S.CUSTOMER_DIRTY}
SELECT x.c_custkey AS key_a, x.c_name AS text_a, CAST(1 AS BIGINT) AS rows_a, y.c_custkey AS key_b, y.c_name AS text_b,
  CAST(1 AS BIGINT) AS rows_b, CAST(levenshtein(x.c_name, y.c_name) AS INTEGER) AS distance
FROM customer_dirty x JOIN customer_dirty y ON x.c_nationkey = y.c_nationkey AND levenshtein(x.c_name, y.c_name) <= 1
  AND x.c_name < y.c_name""")
def near_duplicate_pairs(spark, folder):
    """Pairs of names that differ in one character, among customers of one nation."""
    pairs = M.near_pairs(D.customer_dirty(spark, folder), "c_name", "c_custkey", 1, within=["c_nationkey"])
    return pairs.drop("__w0")


@query("remove_near_duplicates", f"""WITH {S.CUSTOMER_DIRTY}
SELECT * FROM customer_dirty x WHERE NOT EXISTS (
  SELECT 1 FROM customer_dirty y WHERE y.c_custkey < x.c_custkey AND lower(trim(x.c_name)) = lower(trim(y.c_name))
  AND x.c_acctbal = y.c_acctbal AND x.c_nationkey = y.c_nationkey)""")
def remove_near_duplicates(spark, folder):
    """Rows injected again under a new key and in another spelling go."""
    return M.remove_near_duplicates(
        D.customer_dirty(spark, folder), "c_name", "c_custkey", 0, within=["c_nationkey", "c_acctbal"], fold=True)


def _snapped(source: str, column: str, allowed: str, distance: int, fold: bool) -> str:
    turn = (lambda c: f"lower(regexp_replace(trim({c}), '\\s+', ' ', 'g'))") if fold else (lambda c: c)
    return f"""
allowed AS ({allowed}),
best AS (SELECT v, min({{'d': levenshtein({turn('v')}, {turn('a')}), 'a': a}}) AS one FROM (
    SELECT DISTINCT {column} AS v FROM {source} WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT a FROM allowed)) AS q, allowed
  WHERE levenshtein({turn('v')}, {turn('a')}) <= {distance} GROUP BY v)
SELECT t.* REPLACE (coalesce(best.one.a, {column}) AS {column}) FROM {source} t LEFT JOIN best ON best.v = t.{column}"""


def _values(words: tuple[str, ...]) -> str:
    return "SELECT unnest([" + ", ".join(f"'{w}'" for w in words) + "]) AS a"


@query("snap_to_dictionary", f"WITH {S.CUSTOMER_DIRTY}, {_snapped('customer_dirty', 'c_mktsegment', _values(D.SEGMENTS), 1, True)}")
def snap_to_dictionary(spark, folder):
    """Misspelt market segments get the spelling of the list in one step."""
    return M.snap_to_dictionary(D.customer_dirty(spark, folder), "c_mktsegment", D.SEGMENTS, 1, fold=True)


@query("snap_priorities", f"WITH {S.ORDERS_DIRTY}, {_snapped('orders_dirty', 'o_orderpriority', _values(D.PRIORITIES), 2, True)}")
def snap_priorities(spark, folder):
    return M.snap_to_dictionary(D.orders_dirty(spark, folder), "o_orderpriority", D.PRIORITIES, 2, fold=True)


@query("snap_to_table", f"""WITH {S.CUSTOMER_DIRTY},
{_snapped('customer_dirty', 'c_name', 'SELECT DISTINCT c_name AS a FROM customer', 1, False)}""")
def snap_to_table(spark, folder):
    """The allowed values come from a table; a tie is decided for the least one."""
    names = table(spark, folder, "customer").select(F.col("c_name"))
    return M.snap_to_dictionary(D.customer_dirty(spark, folder), "c_name", names, 1)
