"""SQL fragments shared by the oracles."""

from __future__ import annotations

ORDERS_DIRTY = """
orders_once AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
    CASE WHEN o_orderkey % 10 = 3 THEN NULL WHEN o_orderkey % 97 = 5 THEN o_totalprice * 100
         WHEN o_orderkey % 53 = 7 THEN -o_totalprice ELSE o_totalprice END AS o_totalprice,
    o_orderdate,
    CASE WHEN o_orderkey % 19 = 2 THEN NULL WHEN o_orderkey % 7 = 1 THEN lower(o_orderpriority)
         WHEN o_orderkey % 11 = 4 THEN '  ' || o_orderpriority || ' ' ELSE o_orderpriority
    END AS o_orderpriority,
    CASE WHEN o_orderkey % 41 = 6 THEN 'n/a'
         WHEN o_orderkey % 20 = 4 THEN '$' || CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR)
         ELSE CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) END AS price_text,
    CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%d/%m/%Y')
         WHEN o_orderkey % 5 = 1 THEN strftime(o_orderdate, '%m-%d-%Y')
         WHEN o_orderkey % 5 = 2 THEN strftime(o_orderdate, '%d %b %Y')
         ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date_text
  FROM orders),
orders_dirty AS (
  SELECT * FROM orders_once UNION ALL SELECT * FROM orders_once WHERE o_orderkey % 12 = 8)
"""

CUSTOMER_DIRTY = """
customer_once AS (
  SELECT c_custkey, c_name, c_nationkey, c_acctbal,
    CASE WHEN c_custkey % 20 = 9 THEN NULL
         WHEN c_custkey % 30 = 11 THEN left(c_mktsegment, length(c_mktsegment) - 1)
         WHEN c_custkey % 17 = 3 THEN lower(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment
  FROM customer),
customer_dirty AS (
  SELECT * FROM customer_once UNION ALL
  SELECT c_custkey + 1000000000, lower(c_name), c_nationkey, c_acctbal, c_mktsegment
  FROM customer_once WHERE c_custkey % 50 = 13)
"""

EVENTS_DIRTY = """
events_dirty AS (
  SELECT event_id, ts, user_id, event_type,
    CASE WHEN event_id % 25 = 6 THEN NULL WHEN event_id % 83 = 12 THEN -value
         WHEN event_id % 211 = 40 THEN value + 10000 ELSE value END AS value, props
  FROM events)
"""

# numbers in text: the spellings that count, and the guarded cast
_NUMERIC = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def number(text: str) -> str:
    return f"CASE WHEN regexp_matches({text}, '{_NUMERIC}') THEN TRY_CAST(trim({text}) AS DOUBLE) END"


def stripped(text: str) -> str:
    return f"regexp_replace({text}, '[^0-9.\\-]', '', 'g')"


def digest(key: str, seed: int, tag: str) -> str:
    return f"md5(CAST({key} AS VARCHAR) || '|{seed}|{tag}')"


def draw(key: str, seed: int, tag: str) -> str:
    return f"CAST('0x' || substr({digest(key, seed, tag)}, 1, 8) AS BIGINT)"


def unit(key: str, seed: int, tag: str) -> str:
    return f"(CAST({draw(key, seed, tag)} AS DOUBLE) / CAST(4294967296 AS DOUBLE))"


def selected(key: str, seed: int, tag: str, rate: float) -> str:
    return f"({unit(key, seed, tag)} < CAST({rate} AS DOUBLE))"


def pick(choices: list[str], key: str, seed: int, tag: str) -> str:
    return f"list_extract([{', '.join(choices)}], CAST({draw(key, seed, tag + 'v')} % {len(choices)} AS INT) + 1)"


def parsed_date(text: str) -> str:
    formats = ("%Y-%m-%d", "%d/%m/%Y", "%m-%d-%Y", "%d %b %Y")
    tries = ", ".join(f"try_strptime({text}, '{f}')" for f in formats)
    return f"CAST(coalesce({tries}) AS TIMESTAMP)"


def strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"
