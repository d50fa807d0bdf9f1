"""Queries on comparison, scoring, recipes and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import side_by_side
from ..operators import compare, inject, score as Q
from ..operators.rules import rules_compliance
from ..plans import recipe
from ..plans.recipe import step
from ..session import materialized
from ..sources import dirty as D
from ..sources.tables import table
from . import sql as S
from .registry import query
from .rule_checks import compliance_sql

CLEANING = [
    step("find_missing"),
    step("drop_column", column="price_text"),
    step("drop_column", column="date_text"),
    step("remove_duplicates"),
    step("fill_missing", column="o_totalprice", strategy="mean"),
    step("standardize", column="o_orderpriority", method="strip"),
    step("standardize", column="o_orderpriority", method="uppercase"),
    step("fill_missing", column="o_orderpriority", strategy="mode"),
    step("clip", column="o_totalprice", lower=0, upper=500000),
]
BUDGET = 50

CLEANED = f"""{S.ORDERS_DIRTY},
c1 AS (SELECT DISTINCT * EXCLUDE (price_text, date_text) FROM orders_dirty),
c2 AS (SELECT * REPLACE (coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM c1)) AS o_totalprice,
  upper({S.strip('o_orderpriority')}) AS o_orderpriority) FROM c1),
cleaned AS (SELECT * REPLACE (greatest(least(o_totalprice, 500000), 0) AS o_totalprice,
  coalesce(o_orderpriority, (SELECT o_orderpriority FROM c2 WHERE o_orderpriority IS NOT NULL
    GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority) FROM c2)
"""


def cleaned(spark, folder):
    return recipe.run(
        D.orders_dirty(spark, folder), CLEANING, materialize_after=["remove_duplicates"]
    )


HALF_STEPS = 30
# A table that is only half clean: some copies and gaps are left, some rows are lost, some
# prices break their rule, a third of the rows are damaged and one column is text.
HALF = """half_once AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 20 = 3 THEN NULL WHEN o_orderkey % 11 = 0 THEN -5.0
         WHEN o_orderkey % 3 = 0 THEN o_totalprice * 3 ELSE o_totalprice END AS o_totalprice,
    strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM cleaned WHERE o_orderkey % 8 <> 1),
half AS (SELECT * FROM half_once UNION ALL SELECT * FROM half_once WHERE o_orderkey % 24 = 8)"""


def half_cleaned(spark, folder):
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    damaged = cleaned(spark, folder).filter(k % 8 != 1).select(
        "o_orderkey", "o_custkey", F.when(k % 3 == 0, "Z").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 20 == 3, None).when(k % 11 == 0, -5.0).when(k % 3 == 0, price * 3).otherwise(price).alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority")
    twice = F.sequence(F.lit(0), F.when(k % 24 == 8, 1).otherwise(0))
    return damaged.withColumn("__copy", F.explode(twice)).drop("__copy")


def _dirty(spark, folder):
    return D.orders_dirty(spark, folder).drop("price_text", "date_text")


def _golden(spark, folder):
    return inject.pick_golden(table(spark, folder, "orders"), "o_orderkey", 15)


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


# --- facts and comparison ----------------------------------------------------


@query("table_facts", f"""
WITH {S.ORDERS_DIRTY}
SELECT count(*) AS rows,
  CAST(sum((o_totalprice IS NULL)::INT + (o_orderpriority IS NULL)::INT) AS BIGINT) AS missing_cells,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_dirty) AS d) AS duplicates
FROM orders_dirty""")
def table_facts(spark, folder):
    return Q.table_facts(D.orders_dirty(spark, folder))


def _cell(truth: str, current: str) -> str:
    """Score of one cell pair of equal type."""
    return f"CASE WHEN {truth} IS NOT DISTINCT FROM {current} THEN 1.0 ELSE 0.0 END"


def _text_cell(truth: str, current: str) -> str:
    a, b = (f"lower({S.strip(x)})" for x in (truth, current))
    return _cell(a, b)


def _number_cell(truth: str, current: str) -> str:
    return f"""CASE WHEN {truth} IS NOT DISTINCT FROM {current} THEN 1.0
      WHEN {truth} <> 0 AND abs({truth} - {current}) / abs({truth}) < CAST(0.01 AS DOUBLE) THEN 0.8 ELSE 0.0 END"""


_ROW_SCORE = " + ".join([
    _number_cell("t.o_orderkey", "c.o_orderkey"), _number_cell("t.o_custkey", "c.o_custkey"),
    _text_cell("t.o_orderstatus", "c.o_orderstatus"), _number_cell("t.o_totalprice", "c.o_totalprice"),
    _cell("t.o_orderdate", "c.o_orderdate"), _text_cell("t.o_orderpriority", "c.o_orderpriority"),
])


def _keyed_sql(current: str) -> str:
    return f"""SELECT count(*) * 6 AS cells, sum(CAST({_ROW_SCORE} AS DOUBLE)) AS matched
    FROM {current} c JOIN orders t ON c.o_orderkey = t.o_orderkey"""


def _accuracy(counts: str) -> str:
    return f"""SELECT cells, round(matched, 4) AS matched, round(matched / cells, 6) AS accuracy
    FROM ({counts}) AS a"""


@query("score_accuracy_keyed", f"WITH {S.ORDERS_DIRTY} {_accuracy(_keyed_sql('orders_dirty'))}")
def score_accuracy_keyed(spark, folder):
    r = compare.accuracy_by_key(
        _dirty(spark, folder), table(spark, folder, "orders"), ["o_orderkey"]
    )
    return r.withColumns({"matched": F.round("matched", 4), "accuracy": F.round("accuracy", 6)})


@query("score_accuracy_positional", f"""
WITH {S.ORDERS_DIRTY},
c AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders_dirty),
t AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders)
{_accuracy(f"SELECT count(*) * 6 AS cells, sum(CAST({_ROW_SCORE} AS DOUBLE)) AS matched FROM c JOIN t ON c.i = t.i")}""")
def score_accuracy_positional(spark, folder):
    r = compare.accuracy_by_position(
        _dirty(spark, folder), table(spark, folder, "orders"), ["o_orderkey"]
    )
    return r.withColumns({"matched": F.round("matched", 4), "accuracy": F.round("accuracy", 6)})


@query("score_accuracy_positional_ties", """
SELECT count(*) * 6 AS cells, CAST(count(*) * 6 AS DOUBLE) AS matched, CAST(1 AS DOUBLE) AS accuracy FROM orders""")
def score_accuracy_positional_ties(spark, folder):
    """A table against itself, in another partitioning and by a key with many ties."""
    orders = table(spark, folder, "orders")
    return compare.accuracy_by_position(orders.repartition(5, "o_custkey"), orders, ["o_orderdate"], rows_per_bucket=700)


_GOLDEN = f"""golden AS (SELECT * FROM orders
  ORDER BY {S.digest('o_orderkey', 42, 'golden')}, o_orderkey LIMIT 15)"""


def _found_sql(current: str) -> str:
    same = " + ".join(f"({_cell(a, b)})" for a, b in [
        ("t.o_orderkey", "c.o_orderkey"), ("t.o_custkey", "c.o_custkey"),
        (f"lower({S.strip('t.o_orderstatus')})", f"lower({S.strip('c.o_orderstatus')})"),
        ("t.o_totalprice", "c.o_totalprice"), ("t.o_orderdate", "c.o_orderdate"),
        (f"lower({S.strip('t.o_orderpriority')})", f"lower({S.strip('c.o_orderpriority')})"),
    ])
    return f"SELECT count(DISTINCT t.o_orderkey) FROM golden t, {current} c WHERE ({same}) / 6.0 > 0.8"


@query("score_golden", f"""
WITH {S.ORDERS_DIRTY}, {_GOLDEN}
SELECT (SELECT count(*) FROM golden) AS golden_rows, ({_found_sql('orders_dirty')}) AS found""")
def score_golden(spark, folder):
    return compare.golden_report(_dirty(spark, folder), _golden(spark, folder), "o_orderkey")


# --- scores ------------------------------------------------------------------


def _facts_sql(name: str, source: str, columns: str = "*") -> str:
    return f"""{name} AS (SELECT count(*) AS n,
  sum((o_totalprice IS NULL)::INT + (o_orderpriority IS NULL)::INT) AS m,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT {columns} FROM {source}) AS d) AS d FROM {source})"""


def _progress_sql(field: str) -> str:
    return f"""CASE WHEN b.{field} > t.{field} THEN least(CAST(1 AS DOUBLE),
      greatest(b.{field} - c.{field}, 0) / CAST(b.{field} - t.{field} AS DOUBLE)) ELSE 1.0 END"""


def _score_sql(current: str, steps: int, types: str = "1.0") -> str:
    """CTEs ending in ``s``: one row with all dimensions of ``current``."""
    efficiency = {0: "0.5", 9: "1.0", 30: "0.6"}[steps]
    return f"""{_facts_sql('b', 'orders_dirty')}, {_facts_sql('c', current)}, {_facts_sql('t', 'orders')},
a AS ({_keyed_sql(current)}), {_GOLDEN},
s AS (SELECT {_progress_sql('m')} AS missing_fixed, {_progress_sql('d')} AS duplicates_removed,
  {types} AS type_correctness, a.matched / a.cells AS value_accuracy,
  least(1.0, c.n / CAST(t.n AS DOUBLE)) AS data_preservation,
  ({compliance_sql(current)}) AS constraint_compliance,
  {efficiency} AS step_efficiency, ({_found_sql(current)}) / 15.0 AS golden_row_integrity,
  c.n - t.n AS extra
FROM b, c, t, a)"""


_SQL_WEIGHTS = {
    "missing_fixed": 0.2, "duplicates_removed": 0.15, "type_correctness": 0.15, "value_accuracy": 0.2,
    "data_preservation": 0.1, "constraint_compliance": 0.1, "step_efficiency": 0.05, "golden_row_integrity": 0.05}
_COMPOSITE = """least(0.999, greatest(0.001, 0.2::DOUBLE * missing_fixed + 0.15::DOUBLE * duplicates_removed
  + 0.15::DOUBLE * type_correctness + 0.2::DOUBLE * value_accuracy + 0.1::DOUBLE * data_preservation
  + 0.1::DOUBLE * constraint_compliance + 0.05::DOUBLE * step_efficiency + 0.05::DOUBLE * golden_row_integrity))"""
_DIMENSIONS = ", ".join(f"round(CAST({d} AS DOUBLE), 6) AS {d}" for d in _SQL_WEIGHTS)


def _score(spark, folder, current, steps=len(CLEANING), **options):
    return Q.score(
        current, table(spark, folder, "orders"), D.orders_dirty(spark, folder),
        key=["o_orderkey"], rules=D.ORDER_RULES, golden=_golden(spark, folder),
        steps=steps, budget=BUDGET, **options,
    )


@query("score_composite", f"""
WITH {CLEANED}, {_score_sql('cleaned', len(CLEANING))}
SELECT {_DIMENSIONS}, CAST(greatest(extra, 0) AS BIGINT) AS extra_rows, 0 AS dropped_columns,
  0 AS extra_columns, round({_COMPOSITE}, 6) AS composite FROM s""")
def score_composite(spark, folder):
    s = _score(spark, folder, cleaned(spark, folder))
    return _rounded(s, *Q.WEIGHTS, "composite")


@query("score_half_cleaned", f"""
WITH {CLEANED}, {HALF}, {_score_sql('half', HALF_STEPS, types='5 / 6.0')}
SELECT {_DIMENSIONS}, CAST(greatest(extra, 0) AS BIGINT) AS extra_rows, 0 AS dropped_columns,
  0 AS extra_columns, round({_COMPOSITE}, 6) AS composite FROM s""".replace(
    "t.o_orderdate IS NOT DISTINCT FROM c.o_orderdate", "t.o_orderdate IS NOT DISTINCT FROM CAST(c.o_orderdate AS TIMESTAMP)"))
def score_half_cleaned(spark, folder):
    """Every dimension lies strictly between 0 and 1."""
    current = materialized(half_cleaned(spark, folder), "half")
    return _rounded(_score(spark, folder, current, HALF_STEPS, dates=True), *Q.WEIGHTS, "composite")


_REPORT_LINES = " UNION ALL ".join(
    f"""SELECT '{d}' AS dimension, CAST({w} AS DOUBLE) AS weight, round(CAST({d} AS DOUBLE), 6) AS score,
    round({d} * CAST({w} AS DOUBLE), 6) AS weighted FROM s""" for d, w in _SQL_WEIGHTS.items()
)


@query("score_report", f"""
WITH {CLEANED}, {_score_sql('cleaned', len(CLEANING))}
{_REPORT_LINES} UNION ALL SELECT 'composite', CAST(1 AS DOUBLE), round({_COMPOSITE}, 6), round({_COMPOSITE}, 6) FROM s""")
def score_report(spark, folder):
    report = Q.score_report(_score(spark, folder, cleaned(spark, folder)))
    return report.withColumns({c: F.round(c, 6) for c in ("weight", "score", "weighted")})




def _progress_query(name: str, dimension: str, fact: str, short: str) -> None:
    def build(spark, folder):
        tables = {
            "b": D.orders_dirty(spark, folder),
            "c": half_cleaned(spark, folder),
            "t": table(spark, folder, "orders"),
        }
        facts = side_by_side({n: Q.table_facts(df) for n, df in tables.items()})
        value = Q.progress(*[F.col(f"{n}.{fact}") for n in "bct"])
        return facts.select(F.round(value, 6).alias(dimension))

    query(name, f"""
WITH {CLEANED}, {HALF}, {_facts_sql('b', 'orders_dirty')}, {_facts_sql('c', 'half')}, {_facts_sql('t', 'orders')}
SELECT round(CAST({_progress_sql(short)} AS DOUBLE), 6) AS {dimension} FROM b, c, t""")(build)


_progress_query("score_missing", "missing_fixed", "missing_cells", "m")
_progress_query("score_duplicates", "duplicates_removed", "duplicates", "d")


@query("score_preservation", f"""
WITH {CLEANED}, {HALF}
SELECT (SELECT count(*) FROM half) / CAST(count(*) AS DOUBLE) AS data_preservation FROM orders""")
def score_preservation(spark, folder):
    tables = {"c": half_cleaned(spark, folder), "t": table(spark, folder, "orders")}
    rows = side_by_side({n: df.agg(F.count(F.lit(1)).alias("rows")) for n, df in tables.items()})
    return rows.select(Q.preservation(F.col("c.rows"), F.col("t.rows")).alias("data_preservation"))


@query("score_compliance", f"""
WITH {CLEANED} SELECT round(({compliance_sql('cleaned')}), 6) AS compliance""")
def score_compliance(spark, folder):
    return _rounded(rules_compliance(cleaned(spark, folder), D.ORDER_RULES), "compliance")


_EFFECT = """CASE WHEN after - before > 0 THEN least(0.15, (after - before) * 2 + 0.03)
  WHEN after - before < -0.01 THEN greatest(-0.20, (after - before) * 2) ELSE 0.001 END"""
_DELTA_LINES = " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, CAST(s0.{d} AS DOUBLE) AS before, CAST(s.{d} AS DOUBLE) AS after FROM s0, s"
    for d in _SQL_WEIGHTS
)


def _renamed(ctes: str) -> str:
    """The score CTEs of the table before the step, under their own names."""
    out = ctes
    for name in "bcta":
        out = out.replace(f"{name} AS (SELECT count(*)", f"{name}0 AS (SELECT count(*)")
    out = out.replace("golden AS (SELECT * FROM orders", "golden0 AS (SELECT * FROM orders")
    return out.replace("FROM b, c, t, a)", "FROM b0 AS b, c0 AS c, t0 AS t, a0 AS a)").replace("\ns AS", "\ns0 AS")


@query("quality_delta", f"""
WITH {CLEANED}, {_score_sql('cleaned', len(CLEANING))}, {_renamed(_score_sql('orders_dirty', 0))},
d AS ({_DELTA_LINES} UNION ALL SELECT 'composite',
  (SELECT {_COMPOSITE} FROM s0), (SELECT {_COMPOSITE} FROM s))
SELECT dimension, round(before, 6) AS before, round(after, 6) AS after, round(after - before, 6) AS delta,
  CASE WHEN dimension = 'composite' THEN round(CAST({_EFFECT} AS DOUBLE), 6) END AS effect FROM d""")
def quality_delta(spark, folder):
    before = _score(spark, folder, D.orders_dirty(spark, folder), steps=0)
    after = _score(spark, folder, cleaned(spark, folder))
    return _rounded(Q.quality_delta(before, after), "before", "after", "delta", "effect")


RETYPED = [
    step("fill_missing", column="o_orderkey", strategy="mean"),
    step("fix_dtype", column="o_custkey", target="float"),
    step("clip", column="o_custkey", lower=0, upper=1000),
    step("undo"), step("undo"),
]


@query("lineage_retyped", """
WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey % 7 = 2) AS gaps,
  count(*) FILTER (WHERE o_custkey > 1000) AS above FROM orders)
SELECT 1 AS step, 'fill_missing' AS op, true AS modified, n AS rows_before, n AS rows_after, gaps AS cells_changed FROM n
UNION ALL SELECT 2, 'fix_dtype', true, n, n, 0 FROM n
UNION ALL SELECT 3, 'clip', above > 0, n, n, above FROM n
UNION ALL SELECT 4, 'undo', true, n, n, 0 FROM n
UNION ALL SELECT 5, 'undo', true, n, n, 0 FROM n""")
def lineage_retyped(spark, folder):
    """Retyped columns are compared by value: only gaps and clipped cells count as changed."""
    orders = table(spark, folder, "orders")
    gaps = orders.withColumn("o_orderkey", F.when(F.col("o_orderkey") % 7 != 2, F.col("o_orderkey")))
    return recipe.lineage(gaps, RETYPED).drop("command")


# --- recipes and lineage -----------------------------------------------------


@query("recipe_run", f"WITH {CLEANED} SELECT * REPLACE (round(o_totalprice, 4) AS o_totalprice) FROM cleaned")
def recipe_run(spark, folder):
    return cleaned(spark, folder).withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("recipe_prefix", f"""WITH {CLEANED}
SELECT * REPLACE (round(o_totalprice, 4) AS o_totalprice) FROM c2""")
def recipe_prefix(spark, folder):
    """Two steps undone: the mode fill and the clip."""
    steps = recipe.undo(CLEANING, 2)
    undone = recipe.run(D.orders_dirty(spark, folder), steps)
    return undone.withColumn("o_totalprice", F.round("o_totalprice", 4))


LOGGED = [
    step("profile"),
    step("regex_replace", column="price_text", pattern=r"^\$", replacement=""),
    step("standardize", column="o_orderpriority", method="strip"),
    step("remove_duplicates"),
    step("fill_missing", column="o_orderpriority", strategy="constant", value="UNKNOWN"),
    step("remove_rows", column="o_totalprice", condition="less_than", value=0),
    step("undo"),
    step("replace", column="o_orderstatus", old="X", new="Y"),
]

_LOG = f"""{S.ORDERS_DIRTY},
d AS (SELECT DISTINCT * REPLACE ({S.strip('o_orderpriority')} AS o_orderpriority,
  regexp_replace(price_text, '^\\$', '') AS price_text) FROM orders_dirty),
n AS (SELECT (SELECT count(*) FROM orders_dirty) AS raw, (SELECT count(*) FROM d) AS uniq,
  (SELECT count(*) FROM d WHERE o_totalprice < 0) AS neg,
  (SELECT count(*) FROM orders_dirty WHERE price_text LIKE '$%') AS dollars,
  (SELECT count(*) FROM orders_dirty WHERE {S.strip('o_orderpriority')} <> o_orderpriority) AS blanks,
  (SELECT count(*) FROM d WHERE o_orderpriority IS NULL) AS gaps),
log AS (
  SELECT 1 AS step, 'profile' AS op, raw AS rows_before, raw AS rows_after, CAST(0 AS BIGINT) AS cells_changed FROM n
  UNION ALL SELECT 2, 'regex_replace', raw, raw, dollars FROM n
  UNION ALL SELECT 3, 'standardize', raw, raw, blanks FROM n
  UNION ALL SELECT 4, 'remove_duplicates', raw, uniq, 0 FROM n
  UNION ALL SELECT 5, 'fill_missing', uniq, uniq, gaps FROM n
  UNION ALL SELECT 6, 'remove_rows', uniq, uniq - neg, 0 FROM n
  UNION ALL SELECT 7, 'undo', uniq - neg, uniq, 0 FROM n
  UNION ALL SELECT 8, 'replace', uniq, uniq, 0 FROM n)"""


@query("lineage_log", f"""WITH {_LOG}
SELECT step, op, cells_changed > 0 OR rows_before <> rows_after OR op = 'undo' AS modified, rows_before, rows_after,
  cells_changed FROM log""")
def lineage_log(spark, folder):
    return recipe.lineage(D.orders_dirty(spark, folder), LOGGED).drop("command")


@query("lineage_summary", f"""WITH {_LOG}, f AS (
  SELECT *, cells_changed > 0 OR rows_before <> rows_after OR op = 'undo' AS modified FROM log)
SELECT count(*) AS steps, count(*) FILTER (WHERE NOT modified) AS read_only_steps,
  count(*) FILTER (WHERE modified) AS modifying_steps, count(*) FILTER (WHERE op = 'undo') AS undo_steps,
  CAST(sum(CASE WHEN op <> 'undo' THEN rows_after - rows_before ELSE 0 END) AS BIGINT) AS row_delta FROM f""")
def lineage_summary(spark, folder):
    return recipe.lineage_summary(recipe.lineage(D.orders_dirty(spark, folder), LOGGED))
