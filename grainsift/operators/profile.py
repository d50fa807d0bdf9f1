"""Table and column profiles, missing-value and outlier reports."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.frames import literal_rows
from ..functions.hashing import distinct_text
from ..functions.numbers import comparable, missing, number, percent
from ..functions.schema import col, is_number, require, type_of
from .dedup import duplicate_report
from .quantiles import quantiles

TOP_VALUES = 10  # fixed value: length of the frequency list
OUTLIER_EXAMPLES = 15  # fixed value: outlier values shown
IQR_FACTOR = 1.5  # fixed value: whisker length


def _cell_text(df: DataFrame, name: str) -> Column:
    """Cell as text for counting distinct values; missing cells are NULL."""
    return F.when(~missing(df, name), distinct_text(col(name), type_of(df, name)))


def profile_table(df: DataFrame, *, approx: bool = False) -> DataFrame:
    """One row per column: type, non-null, missing, missing %, distinct values.

    Cells are counted per (column, value) in one shuffle, so a frequent value costs
    one row per task. ``approx`` estimates the distinct counts without a shuffle.
    """
    if approx:
        return _profile_approx(df)
    texts = df.select(*[_cell_text(df, c).alias(str(i)) for i, c in enumerate(df.columns)])
    cells = texts.unpivot([], texts.columns, "position", "value")
    counts = cells.groupBy("position", "value").agg(F.count(F.lit(1)).alias("n"))
    present = F.col("value").isNotNull()
    per_column = counts.groupBy("position").agg(
        F.sum(F.when(present, F.col("n")).otherwise(0)).alias("non_null"),
        F.sum(F.when(present, 0).otherwise(F.col("n"))).alias("missing"),
        F.count("value").alias("distinct_values"),
    )
    per_column = per_column.withColumn("position", F.col("position").cast("int"))
    names = literal_rows(
        df.sparkSession,
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        "position int, column string, type string",
    )
    filled = [
        F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("non_null", "missing", "distinct_values")
    ]
    return _with_share(names.join(per_column, "position", "left").select(*names.columns, *filled))


def _profile_approx(df: DataFrame) -> DataFrame:
    aggs = []
    for i, f in enumerate(df.schema.fields):
        gone = missing(df, f.name)
        aggs.append(F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.count_if(~gone).alias("non_null"),
            F.count_if(gone).alias("missing"),
            F.approx_count_distinct(_cell_text(df, f.name)).alias("distinct_values"),
        ))
    return _with_share(df.agg(F.array(*aggs).alias("c")).selectExpr("inline(c)"))


def _with_share(profile: DataFrame) -> DataFrame:
    total = F.col("non_null") + F.col("missing")
    return profile.select(
        "position", "column", "type", "non_null", "missing",
        percent(F.col("missing"), total).alias("missing_pct"), "distinct_values",
    )


def table_shape(df: DataFrame) -> DataFrame:
    """One row: rows, columns, duplicate rows and their share."""
    return duplicate_report(df).select(
        "rows", F.lit(len(df.columns)).alias("columns"), "duplicates", "duplicate_pct"
    )


def profile_numeric(df: DataFrame, column: str, *, approx: bool = False) -> DataFrame:
    """One row: counts, distinct values, min, max, mean, sample deviation, median.

    Distinct values, min and max are those of the column's own type; ``approx`` estimates
    the distinct count and the median.
    """
    x, exact = number(df, column), comparable(df, column)
    median = quantiles(df, column, [0.5], approx=approx)[0]
    rows = F.count(F.lit(1))
    return df.agg(
        F.lit(column).alias("column"),
        F.lit(type_of(df, column).simpleString()).alias("type"),
        F.count(x).alias("non_null"),
        (rows - F.count(x)).alias("missing"),
        percent(rows - F.count(x), rows).alias("missing_pct"),
        (F.approx_count_distinct(exact) if approx else F.count_distinct(exact)).alias("distinct_values"),
        F.min(exact).alias("min"),
        F.max(exact).alias("max"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.lit(median).cast("double").alias("median"),
    )


def profile_column(df: DataFrame, column: str, *, approx: bool = False) -> DataFrame:
    """Statistics of a numeric column, or counts and distinct values of any other."""
    require(df, column)
    if is_number(type_of(df, column)):
        return profile_numeric(df, column, approx=approx)
    return profile_table(df.select(col(column)), approx=approx).drop("position")


def top_values(df: DataFrame, column: str, n: int = TOP_VALUES) -> DataFrame:
    """The most frequent values with their counts, ties in value order."""
    require(df, column)
    counts = (
        df.filter(~missing(df, column))
        .groupBy(col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return counts.orderBy(F.desc("count"), F.asc("value")).limit(n)


CANDIDATES = 10_000  # values that the summary of the first pass keeps


def top_values_two_pass(
    df: DataFrame, column: str, n: int = TOP_VALUES, *, candidates: int = CANDIDATES
) -> DataFrame:
    """The same values and counts as :func:`top_values`, mostly without a shuffle of all values.

    The first pass keeps a bounded summary of frequent values (of long texts their digest). A
    value that is missing in it occurs at most so often as its error bound allows, a known
    share of the rows. The second pass counts the candidates exactly. If the n-th of them
    occurs more often than the bound, or the candidates are all values there are, the result
    is exact; else (a column of nearly unique values) all values are counted.
    """
    require(df, column)
    text = _cell_text(df, column)
    rows = df.select(text.alias("__key"), col(column).alias("value")).filter("__key is not null")
    total, found = rows.agg(
        F.count(F.lit(1)), F.expr(f"approx_top_k(__key, {candidates}, {candidates})")).first()
    keys = [(r["item"],) for r in found or []]  # ``candidates`` short texts at most
    if keys:
        known = F.broadcast(df.sparkSession.createDataFrame(keys, "__key string"))
        counted = rows.join(known, "__key", "left_semi").groupBy("__key").agg(
            F.min("value").alias("value"), F.count(F.lit(1)).alias("count"))
        exact = counted.orderBy(F.desc("count"), F.asc("value")).limit(n).select("value", "count")
        counts = [r["count"] for r in exact.collect()]
        covered = counted.agg(F.sum("count")).first()[0] == total if len(counts) < n else False
        if covered or (len(counts) == n and counts[-1] > 2 * summary_error(candidates, total)):
            return exact
    return top_values(df, column, n)


def summary_error(candidates: int, rows: int) -> float:
    """How far counts in a summary of frequent items can be off: 3.5 rows per slot of its table."""
    slots = 2 ** math.ceil(math.log2(candidates / 0.75))
    return 3.5 / slots * rows


def missing_report(df: DataFrame) -> DataFrame:
    """Columns with missing cells, most first: count, share, and the table total."""
    counts = [F.count_if(missing(df, c)) for c in df.columns]
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[n.alias(f"m{i}") for i, n in enumerate(counts)])
    per_column = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing"))
        for i, c in enumerate(df.columns)
    ])
    total = sum((F.col(f"m{i}") for i in range(len(counts))), F.lit(0).cast("bigint"))
    return (
        one.select("rows", total.alias("total_missing"), F.explode(per_column).alias("c"))
        .filter("c.missing > 0")
        .select(
            "c.column", "c.missing",
            percent(F.col("c.missing"), F.col("rows")).alias("missing_pct"), "total_missing",
        )
        .orderBy(F.desc("missing"), F.asc("column"))
    )


@dataclass(frozen=True)
class Whiskers:
    """Quartiles of a column and the bounds beyond which a number is an outlier."""

    q1: float | None
    q3: float | None

    @property
    def iqr(self) -> float | None:
        return None if self.q1 is None else self.q3 - self.q1

    @property
    def lower(self) -> float | None:
        return None if self.q1 is None else self.q1 - IQR_FACTOR * self.iqr

    @property
    def upper(self) -> float | None:
        return None if self.q1 is None else self.q3 + IQR_FACTOR * self.iqr

    def outside(self, x: Column) -> Column:
        if self.q1 is None:
            return F.lit(False)
        return F.coalesce((x < self.lower) | (x > self.upper), F.lit(False))


def whiskers(df: DataFrame, column: str, *, approx: bool = False) -> Whiskers:
    return Whiskers(*quantiles(df, column, [0.25, 0.75], approx=approx))


def outlier_report(df: DataFrame, column: str, *, approx: bool = False) -> DataFrame:
    """One row: quartiles, bounds and the number of values outside them."""
    w = whiskers(df, column, approx=approx)
    named = {"q1": w.q1, "q3": w.q3, "iqr": w.iqr, "lower": w.lower, "upper": w.upper}
    return df.agg(
        F.lit(column).alias("column"),
        *[F.lit(v).cast("double").alias(k) for k, v in named.items()],
        F.count_if(w.outside(number(df, column))).alias("outliers"),
    )


def outlier_rows(df: DataFrame, column: str, *, approx: bool = False) -> DataFrame:
    """The rows whose number lies outside the bounds."""
    return df.filter(whiskers(df, column, approx=approx).outside(number(df, column)))


def outlier_examples(
    df: DataFrame, column: str, order_by: Sequence[str], n: int = OUTLIER_EXAMPLES
) -> DataFrame:
    """The first outlier values in row order."""
    rows = outlier_rows(df, column).orderBy(*[col(c) for c in order_by]).limit(n)
    return rows.select(*[col(c) for c in order_by], number(rows, column).alias("value"))
