"""Filling missing cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.frames import side_by_side
from ..functions.numbers import missing, number
from ..functions.schema import col, is_text, require, type_of, typed_literal
from .ordinal import forward_fill_column
from .quantiles import quantiles

STRATEGIES = ("mean", "median", "mode", "constant", "forward_fill")


def mean_value(df: DataFrame, column: str) -> DataFrame:
    """One row: the mean of the numeric cells."""
    return df.agg(F.avg(number(df, column)).alias("mean"))


def mode_value(df: DataFrame, column: str) -> DataFrame:
    """One row (none for an empty column): the most frequent value, ties to the smallest."""
    require(df, column)
    counts = (
        df.filter(~missing(df, column))
        .groupBy(col(column).alias("mode"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.orderBy(F.desc("n"), F.asc("mode")).limit(1)


def fill_missing(
    df: DataFrame, column: str, strategy: str, value: object = None, *,
    order_by: Sequence[str] = (), partition_by: Sequence[str] = (), approx: bool = False,
) -> DataFrame:
    """Fill missing cells by mean, median, mode, constant or forward_fill.

    Mean and median turn a text column into numbers, with cells that are no number
    filled too; a text column without any number is refused. Cells that are present
    keep their value exactly: BIGINT is widened to DECIMAL, not to DOUBLE. ``forward_fill`` needs
    ``order_by``. ``approx`` accepts an approximate median.

    Mean, median and mode are found at once by a small job and enter the plan as a
    literal, so that later uses of the result do not compute them again.
    """
    require(df, column)
    strategy = strategy.lower()
    if strategy in ("mean", "median"):
        _refuse_pure_text(df, column)
        x = number(df, column)
        if strategy == "mean":
            found = mean_value(df, column).first()["mean"]
        else:
            found = quantiles(df, column, [0.5], approx=approx)[0]
        return df.withColumn(column, F.coalesce(*_widened(df, column, x, found)))
    if strategy == "mode":
        row = mode_value(df, column).first()
        fill = F.lit(row["mode"] if row else None).cast(type_of(df, column))
        return df.withColumn(column, _filled(df, column, fill))
    if strategy == "constant":
        if value is None:
            raise ValueError("strategy 'constant' needs a value")
        return df.withColumn(column, _filled(df, column, typed_literal(value, type_of(df, column))))
    if strategy == "forward_fill":
        return forward_fill_column(df, column, order_by, partition_by)
    raise ValueError(f"unknown strategy {strategy!r}; use one of {STRATEGIES}")


def _widened(df: DataFrame, column: str, x: Column, found: float | None) -> tuple[Column, Column]:
    """Cell and fill value in one type that keeps every cell that is present.

    Decimals keep their type (the fill value is rounded to their scale), BIGINT becomes a
    decimal with ten places; all else fits DOUBLE without loss.
    """
    dtype = type_of(df, column)
    if isinstance(dtype, T.DecimalType):
        return col(column), F.lit(found).cast("double").cast(dtype)
    if isinstance(dtype, T.LongType):
        return col(column).cast("decimal(29,10)"), F.lit(found).cast("double").cast("decimal(29,10)")
    return x, F.lit(found).cast("double")


def _filled(df: DataFrame, column: str, fill: Column) -> Column:
    return F.when(missing(df, column), fill).otherwise(col(column))


def _refuse_pure_text(df: DataFrame, column: str) -> None:
    if is_text(type_of(df, column)):
        numeric = df.filter(number(df, column).isNotNull())
        if numeric.isEmpty() and not df.filter(col(column).isNotNull()).isEmpty():
            raise ValueError(f"column {column!r} holds no numbers")


def fill_report(df: DataFrame, column: str, strategy: str, value: object = None, **options) -> DataFrame:
    """One row: missing cells before, filled cells and remaining missing cells."""
    filled = fill_missing(df, column, strategy, value, **options)
    both = side_by_side({
        "b": df.agg(F.count_if(missing(df, column)).alias("n")),
        "a": filled.agg(F.count_if(missing(filled, column)).alias("n")),
    })
    return both.select(
        F.lit(column).alias("column"),
        F.col("b.n").alias("missing_before"),
        (F.col("b.n") - F.col("a.n")).alias("filled"),
        F.col("a.n").alias("remaining"),
    )
