"""Operators that change one column and keep every row."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import numbers, text
from ..functions.dates import DATE_FORMATS, parse_timestamp
from ..functions.schema import col, is_text, is_time, require, type_of, typed_literal


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    require(df, old)
    if new in df.columns:
        raise ValueError(f"column {new!r} already exists")
    return df.withColumnRenamed(old, new)


def drop_column(df: DataFrame, column: str) -> DataFrame:
    require(df, column)
    return df.drop(column)


def cast_expr(
    df: DataFrame, column: str, target: str, *,
    rounding: str | None = None, formats: Sequence[str] = DATE_FORMATS,
) -> Column:
    """The cast used by :func:`fix_dtype`, as an expression."""
    require(df, column)
    if target in ("int", "int64"):
        return numbers.to_int(df, column, rounding)
    if target in ("float", "float64"):
        return numbers.to_float(df, column)
    if target in ("str", "string", "object"):
        return col(column).cast("string")
    if target in ("datetime", "date"):
        if is_text(type_of(df, column)):
            return parse_timestamp(col(column), formats)
        return col(column).cast("timestamp_ntz")
    raise ValueError(f"unknown type {target!r}; use int, float, str or datetime")


def fix_dtype(df: DataFrame, column: str, target: str, **options) -> DataFrame:
    """Cast to int, float, str or datetime; cells that do not convert become NULL."""
    return df.withColumn(column, cast_expr(df, column, target.lower(), **options))


def coercion_report(df: DataFrame, column: str, target: str, **options) -> DataFrame:
    """One row: cells present before the cast, and cells the cast would lose."""
    before, after = col(column), cast_expr(df, column, target.lower(), **options)
    return df.agg(
        F.lit(column).alias("column"),
        F.lit(target).alias("target"),
        F.count(before).alias("non_null"),
        F.count_if(before.isNotNull() & after.isNull()).alias("coercion_errors"),
    )


def replace_value(df: DataFrame, column: str, old: object, new: object) -> DataFrame:
    """Replace cells equal to ``old``, compared in the type of the column."""
    return replace_values(df, column, {old: new})


def replace_values(df: DataFrame, column: str, mapping: Mapping) -> DataFrame:
    """Replace several values in one pass; no replacement feeds another."""
    require(df, column)
    dtype, cell = type_of(df, column), col(column)
    out = cell
    for old, new in mapping.items():
        out = F.when(cell == typed_literal(old, dtype), typed_literal(new, dtype)).otherwise(out)
    return df.withColumn(column, out)


def regex_replace(df: DataFrame, column: str, pattern: str, replacement: str) -> DataFrame:
    r"""Replace every match; ``\1`` in the replacement is the first group."""
    require(df, column)
    java = text.java_pattern(pattern)
    text.check_pattern(df.sparkSession, java)
    cell = col(column).cast("string")
    return df.withColumn(column, F.regexp_replace(cell, java, text.java_replacement(replacement)))


_STANDARD = {
    "lowercase": F.lower,
    "uppercase": F.upper,
    "titlecase": text.title,
    "strip": text.strip,
}


def standard_expr(df: DataFrame, column: str, method: str) -> Column:
    require(df, column)
    if method not in _STANDARD:
        raise ValueError(f"unknown method {method!r}; use one of {list(_STANDARD)}")
    return _STANDARD[method](col(column).cast("string"))


def standardize(df: DataFrame, column: str, method: str) -> DataFrame:
    """lowercase, uppercase, titlecase or strip; NULL stays NULL."""
    return df.withColumn(column, standard_expr(df, column, method.lower()))


def consolidation_report(df: DataFrame, column: str, method: str) -> DataFrame:
    """Distinct values before and after :func:`standardize`.

    The table is reduced to its distinct values first, so the second count runs on
    those alone and a frequent value costs one row per task.
    """
    new = standard_expr(df, column, method.lower())
    values = df.select(col(column).alias("old"), new.alias("new")).distinct()
    return values.agg(
        F.lit(column).alias("column"),
        F.count("old").alias("before"),
        F.count_distinct("new").alias("after"),
    ).withColumn("consolidated", F.col("before") - F.col("after"))


def _clip_bounds(lower: object, upper: object, dtype: T.DataType) -> tuple[Column | None, Column | None]:
    if not is_time(dtype) and float(lower) > float(upper) or is_time(dtype) and lower > upper:
        raise ValueError("lower bound is above the upper bound")
    return numbers.bound_literal(lower, dtype, True), numbers.bound_literal(upper, dtype, False)


def _is_whole(bound: object) -> bool:
    return math.isinf(float(bound)) or float(bound).is_integer()


def clip(df: DataFrame, column: str, lower: object, upper: object) -> DataFrame:
    """Limit numbers or times to [lower, upper]; text that is no number becomes NULL.

    The type stays, and so do cells inside the bounds, unless a whole-number column meets
    a fractional bound (then it becomes DOUBLE) or the column is text.
    """
    dtype = type_of(df, column)
    low, high = _clip_bounds(lower, upper, dtype)
    exact = isinstance(dtype, T.IntegralType) and _is_whole(lower) and _is_whole(upper)
    if exact or isinstance(dtype, T.DecimalType) or is_time(dtype):
        x = col(column)
        if low is not None:
            x = F.when(x < low, low).otherwise(x)
        if high is not None:
            x = F.when(x > high, high).otherwise(x)
        return df.withColumn(column, x.cast(dtype))
    limited = numbers.clamp(numbers.number(df, column), float(lower), float(upper))
    return df.withColumn(column, limited.cast("float") if isinstance(dtype, T.FloatType) else limited)


def clip_report(df: DataFrame, column: str, lower: object, upper: object) -> DataFrame:
    """One row: how many cells lie outside [lower, upper]."""
    return df.agg(
        F.lit(column).alias("column"),
        F.count_if(~numbers.inside(df, column, lower, upper)).alias("clipped"),
    )


def change_report(df: DataFrame, column: str, changed: DataFrame | Column) -> DataFrame:
    """One row: cells of ``column`` that the new expression would change (null-safe)."""
    require(df, column)
    return df.agg(
        F.lit(column).alias("column"),
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~col(column).eqNullSafe(changed)).alias("changed"),
    )
