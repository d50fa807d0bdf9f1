"""Operators that keep or order whole rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import text
from ..functions.numbers import bound_literal, number
from ..functions.schema import col, is_fractional, is_number, is_time, require, type_of, typed_literal

MAX_VIEW_ROWS = 50  # fixed value: the largest view

CONDITIONS = ("equals", "not_equals", "less_than", "greater_than", "contains")


def keep_condition(
    df: DataFrame, column: str, condition: str, value: object, *, keep_nulls: bool = False
) -> Column:
    """True for the rows that :func:`remove_rows` keeps.

    A NULL cell meets ``not_equals`` (it is not the value) unless ``keep_nulls``, and
    no other condition. Comparisons are written so that the scan can use them.
    """
    require(df, column)
    cell, dtype = col(column), type_of(df, column)
    if condition == "equals":
        return cell.isNull() | (cell != typed_literal(value, dtype))
    if condition == "not_equals":
        same = cell == typed_literal(value, dtype)
        return same | cell.isNull() if keep_nulls else same
    if condition in ("less_than", "greater_than"):
        return _within(df, column, value, condition == "less_than")
    if condition == "contains":
        pattern = "(?iu)" + text.java_pattern(str(value))
        text.check_pattern(df.sparkSession, pattern)
        return ~F.coalesce(cell.cast("string").rlike(pattern), F.lit(False))
    raise ValueError(f"unknown condition {condition!r}; use one of {CONDITIONS}")


def _within(df: DataFrame, column: str, bound: object, is_lower: bool) -> Column:
    """Cells on the kept side of the bound, and cells that are missing or no number.

    Numbers, dates and timestamps meet the bound in their own type, which lets a scan use it.
    """
    cell, dtype = col(column), type_of(df, column)
    if not is_time(dtype):
        try:
            float(bound)
        except (TypeError, ValueError) as err:
            raise ValueError(f"{bound!r} is not a number") from err
    limit = bound_literal(bound, dtype, is_lower)
    if limit is None:  # nothing lies beyond an endless bound on its own side
        limit = F.lit(float(bound))
    if is_time(dtype) or is_number(dtype) and (is_lower or not is_fractional(dtype) or isinstance(dtype, T.DecimalType)):
        # NaN sorts above every number
        return cell.isNull() | (cell >= limit if is_lower else cell <= limit)
    x = number(df, column)
    return F.coalesce(x >= limit if is_lower else x <= limit, F.lit(True))


def remove_rows(
    df: DataFrame, column: str, condition: str, value: object, *, keep_nulls: bool = False
) -> DataFrame:
    """Drop the rows that meet the condition."""
    return df.filter(keep_condition(df, column, condition.lower(), value, keep_nulls=keep_nulls))


def sort_rows(
    df: DataFrame, column: str, direction: str = "asc", tie_break: Sequence[str] = ()
) -> DataFrame:
    """Sort with NULLs last in both directions; tie-break columns follow the direction."""
    require(df, column, *tie_break)
    descending = direction.lower() == "desc"
    keys = [col(c) for c in (column, *tie_break)]
    return df.orderBy(
        *[k.desc_nulls_last() if descending else k.asc_nulls_last() for k in keys]
    )


def view_rows(df: DataFrame, n: int = 10, order_by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows in the given order; more than 50 are refused."""
    if not 0 <= n <= MAX_VIEW_ROWS:
        raise ValueError(f"n must be from 0 to {MAX_VIEW_ROWS}")
    require(df, *order_by)
    ordered = df.orderBy(*[col(c).asc_nulls_last() for c in order_by]) if order_by else df
    return ordered.limit(n)
