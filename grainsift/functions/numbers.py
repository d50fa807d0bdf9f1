"""Numeric conversions that yield NULL instead of failing."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .schema import col, is_number, is_text, is_time, require, type_of, typed_literal

# Fixed value: the number spellings that count as numeric text.
NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
# Fixed value: the characters removed before text is read as a number.
NON_NUMBER_CHARS = r"[^0-9.\-]"


def parse_number(text: Column) -> Column:
    """Text to DOUBLE; anything that is not plainly a finite number becomes NULL."""
    return F.when(text.rlike(NUMERIC_TEXT), finite(F.trim(text).try_cast("double")))


def finite(x: Column) -> Column:
    """DOUBLE with NaN and infinities turned into NULL."""
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def number(df: DataFrame, name: str) -> Column:
    """Column ``name`` as DOUBLE-or-NULL, whatever its stored type."""
    require(df, name)
    return number_of(col(name), type_of(df, name))


def number_of(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c.cast("double"))
    if is_number(dtype) or isinstance(dtype, T.BooleanType):
        return c.cast("double")
    if is_text(dtype):
        return parse_number(c)
    return F.lit(None).cast("double")


def comparable(df: DataFrame, name: str) -> Column:
    """The column in a type that has an order, without a detour through DOUBLE.

    Whole numbers, decimals, dates and timestamps stay as they are, text is read as a
    number, NaN is NULL. Other types are refused.
    """
    require(df, name)
    dtype = type_of(df, name)
    if isinstance(dtype, (T.IntegralType, T.DecimalType)) or is_time(dtype):
        return col(name)
    if is_number(dtype) or is_text(dtype) or isinstance(dtype, T.BooleanType):
        return number(df, name)
    raise ValueError(f"column {name!r} of type {dtype.simpleString()} has no order to check")


def bound_literal(value: object, dtype: T.DataType, is_lower: bool) -> Column | None:
    """A bound as a literal that meets the column in its own type; None for no bound.

    A fractional bound of a whole-number column becomes the next whole number inside.
    """
    if value is None or isinstance(value, float) and math.isinf(value):
        return None
    if is_time(dtype):
        return typed_literal(value, dtype)
    if isinstance(dtype, (T.IntegralType, T.DecimalType)):
        exact = Decimal(str(value))
        if isinstance(dtype, T.IntegralType):
            exact = Decimal(math.ceil(exact) if is_lower else math.floor(exact))
        if isinstance(dtype, T.IntegralType) and -(2**63) <= exact < 2**63:
            return F.lit(int(exact)).cast("bigint")
        return F.lit(exact)
    return F.lit(float(value))


def inside(df: DataFrame, name: str, low: object, high: object) -> Column:
    """Whether a comparable cell lies in [low, high]; NULL where it is missing."""
    x, dtype = comparable(df, name), type_of(df, name)
    checks = [x >= bound for bound in [bound_literal(low, dtype, True)] if bound is not None]
    checks += [x <= bound for bound in [bound_literal(high, dtype, False)] if bound is not None]
    ok = F.when(x.isNotNull(), F.lit(True))
    for check in checks:
        ok = ok & check
    return ok


def missing(df: DataFrame, name: str) -> Column:
    """True where the cell is missing: NULL, or NaN in a floating column."""
    c = col(name)
    if isinstance(type_of(df, name), (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def to_float(df: DataFrame, name: str) -> Column:
    """DOUBLE: numeric columns are cast, text is stripped to digits, dot and minus first."""
    if is_text(type_of(df, name)):
        return parse_number(F.regexp_replace(col(name), NON_NUMBER_CHARS, ""))
    return number(df, name)


def to_int(df: DataFrame, name: str, rounding: str | None = None) -> Column:
    """BIGINT: as ``to_float``; fractions become NULL unless a rounding is named."""
    dtype = type_of(df, name)
    if isinstance(dtype, T.IntegralType):
        return col(name).cast("bigint")
    if is_text(dtype):
        digits = F.regexp_replace(col(name), NON_NUMBER_CHARS, "")
        # whole numbers in text keep all 19 digits; the double path would round them
        exact = F.when(digits.rlike(r"^-?\d+$"), digits.try_cast("bigint"))
        return F.coalesce(exact, _whole(parse_number(digits), rounding))
    if isinstance(dtype, T.DecimalType):
        return _whole(col(name), rounding)
    return _whole(number(df, name), rounding)


def _whole(x: Column, rounding: str | None) -> Column:
    ways = {
        None: F.when(x == F.floor(x), x),
        "floor": F.floor(x),
        "ceil": F.ceil(x),
        "nearest": F.rint(x),
        "truncate": F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)),
    }
    if rounding not in ways:
        raise ValueError(f"rounding must be one of {list(ways)}")
    in_range = F.abs(x) < F.lit(float(2**63))  # a decimal just below it is left to try_cast
    return F.when(in_range, ways[rounding].try_cast("bigint"))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole, rounded; NULL for an empty table."""
    return F.round(F.try_divide(part * F.lit(100.0), whole), digits)


def clamp(x: Column, low: float, high: float) -> Column:
    """``x`` limited to [low, high]; NULL stays NULL."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))
