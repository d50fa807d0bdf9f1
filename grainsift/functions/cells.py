"""Cell comparison: equality after normalisation, and near-equality of numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from .dates import parse_timestamp
from .numbers import number_of
from .schema import is_fractional, is_number, is_text
from .text import strip

# Relative tolerance and the credit a near-equal number earns.
TOLERANCE = 0.01
NEAR_CREDIT = 0.8


def folded(c: Column, dtype: T.DataType) -> Column:
    """Text of a cell with surrounding space and letter case removed."""
    return F.lower(strip(c)) if is_text(dtype) else c.cast("string")


def cell_equal(
    a: Column, a_type: T.DataType, b: Column, b_type: T.DataType,
    *, strict_text: bool = False, dates: bool = False,
) -> Column:
    """Null-safe equality of two cells; never NULL.

    Numbers compare by value and text by folded text. ``strict_text`` compares the
    printed form instead, where a whole-number column never equals a fractional one.
    ``dates`` reads text as a date when the other side is one.
    """
    stamps = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if is_number(a_type) and is_number(b_type):
        if strict_text and is_fractional(a_type) != is_fractional(b_type):
            return a.isNull() & b.isNull()
        return number_or_null(a, a_type).eqNullSafe(number_or_null(b, b_type))
    if isinstance(a_type, stamps) and isinstance(b_type, stamps):
        return a.cast("timestamp_ntz").eqNullSafe(b.cast("timestamp_ntz"))
    if dates and (isinstance(a_type, stamps) or isinstance(b_type, stamps)):
        return _as_stamp(a, a_type).eqNullSafe(_as_stamp(b, b_type)) & (a.isNull() == b.isNull())
    if not strict_text and is_number(a_type) != is_number(b_type):
        x, y = number_of(a, a_type), number_of(b, b_type)
        gone = number_or_null(a, a_type).isNull() & number_or_null(b, b_type).isNull()
        return gone | F.coalesce(x == y, F.lit(False))
    alike = folded(a, a_type).eqNullSafe(folded(b, b_type))
    # most text cells are identical, which is cheaper to see than to fold both
    return a.eqNullSafe(b) | alike if is_text(a_type) and is_text(b_type) else alike


def number_or_null(c: Column, dtype: T.DataType) -> Column:
    """A number cell with NaN read as missing; other numeric types are unchanged."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    return c


def _as_stamp(c: Column, dtype: T.DataType) -> Column:
    return parse_timestamp(c) if is_text(dtype) else c.cast("timestamp_ntz")


def cell_score(
    truth: Column, truth_type: T.DataType, current: Column, current_type: T.DataType,
    *, strict_text: bool = False, dates: bool = False,
) -> Column:
    """1 for an equal cell, 0.8 for a number within 1 % of a non-zero truth, else 0."""
    equal = cell_equal(
        truth, truth_type, current, current_type, strict_text=strict_text, dates=dates
    )
    t, v = number_of(truth, truth_type), number_of(current, current_type)
    near = F.try_divide(F.abs(t - v), F.abs(t)) < TOLERANCE  # NULL for a zero truth
    return F.when(equal, 1.0).when(near, NEAR_CREDIT).otherwise(0.0)


def match_form(
    c: Column, dtype: T.DataType, pair: tuple[T.DataType, T.DataType], *, dates: bool = False
) -> Column:
    """Text that is the same for any two cells of the type pair that compare equal.

    It may also be the same for unequal cells; it serves to find candidates.
    """
    stamps = [isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) for t in pair]
    if any(is_number(t) for t in pair):
        # equal numbers of any type are equal doubles; adding 0 removes the sign of zero
        x = number_of(c, dtype) + F.lit(0.0)
        return F.coalesce(x.cast("string"), F.when(number_or_null(c, dtype).isNotNull(), "?"))
    if all(stamps) or (dates and any(stamps)):
        return F.when(c.isNotNull(), F.coalesce(_as_stamp(c, dtype).cast("string"), F.lit("?")))
    return folded(c, dtype)
