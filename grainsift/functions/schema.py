"""Schema helpers: name checks, type families, typed literals."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F, types as T


def quoted(name: str) -> str:
    """Back-quoted column name, safe for spaces and dots."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def require(df: DataFrame, *names: str) -> None:
    """Raise unless every name is a column (names are case-sensitive)."""
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns {unknown}; available: {df.columns}")


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_time(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_fractional(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType))


def same_family(a: T.DataType, b: T.DataType) -> bool:
    """Equal types, both numeric (booleans count as numeric), or both text."""
    number_like = [is_number(t) or isinstance(t, T.BooleanType) for t in (a, b)]
    return a == b or all(number_like) or (is_text(a) and is_text(b))


def groupable(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The names, after checking that Spark can group by each of them."""
    names = list(names)
    require(df, *names)
    for n in names:
        if _holds_map(type_of(df, n)):
            raise ValueError(f"column {n!r} contains a map and cannot be compared for equality")
    return names


def _holds_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.MapType):
        return True
    if isinstance(dtype, T.ArrayType):
        return _holds_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_holds_map(f.dataType) for f in dtype.fields)
    return False


def typed_literal(value: object, dtype: T.DataType) -> Column:
    """``value`` as a literal of ``dtype``; raises when it does not fit the type."""
    try:
        parsed = _parse(value, dtype)
    except (ValueError, TypeError, ArithmeticError) as err:
        raise ValueError(f"{value!r} is not a {dtype.simpleString()}") from err
    return F.lit(parsed).cast(dtype)


def _parse(value: object, dtype: T.DataType) -> object:
    if value is None:
        return None
    if is_text(dtype):
        return str(value)
    if isinstance(dtype, T.IntegralType):
        number = Decimal(str(value))
        if number != number.to_integral_value():
            raise ValueError("not a whole number")
        bits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31}.get(type(dtype), 63)
        if not -(2**bits) <= int(number) < 2**bits:
            raise ValueError("out of range")
        return int(number)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return float(value)
    if isinstance(dtype, T.DecimalType):
        return Decimal(str(value))
    if isinstance(dtype, T.BooleanType):
        known = {"true": True, "false": False}
        if str(value).lower() not in known:
            raise ValueError("not a boolean")
        return known[str(value).lower()]
    if isinstance(dtype, T.DateType):
        return value if isinstance(value, dt.date) else dt.date.fromisoformat(str(value))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(str(value))
    raise ValueError("type has no literals here")
