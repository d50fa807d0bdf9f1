"""Reproducible pseudo-random choices from row keys, and short keys for long texts.

A choice depends only on the key, the seed and a tag, so it is the same on any
partitioning and after any task retry, and any SQL engine with ``md5`` can repeat it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .schema import col, is_text, type_of


def digest(key: Column, seed: int, tag: str) -> Column:
    """Hex md5 of ``key|seed|tag``."""
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed)), F.lit(tag)))


def draw(key: Column, seed: int, tag: str) -> Column:
    """A BIGINT in [0, 2**32) for the row."""
    return F.conv(F.substring(digest(key, seed, tag), 1, 8), 16, 10).cast("bigint")


def unit(key: Column, seed: int, tag: str) -> Column:
    """A DOUBLE in [0, 1) for the row."""
    return draw(key, seed, tag) / F.lit(float(2**32))


def selected(key: Column, seed: int, tag: str, rate: float) -> Column:
    """True where :func:`unit` is below ``rate``; never NULL.

    Eight hex digits compare like the numbers they stand for, so nothing is converted.
    """
    bound = math.ceil(rate * 2**32)
    if bound >= 2**32:
        return key.isNotNull()
    below = F.substring(digest(key, seed, tag), 1, 8) < F.lit(f"{max(bound, 0):08x}")
    return key.isNotNull() & below


LONG_TEXT = 64


def compact_text(text: Column) -> Column:
    """Text of at most 65 bytes that is equal exactly when the texts are.

    Longer texts become ``#`` and their SHA-256; with 65 bytes that form cannot be
    mistaken for a text that was left alone.
    """
    return F.when(F.octet_length(text) > LONG_TEXT, F.concat(F.lit("#"), F.sha2(text, 256))).otherwise(text)


def distinct_text(c: Column, dtype: T.DataType) -> Column:
    """Any cell as short text that is equal exactly when the cells are."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        c = c + F.lit(0).cast(dtype)  # removes the sign of zero
    elif isinstance(dtype, T.TimestampType):
        c = F.unix_micros(c)  # the printed form repeats when clocks go back
    elif isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        c = F.to_json(c, {"ignoreNullFields": "false"})
    return compact_text(c.cast("string"))


def compact_keys(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """Grouping columns ``__k0, __k1, ...`` for the named ones, with long texts shortened.

    Whole documents would otherwise be shuffled just to be compared.
    """
    return [
        (compact_text(col(n)) if is_text(type_of(df, n)) else col(n)).alias(f"__k{i}")
        for i, n in enumerate(names)
    ]
