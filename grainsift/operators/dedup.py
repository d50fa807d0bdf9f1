"""Duplicate rows: counts, members, removal. NULLs compare equal throughout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import compact_keys
from ..functions.numbers import percent
from ..functions.schema import col, groupable
from .skew import join_unique

_N = "__n"


def _keys(df: DataFrame, subset: Sequence[str] | None) -> list[str]:
    return groupable(df, subset if subset else df.columns)


def group_sizes(
    df: DataFrame, subset: Sequence[str] | None = None, extra: Sequence[Column] = ()
) -> DataFrame:
    """The row count ``__n`` of each distinct key, with ``extra`` aggregates per key.

    Copies collapse before the shuffle, and long texts travel as a digest.
    """
    keys = compact_keys(df, _keys(df, subset))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(_N), *extra)


def duplicate_report(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """One row: rows, duplicate rows beyond the first, members of duplicate groups."""
    n = F.col(_N)
    totals = group_sizes(df, subset).agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(n - 1), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("members"),
        F.count_if(n > 1).alias("groups"),
    )
    return totals.withColumn("duplicate_pct", percent(F.col("duplicates"), F.col("rows")))


def duplicate_members(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Every row that shares its key with another row.

    Keys are counted with partial aggregation and joined back, so no task holds a
    whole group; frequent keys are salted in the join.
    """
    keys = compact_keys(df, _keys(df, subset))
    names = [f"__k{i}" for i in range(len(keys))]
    repeated = group_sizes(df, subset).filter(F.col(_N) > 1).select(*names)
    keyed = df.select("*", *keys)
    return join_unique(keyed, repeated, names, "left_semi").drop(*names)


def remove_duplicates(
    df: DataFrame, subset: Sequence[str] | None = None, keep: str = "first",
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Keep the first, the last or none of each group of rows with equal keys.

    ``first`` and ``last`` need an order unless whole rows are compared (then all
    copies are the same row). Ties in the order are broken by the remaining columns.
    """
    keys = _keys(df, subset)
    if keep not in ("first", "last", "none"):
        raise ValueError(f"keep must be 'first', 'last' or 'none', not {keep!r}")
    if keep == "none":
        return _unrepeated(df, keys)
    if set(keys) == set(df.columns):
        return df.dropDuplicates()
    if not order_by:
        raise ValueError("keep='first' or 'last' on a subset needs order_by")
    rest = [c for c in df.columns if c not in order_by and c not in keys]
    order = [col(c) for c in (*groupable(df, order_by), *groupable(df, rest))]
    order = [c.asc_nulls_last() if keep == "first" else c.desc_nulls_first() for c in order]
    # filtering row_number directly lets Spark keep one row per key before the shuffle
    w = Window.partitionBy(*[col(c) for c in keys]).orderBy(*order)
    return df.withColumn(_N, F.row_number().over(w)).filter(F.col(_N) == 1).drop(_N)


def _unrepeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs once: keys are counted alone and joined back.

    Counting moves compact keys only and collapses copies first; of the keys that are left
    each meets one row, so the join has no hot key.
    """
    compact = compact_keys(df, keys)
    names = [f"__k{i}" for i in range(len(compact))]
    single = group_sizes(df, keys).filter(F.col(_N) == 1).drop(_N)
    single = single.withColumnsRenamed({n: f"__s{i}" for i, n in enumerate(names)})
    same = None
    for i, n in enumerate(names):
        equal = F.col(n).eqNullSafe(F.col(f"__s{i}"))
        same = equal if same is None else same & equal
    return df.select("*", *compact).join(single, same, "left_semi").drop(*names)
