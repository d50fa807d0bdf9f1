"""Comparing a table with its known-clean truth."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cells import cell_equal, cell_score, match_form
from ..functions.frames import literal_rows, side_by_side
from ..functions.schema import col, groupable, require, same_family, type_of
from ..session import materialized
from .dedup import remove_duplicates
from .positions import with_source_ordinal
from .ordinal import ROWS_PER_BUCKET, with_ordinal
from .skew import join_unique

GOLDEN_SHARE = 0.8  # fixed value: a golden row survives when more of its cells match


def common_columns(current: DataFrame, truth: DataFrame) -> list[str]:
    """Columns of both tables, in the order of the truth."""
    return [c for c in truth.columns if c in current.columns]


def type_report(current: DataFrame, truth: DataFrame) -> DataFrame:
    """One row per truth column: its type, the current type, and whether they agree.

    Only schemas are compared; no table is read.
    """
    rows = []
    for f in truth.schema.fields:
        here = type_of(current, f.name) if f.name in current.columns else None
        rows.append((
            f.name,
            f.dataType.simpleString(),
            here.simpleString() if here else None,
            bool(here and same_family(f.dataType, here)),
        ))
    schema = "column string, truth_type string, current_type string, matches boolean"
    return literal_rows(truth.sparkSession, rows, schema)


def type_share(current: DataFrame, truth: DataFrame) -> float:
    """Share of truth columns whose type family the current table keeps."""
    kept = [
        c for c in common_columns(current, truth)
        if same_family(type_of(truth, c), type_of(current, c))
    ]
    return len(kept) / len(truth.columns) if truth.columns else 1.0


def _scored(
    pairs: DataFrame, current: DataFrame, truth: DataFrame, columns: Sequence[str], options: dict
) -> DataFrame:
    """One row from paired rows; truth cells are named ``__t0, __t1, ...``."""
    score = F.lit(0.0)
    for i, c in enumerate(columns):
        score = score + cell_score(
            F.col(f"__t{i}"), type_of(truth, c), col(c), type_of(current, c), **options
        )
    cells = F.count(F.lit(1)) * F.lit(len(columns))
    matched = F.coalesce(F.sum(score), F.lit(0.0))
    accuracy = F.coalesce(F.try_divide(matched, cells), F.lit(0.0))
    return pairs.agg(cells.alias("cells"), matched.alias("matched"), accuracy.alias("accuracy"))


def _truth_cells(truth: DataFrame, columns: Sequence[str]) -> list[Column]:
    return [col(c).alias(f"__t{i}") for i, c in enumerate(columns)]


def accuracy_by_key(
    current: DataFrame, truth: DataFrame, key: Sequence[str], **options
) -> DataFrame:
    """Cells, matched credit and accuracy of rows paired by a business key.

    Each current row meets the first truth row of its key, so repeated keys never
    multiply; frequent keys on the current side are salted.
    """
    key = list(key)
    require(current, *key)
    require(truth, *key)
    columns = common_columns(current, truth)
    keys = [col(k).try_cast(type_of(current, k)).alias(f"__key{i}") for i, k in enumerate(key)]
    one = truth.select(*keys, *_truth_cells(truth, columns))
    names = [f"__key{i}" for i in range(len(key))]
    one = remove_duplicates(one, groupable(one, names), order_by=names)
    right = one.withColumnsRenamed(dict(zip(names, key)))
    return _scored(join_unique(current, right, key), current, truth, columns, options)


def accuracy_by_position(
    current: DataFrame, truth: DataFrame, order_by: Sequence[str],
    truth_order_by: Sequence[str] | None = None, *,
    rows_per_bucket: int = ROWS_PER_BUCKET, **options,
) -> DataFrame:
    """The same for rows paired by their position in the given orders."""
    columns = common_columns(current, truth)
    left = with_ordinal(current, order_by, "__ord", rows_per_bucket=rows_per_bucket)
    right = with_ordinal(
        truth, truth_order_by or order_by, "__ord", rows_per_bucket=rows_per_bucket
    ).select("__ord", *_truth_cells(truth, columns))
    return _scored(left.join(right, "__ord"), current, truth, columns, options)


def accuracy_by_source(current: DataFrame, truth: DataFrame, **options) -> DataFrame:
    """The same for rows paired by their position in the files that the tables are read from.

    Both tables must be as they are read (columns may be changed); no order is needed or made.
    """
    columns = common_columns(current, truth)
    left = with_source_ordinal(current, "__ord")
    right = with_source_ordinal(truth, "__ord").select("__ord", *_truth_cells(truth, columns))
    return _scored(left.join(right, "__ord"), current, truth, columns, options)


def golden_report(
    current: DataFrame, golden: DataFrame, key: str, columns: Sequence[str] | None = None,
    **options,
) -> DataFrame:
    """One row: golden rows, and how many have a current row matching > 80 % of cells.

    Two rows of n columns that match in more than 80 % differ in at most d cells, so
    among d + 1 groups of columns one is wholly equal. Rows are joined on the hash of
    each group and then checked cell by cell: exact, and no row meets every other.
    """
    require(golden, key)
    shared = [c for c in (columns or golden.columns) if c in current.columns and c in golden.columns]
    if not shared:
        total = golden.agg(F.count(F.lit(1)).alias("golden_rows"))
        return total.withColumn("found", F.lit(0).cast("bigint"))
    # written once: it is counted, measured and joined, and its size then decides the join
    golden = materialized(golden.select(*[col(c) for c in shared]), "golden")
    shared = _selective_first(golden, shared)
    needed = math.floor(len(shared) * GOLDEN_SHARE + 1e-9) + 1
    groups = len(shared) - needed + 1
    types = [(type_of(golden, c), type_of(current, c)) for c in shared]

    left = current.select(*[col(c).alias(f"__c{i}") for i, c in enumerate(shared)])
    right = golden.select(
        F.monotonically_increasing_id().alias("__golden"), *[col(c).alias(f"__g{i}") for i, c in enumerate(shared)]
    )
    equal = [
        cell_equal(F.col(f"__g{i}"), g, F.col(f"__c{i}"), c, **options)
        for i, (g, c) in enumerate(types)
    ]
    matches = sum((e.cast("int") for e in equal), F.lit(0))
    dates = options.get("dates", False)
    left_hashes = _group_hashes("__c", [c for _, c in types], types, groups, dates)
    right_hashes = _group_hashes("__g", [g for g, _ in types], types, groups, dates)
    left = left.withColumn("__h", F.explode(left_hashes))
    right = right.withColumn("__h", F.explode(right_hashes))
    pairs = left.join(right, (left["__h"] == right["__h"]) & (matches >= needed))
    both = side_by_side({
        "total": golden.agg(F.count(F.lit(1)).alias("n")),
        "found": pairs.agg(F.count_distinct("__golden").alias("n")),
    })
    return both.select(
        F.col("total.n").alias("golden_rows"), F.col("found.n").alias("found")
    )


def _selective_first(golden: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns by falling number of golden values, so that each group gets a selective one.

    Groups take columns in turn; a group of constant columns alone would join everything.
    """
    distinct = golden.agg(*[
        F.approx_count_distinct(F.coalesce(col(c).cast("string"), F.lit(""))).alias(f"d{i}") for i, c in enumerate(columns)
    ]).first()
    order = sorted(range(len(columns)), key=lambda i: (-distinct[i], i))
    return [columns[i] for i in order]


def _group_hashes(prefix: str, own: list, types: list[tuple], groups: int, dates: bool) -> Column:
    """One hash per column group over a form in which equal cells are identical."""
    cells = [match_form(F.col(f"{prefix}{i}"), t, types[i], dates=dates) for i, t in enumerate(own)]
    return F.array(*[
        F.xxhash64(F.lit(g), *[F.coalesce(c, F.lit("\x00")) for c in cells[g::groups]])
        for g in range(groups)
    ])
