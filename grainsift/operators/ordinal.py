"""Row positions and forward fill without moving the table into one task.

Rows are cut into key ranges ("buckets") by literal bounds taken from a bounded
sample, each bucket is ordered on its own, and one summary row per bucket carries
what the next one needs. Bounds only affect balance, never results.

The order is total on every path: rows with equal order keys follow by a hash of the
whole row and then by the remaining columns, so only complete copies are ever tied and
results do not depend on partitioning, bucket size or retries. The hash also splits
frequent order keys, and complete copies are collapsed to one row with a count, so a
third of the table being one row (or one key) still gives even buckets.

The input is read several times (count and sample, summaries, rows): materialise it
first when it is expensive to compute.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.numbers import missing
from ..functions.schema import col, groupable, is_text, require, type_of
from .skew import HOT_SAMPLES, MAX_BUCKETS, SAMPLES_PER_BUCKET

_KEY, _BUCKET, _COPIES, _TIE, _START = "__key", "__bucket", "__copies", "__tie", "__start"

ROWS_PER_BUCKET = 50_000
COPIES_PER_CHUNK = 100_000


KEY_CHARS = 64  # longer texts are cut in bounds, which keeps samples small


@dataclass
class _Cut:
    """Ascending bounds, and the keys that are hot on their own."""

    bounds: list
    hot: list
    key_type: T.StructType


@dataclass
class _Bucketed:
    """Rows with bucket and number of copies, and their total order."""

    rows: DataFrame
    order: list[Column]
    total: int
    several: bool  # more than one bucket
    collapsed: bool  # some rows stand for several copies
    n_keys: int  # so many of the order's columns come first: the keys and the row's hash


def _sortable(df: DataFrame, name: str) -> Column:
    """The cell, or the sorted entries of a map."""
    if isinstance(type_of(df, name), T.MapType):
        return F.array_sort(F.map_entries(col(name)))
    return col(groupable(df, [name])[0])


def _order_fields(order_by: Sequence[str], nulls_last: bool) -> list[Column]:
    fields = []
    for i, c in enumerate(order_by):
        if nulls_last:
            fields.append(col(c).isNull().alias(f"n{i}"))
        fields.append(col(c).alias(f"o{i}"))
    return fields


def _bound_key(df: DataFrame, order_by: Sequence[str], nulls_last: bool) -> Column:
    """A key of bounded size that is ordered like the rows, but may tie where they do not.

    After a text that is cut nothing may follow, so rows that agree so far stay together.
    """
    fields, whole = [], F.lit(True)
    for i, (c, field) in enumerate(zip(order_by, _pairs(order_by, nulls_last))):
        for part in field[:-1]:
            fields.append(F.when(whole, part).alias(f"n{i}"))
        if is_text(type_of(df, c)):
            cut = F.char_length(col(c)) > KEY_CHARS
            fields.append(F.when(whole, F.left(col(c), F.lit(KEY_CHARS))).alias(f"o{i}"))
            fields.append(F.when(whole, F.coalesce(cut, F.lit(False))).alias(f"l{i}"))
            whole = whole & ~F.coalesce(cut, F.lit(False))
        else:
            fields.append(F.when(whole, field[-1]).alias(f"o{i}"))
    return F.struct(*fields, F.when(whole, F.col(_TIE)).alias("tie"))


def _pairs(order_by: Sequence[str], nulls_last: bool) -> list[list[Column]]:
    return [[col(c).isNull(), col(c)] if nulls_last else [col(c)] for c in order_by]


def _cut(keyed: DataFrame, buckets: int, total: int) -> _Cut:
    """Bounds and hot keys from one bounded sample (a small eager job)."""
    key_type = keyed.schema[_KEY].dataType
    wanted = buckets * SAMPLES_PER_BUCKET
    sample = keyed.select(_KEY)
    sample = sample.sample(min(1.0, wanted / total), seed=7) if total > wanted else sample
    weighed = sample.groupBy(_KEY).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(
        Window.orderBy(_KEY).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    step = lambda c: F.floor(c / SAMPLES_PER_BUCKET)
    picked = (
        weighed.withColumn("upto", upto)
        .select(
            _KEY,
            (step(F.col("upto")) > step(F.col("upto") - F.col("n"))).alias("bound"),
            (F.col("n") >= HOT_SAMPLES).alias("hot"),
        )
        .filter("bound or hot")
        .collect()
    )
    return _Cut([r[_KEY] for r in picked if r["bound"]], [r[_KEY] for r in picked if r["hot"]], key_type)


def _literal_array(df: DataFrame, keys: list, key_type: T.DataType) -> Column:
    """The keys as an ascending array, delivered as a one-row scalar subquery."""
    schema = T.StructType([T.StructField("a", T.ArrayType(key_type))])
    return df.sparkSession.createDataFrame([(keys,)], schema).select(F.sort_array("a")).scalar()


def _bucket_column(df: DataFrame, cut: _Cut) -> DataFrame:
    """Add the number of bounds at or below the key.

    A binary search written as a chain of projections, one per halving (15 for the
    largest number of buckets), which Spark compiles into plain array look-ups.
    """
    df = df.withColumn(_BUCKET, F.lit(0))
    n = len(cut.bounds)
    if n == 0:
        return df
    df = df.withColumn("__bounds", _literal_array(df, cut.bounds, cut.key_type))
    for step in (2**i for i in range(n.bit_length() - 1, -1, -1)):
        # beyond the end of the array the look-up is NULL and the position stays
        reached = F.get("__bounds", F.col(_BUCKET) + (step - 1)) <= F.col(_KEY)
        df = df.withColumn(_BUCKET, F.col(_BUCKET) + F.when(reached, step).otherwise(0))
    return df.drop("__bounds")


def _bucketed(
    df: DataFrame, order_by: Sequence[str], nulls_last: bool, rows_per_bucket: int
) -> _Bucketed:
    total = df.count()
    buckets = min(MAX_BUCKETS, -(-total // rows_per_bucket)) if total else 1
    cells = [_sortable(df, c) for c in df.columns]
    flags = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in cells])
    tied = df.withColumn(_TIE, F.xxhash64(flags, *cells))
    rest = [_sortable(df, c) for c in df.columns if c not in order_by]
    keys = [*_order_fields(order_by, nulls_last), F.col(_TIE)]  # beyond these only copies are tied, but for clashes of hashes
    order = [*keys, *rest]
    one = F.lit(1).cast("bigint")
    if buckets == 1:
        return _Bucketed(tied.withColumns({_BUCKET: F.lit(0), _COPIES: one}), order, total, False, False, len(keys))
    keyed = tied.withColumn(_KEY, _bound_key(df, order_by, nulls_last))
    cut = _cut(keyed, buckets, total)
    # the hash of a hot key marks the rows that may be copies; at most 2 per bucket
    hashes = sorted({k["tie"] for k in cut.hot if k["tie"] is not None})
    plain = all(not isinstance(f.dataType, T.MapType) for f in df.schema.fields)
    if not (hashes and plain):
        placed = _bucket_column(keyed, cut).withColumn(_COPIES, one)
        return _Bucketed(placed.drop(_KEY), order, total, True, False, len(keys))
    # copies of hot rows collapse where they are read; all other rows pass with their own number
    hot = df.sparkSession.createDataFrame([(h, True) for h in hashes], f"{_TIE} bigint, __hot boolean")
    marked = keyed.join(F.broadcast(hot), _TIE, "left")
    own = F.when(F.col("__hot").isNull(), F.monotonically_increasing_id())
    counted = (
        marked.groupBy(*[col(c) for c in df.columns], _TIE, _KEY, own.alias("__own"))
        .agg(F.count(F.lit(1)).alias(_COPIES)).drop("__own")
    )
    return _Bucketed(_bucket_column(counted, cut).drop(_KEY), order, total, True, True, len(keys))


def _expand(df: DataFrame, first: str | None = None) -> DataFrame:
    """Undo the collapsing of copies; ``first`` names a position column to advance.

    One pass: each row becomes its chunks, which are spread over the cluster only to grow.
    """
    n = F.col(_COPIES)
    starts = F.sequence(F.lit(0).cast("bigint"), n - 1, F.lit(COPIES_PER_CHUNK).cast("bigint"))
    chunks = df.withColumn("__from", F.explode(starts))
    upto = F.least(F.col("__from") + COPIES_PER_CHUNK, n) - 1
    grown = chunks.withColumn("__i", F.explode(F.sequence("__from", upto)))
    if first:
        grown = grown.withColumn(first, F.col(first) + F.col("__i"))
    return grown.drop("__from", "__i")


def with_ordinal(
    df: DataFrame, order_by: Sequence[str], name: str = "_ord", *,
    descending: bool = False, rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add the 0-based position of each row in the order, NULLs last.

    Rows with equal order keys are ordered by the rest of the row. Runs two small jobs
    at once (a count and, for several buckets, a key sample).
    """
    require(df, *order_by)
    if not order_by:
        raise ValueError("order_by is empty")
    # the descending position is the ascending one counted from the other end
    cut = _bucketed(df, order_by, not descending, rows_per_bucket)
    rows = cut.rows
    within = Window.partitionBy(_BUCKET).orderBy(*cut.order)
    running = F.sum(_COPIES).over(
        within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = rows.withColumn(_START, running - F.col(_COPIES))
    if cut.several:
        totals = rows.groupBy(_BUCKET).agg(F.sum(_COPIES).alias("__size"))
        before = Window.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
        # one row per bucket, MAX_BUCKETS + 1 at most
        offsets = totals.select(
            _BUCKET, F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset")
        )
        # every bucket has an offset; an inner join would test the bucket for NULL first
        placed = placed.join(F.broadcast(offsets), _BUCKET, "left").withColumn(
            _START, F.col(_START) + F.col("__offset")
        )
    if cut.collapsed:
        placed = _expand(placed, first=_START)
    position = F.lit(cut.total - 1) - F.col(_START) if descending else F.col(_START)
    return placed.select(*[col(c) for c in df.columns], position.cast("bigint").alias(name))


def forward_fill_column(
    df: DataFrame, column: str, order_by: Sequence[str], partition_by: Sequence[str] = (),
    *, rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Fill missing cells (NaN included) with the last value above, within each partition if one is given.

    A partition may be larger than a task: ranges run over (partition, order), and
    the last value of a range is carried into the next while the partition lasts.
    """
    require(df, column, *order_by, *partition_by)
    if not order_by:
        raise ValueError("order_by is empty")
    return _filled(df, _bucketed(df, [*partition_by, *order_by], True, rows_per_bucket), column, partition_by)


def fill_in_order(df: DataFrame, column: str, position: str, *, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Forward fill by a column of distinct positions from 0, such as an ordinal; NULL positions are refused.

    Ranges are cut by division: no sample is taken and no row is hashed.
    """
    require(df, column, position)
    bucket = F.floor(col(position) / rows_per_bucket)
    rows = df.withColumns({_BUCKET: F.when(bucket.isNull(), F.raise_error(F.lit("a position is NULL"))).otherwise(bucket),
                           _COPIES: F.lit(1).cast("bigint")})
    return _filled(df, _Bucketed(rows, [col(position)], 0, True, False, 1), column, [])


def _filled(df: DataFrame, cut: _Bucketed, column: str, partition_by: Sequence[str]) -> DataFrame:
    rows = cut.rows
    if cut.several:
        # one shuffle serves the windows and the join of the carried values below
        rows = rows.repartition(_BUCKET)
    cell = col(column)
    part = F.struct(*[col(c).alias(f"p{i}") for i, c in enumerate(partition_by)], F.lit(0).alias("p"))
    upto_here = (
        Window.partitionBy(_BUCKET, *[col(c) for c in partition_by])
        .orderBy(*cut.order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    present = F.when(~missing(df, column), cell)
    filled = F.last(present, ignorenulls=True).over(upto_here)
    if cut.several:
        tails = cut.rows.groupBy(_BUCKET).agg(
            F.max_by(
                F.when(present.isNotNull(), F.struct(part.alias("part"), cell.alias("value"))),
                F.when(present.isNotNull(), F.struct(*cut.order[:cut.n_keys])),
            ).alias("__tail")
        )
        earlier = Window.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
        carries = tails.select(
            _BUCKET, F.last("__tail", ignorenulls=True).over(earlier).alias("__carry")
        )
        rows = rows.withColumn("__local", filled).join(carries, _BUCKET, "left")
        carried = F.when(F.col("__carry.part").eqNullSafe(part), F.col("__carry.value"))
        filled = F.coalesce("__local", carried)
    out = rows.withColumn(column, F.coalesce(filled, cell))  # NaN stays where nothing is above
    if cut.collapsed:
        out = _expand(out)
    return out.select(*[col(c) for c in df.columns])
