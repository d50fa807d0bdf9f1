"""Profiles as mergeable state: a new day costs one day, not the whole table again.

A state is a small table with one row per column (and per group, such as a day or a file):
exact counts, bounds and sums beside sketches of the distinct values and of the distribution.
States of disjoint rows are merged without going back to the rows; counts, bounds and sums of
the merged state are those of the whole, and the sketches keep their error bounds:

* distinct values: HyperLogLog with 2**14 registers, a standard error of 0.8 %;
* quantiles: KLL with k = 400, a rank error of about 0.7 % (with 99 % confidence).

Distinct integer keys can be counted exactly and still merge, as bitmaps of 32,768 keys each
(:func:`key_state`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.hashing import distinct_text
from ..functions.numbers import missing, number, percent
from ..functions.schema import col, groupable, is_number, require, type_of

LG_REGISTERS, KLL_K = 14, 400
DISTINCT_ERROR, RANK_ERROR = 3 * 0.0082, 0.01  # three standard errors; beyond 99 % confidence
MAX_BYTES_PER_KEY = 64
BUCKET_BYTES = 4096  # 32,768 bits

STATE = ("position", "column", "type", "rows", "missing", "distinct_sketch", "values_sketch", "least", "greatest", "total", "squares")


def _column_state(df: DataFrame, position: int, name: str) -> Column:
    dtype, gone = type_of(df, name), missing(df, name)
    text = F.when(~gone, distinct_text(col(name), dtype))
    x = number(df, name).cast("double") if is_number(dtype) else F.lit(None).cast("double")
    sketch = F.kll_sketch_agg_double(x, F.lit(KLL_K)) if is_number(dtype) else F.lit(None).cast("binary")
    return F.struct(
        F.lit(position).alias("position"), F.lit(name).alias("column"), F.lit(dtype.simpleString()).alias("type"),
        F.count(F.lit(1)).alias("rows"), F.count_if(gone).alias("missing"),
        F.hll_sketch_agg(text, F.lit(LG_REGISTERS)).alias("distinct_sketch"), sketch.alias("values_sketch"),
        F.min(x).alias("least"), F.max(x).alias("greatest"), F.sum(x).alias("total"), F.sum(x * x).alias("squares"))


def profile_state(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per column and group: everything that :func:`profile_of_state` needs.

    One pass with partial aggregation; a task hands on one row per group, some 30 kB per
    column. ``by`` names few-valued columns (a day, a file); they are not profiled.
    """
    groupable(df, by)
    clash = [c for c in by if c in STATE]
    if clash:
        raise ValueError(f"columns {clash} clash with those of a state; rename them first")
    columns = [c for c in df.columns if c not in by]
    states = F.array(*[_column_state(df, i, c) for i, c in enumerate(columns)])
    grouped = df.groupBy(*[col(c) for c in by]).agg(states.alias("__s"))
    return grouped.select(*[col(c) for c in by], F.inline("__s"))


def merge_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """States of disjoint rows added up, to one row per column (and group of ``by``)."""
    require(states, *STATE, *by)
    merged = states.groupBy(*[col(c) for c in by], "position", "column", "type").agg(
        F.sum("rows").alias("rows"), F.sum("missing").alias("missing"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("values_sketch").alias("values_sketch"),
        F.min("least").alias("least"), F.max("greatest").alias("greatest"),
        F.sum("total").alias("total"), F.sum("squares").alias("squares"))
    return merged.select(*[col(c) for c in by], *STATE)


def profile_of_state(state: DataFrame) -> DataFrame:
    """Counts, shares, estimated distinct values, bounds, mean, deviation and estimated median.

    The deviation comes from sums of squares: it loses digits where the mean is far larger.
    Columns of a state's groups stay in front.
    """
    require(state, *STATE)
    groups = [c for c in state.columns if c not in STATE]
    n = (F.col("rows") - F.col("missing")).cast("double")
    spread = F.greatest(F.col("squares") - F.col("total") * F.col("total") / F.nullif(n, F.lit(0.0)), F.lit(0.0))
    some = F.kll_sketch_get_n_double("values_sketch") > 0  # an empty sketch has no quantiles
    median = F.when(some, F.kll_sketch_get_quantile_double("values_sketch", F.lit(0.5)))
    return state.select(
        *[col(c) for c in groups], "position", "column", "type", n.cast("bigint").alias("non_null"), "missing",
        percent(F.col("missing"), F.col("rows")).alias("missing_pct"),
        F.hll_sketch_estimate("distinct_sketch").alias("distinct_estimate"),
        F.col("least").alias("min"), F.col("greatest").alias("max"),
        (F.col("total") / F.nullif(n, F.lit(0.0))).alias("mean"),
        F.sqrt(F.try_divide(F.when((n > 1) & F.col("squares").isNotNull(), spread), n - 1)).alias("std"), median.alias("median_estimate"))


def state_quantiles(state: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """column and quantiles (an array of estimates) of the numeric columns with values."""
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    return (
        state.filter(F.kll_sketch_get_n_double("values_sketch") > 0)
        .select(*[col(c) for c in state.columns if c not in STATE], "column",
                F.kll_sketch_get_quantile_double("values_sketch", wanted).alias("quantiles")))


def save_state(state: DataFrame, path: str, label: str) -> None:
    """Put the state of one part (a day, a batch) into a folder of states; a repeat replaces it."""
    state.write.mode("overwrite").parquet(f"{path}/part={label}")


def load_states(spark: SparkSession, path: str) -> DataFrame:
    """All saved states, with the label of each as column ``part`` (text)."""
    states = spark.read.parquet(path)
    return states.withColumn("part", F.col("part").cast("string"))


# --- exact distinct keys -----------------------------------------------------


def key_state(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """bucket and bits per group: which integer keys occur, 32,768 of them in 4 kB.

    Exact, and merged by OR. For keys that lie close together (surrogate keys, dates as
    numbers). Where a bucket holds so few that a key takes over 64 bytes, the column is
    refused: count distinct values then.
    """
    require(df, column, *by)
    if not isinstance(type_of(df, column), (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise ValueError(f"column {column!r} is no integer")
    key = col(column).cast("bigint")
    bucket = F.bitmap_bucket_number(key)
    keys, buckets = df.agg(F.approx_count_distinct(key), F.approx_count_distinct(bucket)).first()
    if buckets > 2 and buckets * BUCKET_BYTES > MAX_BYTES_PER_KEY * keys:
        raise ValueError(f"keys of {column!r} are too far apart for bitmaps: about {keys} keys in {buckets} buckets")
    rows = df.filter(key.isNotNull())
    return rows.groupBy(*[col(c) for c in by], bucket.alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("bits"))


def merge_key_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return states.groupBy(*[col(c) for c in by], "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def count_keys(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The exact number of distinct keys of states, merged first; one row without ``by``."""
    merged = merge_key_states(states, by)
    return merged.groupBy(*[col(c) for c in by]).agg(
        F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("bigint").alias("distinct_keys"))
