"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.schema import col

MAX_BUCKETS = 20_000
SAMPLES_PER_BUCKET = 20  # bounds every key sample to 400,000 keys
HOT_SAMPLES = 10  # a key seen this often fills half a bucket
SMALL_ROWS = 1_000_000  # below this no key can make a task too large

_HASH, _SALTS, _SALT = "__hash", "__salts", "__salt"


def key_hash(names: Sequence[str]) -> Column:
    """Hash of several cells; null flags are hashed too because xxhash64 skips NULLs."""
    cells = [col(c) for c in names]
    flags = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in cells])
    return F.xxhash64(flags, *cells)


def hot_keys(df: DataFrame, keys: Sequence[str], small_rows: int = SMALL_ROWS) -> list[tuple[int, int]]:
    """(hash, number of parts) of keys that would overfill a shuffle partition.

    Found in a bounded sample (a small eager job); empty for small tables. At most
    two keys per shuffle partition can qualify.
    """
    total = df.count()
    if total <= small_rows:
        return []
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = min(partitions, MAX_BUCKETS) * SAMPLES_PER_BUCKET
    sample = df.select(key_hash(keys).alias(_HASH)).sample(min(1.0, wanted / total), seed=7)
    parts = F.ceil(F.col("n") / SAMPLES_PER_BUCKET) + 1
    hot = (
        sample.groupBy(_HASH)
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= HOT_SAMPLES)
        .select(_HASH, parts.cast("int"))
    )
    return [tuple(r) for r in hot.collect()]


def join_unique(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
    small_rows: int = SMALL_ROWS,
) -> DataFrame:
    """Null-safe join of ``left`` with a table that has at most one row per key.

    Columns of ``right`` must not clash with ``left`` apart from the keys; those come
    from ``left``. A hot key is cut into parts: its rows on the left take the part of
    the task that read them (stable under task retries) and its one row on the right
    is repeated per part.
    """
    renamed = {k: f"__r{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(renamed)
    match = None
    for name, other in renamed.items():
        same = col(name).eqNullSafe(F.col(other))
        match = same if match is None else match & same

    hot = hot_keys(left, keys, small_rows)
    extra = []
    if hot:
        table = left.sparkSession.createDataFrame(hot, f"{_HASH} bigint, {_SALTS} int")
        table = F.broadcast(table)  # at most 2 x shuffle partitions rows
        parts = F.coalesce(_SALTS, F.lit(1))
        left = left.withColumn(_HASH, key_hash(keys)).join(table, _HASH, "left")
        left = left.withColumn(_SALT, F.pmod(F.spark_partition_id(), parts)).drop(_HASH, _SALTS)
        right = right.withColumn(_HASH, key_hash(list(renamed.values()))).join(table, _HASH, "left")
        right = right.withColumn("__rsalt", F.explode(F.sequence(F.lit(0), parts - 1)))
        right = right.drop(_HASH, _SALTS)
        match = match & (F.col(_SALT) == F.col("__rsalt"))
        extra = [_SALT, "__rsalt"]
    return left.join(right, match, how).drop(*renamed.values(), *extra)
