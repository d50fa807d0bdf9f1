"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import name_local_folder, new_work_dir

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when it runs from a checkout."""
    known = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
    return spark


BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def bound_batches(spark: SparkSession) -> None:
    """Cut batches for Python workers by bytes: long texts would make 10,000 rows arbitrarily large.

    A session that has chosen a size keeps it.
    """
    if not spark.sparkContext.getConf().contains(BATCH_SETTING):
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


CACHE_BYTES, ENTRY_BYTES = 48 << 20, 200  # of a worker's tables of words; a short key, its value and their slot
CACHE_ENTRIES = CACHE_BYTES // ENTRY_BYTES

_RELEASES: list[Callable[[], None]] = []
_OWNER: list[str] = [""]


def at_release(release: Callable[[], None]) -> None:
    """Register how a module empties what it keeps in a worker between batches."""
    _RELEASES.append(release)


def own_caches(owner: str) -> None:
    """Empty the tables that another operator has left in this (reused) worker."""
    if _OWNER[0] != owner:
        for release in _RELEASES:
            release()
        _OWNER[0] = owner
        pa.default_memory_pool().release_unused()


def _owned(batches: Iterator, work: Callable, owner: str) -> Iterator:
    own_caches(owner)
    yield from work(batches)


def map_arrow(df: DataFrame, work: Callable, schema: str) -> DataFrame:
    """mapInArrow with batches bounded by bytes and with the worker's tables to itself."""
    ship(df.sparkSession)
    bound_batches(df.sparkSession)
    owner = getattr(work, "func", work).__module__
    return df.mapInArrow(functools.partial(_owned, work=work, owner=owner), schema)


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the one that ``spark.checkpoint.dir`` names.

    A session of one machine without that setting gets a temporary folder, as in tests; a
    cluster must name a folder that all executors share.
    """
    name_local_folder(spark)
    return new_work_dir(spark, label)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The table written once to the shared folder and read back; this cuts the lineage."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(columns: Sequence[str], wanted: str) -> str:
    """A column name that clashes with none of the given ones, whatever their case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def refuse_clash(columns: Sequence[str], *names: str) -> None:
    """Raise if a result column has the name of a column that is passed through."""
    taken = {c.lower() for c in columns} & {n.lower() for n in names}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are there already; choose other names for the result")


def small_batches(batches: Iterable, rows: int = 1000) -> Iterator:
    """The same rows in batches of at most ``rows``, which bounds what a task holds at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def few_hashes(rows: DataFrame, column: str, limit: int) -> DataFrame:
    """At most ``limit`` hashes (h) of a column, the least ones or nearly: a choice by value alone.

    Rows are thinned by their hash where they lie, so that no more than about twice the limit
    is sent on from all tasks together.
    """
    hashes = rows.select(F.xxhash64(column).alias("h")).filter("h is not null").distinct()
    n = rows.count()
    if n > 4 * limit:
        hashes = hashes.filter(F.pmod("h", F.lit(1 << 30)) < int(2 * limit / n * (1 << 30)))
    return hashes.orderBy("h").limit(limit)


BLOOM_BITS = 1 << 26  # at most 8 MB


class Bloom:
    """Four bits for each key (bigint) in a filter of a power of two bits."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.int64).view(np.uint64)
        out = np.ones(len(keys), bool)
        for shift in (0, 16, 32, 48):
            at = ((keys >> np.uint64(shift)) ^ (keys << np.uint64(64 - shift) if shift else np.uint64(0))) & np.uint64(self.bits - 1)
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def key_filter(keys: DataFrame) -> Bloom:
    """A filter of hashed keys (one bigint column); its size is bounded whatever their number."""
    name = keys.columns[0]
    n, bits = keys.count(), 1 << 16
    while bits < min(12 * n, BLOOM_BITS):
        bits *= 2
    turned = [F.shiftrightunsigned(name, s).bitwiseXOR(F.shiftleft(name, 64 - s)) if s else F.col(name) for s in (0, 16, 32, 48)]
    places = keys.select(F.explode(F.array(*[t.bitwiseAND(F.lit(bits - 1)) for t in turned])).alias("at"))
    words = (places.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())  # bits / 64 rows at most
    table = np.zeros(bits // 64, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return Bloom(table.view(np.uint64), bits)


def _maybe_batches(batches, bloom, inside):
    for batch in batches:
        may = bloom.value.may_hold(batch.column(batch.num_columns - 1).to_numpy())
        yield batch.filter(pa.array(may if inside else ~may))


def maybe_rows(rows: DataFrame, keys: DataFrame, inside: bool = True) -> DataFrame:
    """The rows whose last column (a hashed key) may be among the keys, or those that are not.

    Only rows that may be are worth moving for a join; a full filter changes no result.
    """
    keys = keys.toDF("key")
    bloom = rows.sparkSession.sparkContext.broadcast(key_filter(keys))  # 8 MB at most
    return map_arrow(rows, functools.partial(_maybe_batches, bloom=bloom, inside=inside), rows.schema)
