"""Cleaning, deduplication and windowed rule checks on unbounded tables.

The column and row operators are plain expressions and apply to a stream as they
are. Exact median and mode fills, forward fill, sorting and positional comparison
need the whole table and stay batch-only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.schema import col, require
from ..operators.rules import Rule, counts_to_rows, rule_counts


def event_time(stream: DataFrame, column: str) -> DataFrame:
    """Cast a zone-less timestamp so that it can carry a watermark.

    The times are taken as they are read in the session time zone; the zone is not changed.
    """
    require(stream, column)
    return stream.withColumn(column, col(column).cast("timestamp"))


def dedup_stream(
    stream: DataFrame, keys: Sequence[str], time_column: str, delay: str = "1 hour"
) -> DataFrame:
    """Drop rows whose keys were seen within ``delay``; state older than that is freed.

    State is kept by key: all rows of a key in a micro-batch meet in the task of that key.
    """
    require(stream, *keys)
    timed = event_time(stream, time_column).withWatermark(time_column, delay)
    return timed.dropDuplicatesWithinWatermark(list(keys))


def windowed_rule_counts(
    stream: DataFrame, rules: Sequence[Rule], time_column: str,
    window: str = "1 day", delay: str = "1 hour",
) -> DataFrame:
    """One row per time window and rule: rows checked, violations, pass rate."""
    timed = event_time(stream, time_column).withWatermark(time_column, delay)
    counted = timed.groupBy(F.window(col(time_column), window).alias("w")).agg(
        *rule_counts(timed, rules)
    )
    rows = counted.select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"),
        F.explode(counts_to_rows(rules)).alias("r"),
    )
    return rows.select("window_start", "r.*")


ALL_AVAILABLE = {"availableNow": True}


def append_to(
    stream: DataFrame, path: str, checkpoint: str, trigger: dict = ALL_AVAILABLE
) -> StreamingQuery:
    """Write a stream to a parquet folder; by default take all input there is now."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def upsert_to(
    stream: DataFrame, path: str, checkpoint: str, trigger: dict = ALL_AVAILABLE
) -> StreamingQuery:
    """Write changed rows of an aggregation, one folder per batch.

    A batch that is repeated after a failure replaces its own folder, so results are
    exact; :func:`latest` reads the newest row of each key.
    """
    return (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(_folder_writer(path))
        .trigger(**trigger)
        .start()
    )


def _folder_writer(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest row per key of a folder written by :func:`upsert_to`."""
    rows = spark.read.parquet(path)
    newest = Window.partitionBy(*keys).orderBy(F.desc("batch_id"))
    kept = rows.withColumn("__n", F.row_number().over(newest)).filter("__n = 1")
    return kept.drop("__n", "batch_id")


def compact(spark: SparkSession, path: str, keys: Sequence[str], target: str) -> None:
    """Write the newest row per key to ``target`` as one batch, older than any to come.

    A reader moves to the new folder; the old one can then be deleted as a whole, so
    :func:`latest` need not read every batch ever written.
    """
    latest(spark, path, keys).write.mode("errorifexists").parquet(f"{target}/batch_id=-1")
