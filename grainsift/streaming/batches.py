"""Tables that grow by batches of a stream and stay exact when a batch is repeated.

A writer puts what a batch makes into folders named by the batch's number and, last, a commit
for that number. A batch that is repeated after a failure replaces its folders; readers look
only at committed batches, so they never see half of one. All folders of a writer lie below
one path, and nothing is kept in memory between batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.frames import literal_rows
from ..functions.hashing import compact_keys
from ..functions.numbers import percent
from ..functions.schema import col, groupable
from ..operators.dedup import group_sizes, remove_duplicates
from ..operators.rules import Rule, rule_counts, with_violations
from .streams import ALL_AVAILABLE

BatchWriter = Callable[[DataFrame, int], None]

COUNTS = "rule_id int, type string, column string, checked bigint, violations bigint"


def write_batches(stream: DataFrame, writer: BatchWriter, checkpoint: str, trigger: dict = ALL_AVAILABLE) -> StreamingQuery:
    """Run a batch writer of this module over a stream."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(writer).trigger(**trigger).start()


def _commit(spark: SparkSession, path: str, batch_id: int, rows: int) -> None:
    done = literal_rows(spark, [(rows,)], "rows bigint")
    done.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/batch_id={batch_id}")


def committed(spark: SparkSession, path: str) -> DataFrame:
    """batch_id and rows of the batches that are complete."""
    try:
        done = spark.read.schema("rows bigint, batch_id bigint").parquet(f"{path}/commits")
    except AnalysisException:  # no batch has come yet
        return spark.createDataFrame([], "batch_id bigint, rows bigint")
    return done.select("batch_id", "rows")


def read_committed(spark: SparkSession, path: str, part: str) -> DataFrame:
    """The rows of a part (rows, counts, sizes) of all complete batches, with batch_id.

    Only the folders of these batches are read: the join is on the partition column.
    """
    rows = spark.read.option("mergeSchema", "false").parquet(f"{path}/{part}")
    rows = rows.withColumn("batch_id", F.col("batch_id").cast("bigint"))
    return rows.join(committed(spark, path).select("batch_id"), "batch_id", "left_semi")


# --- rules: both halves and the counts in one pass ---------------------------


def quarantine_writer(path: str, rules: Sequence[Rule]) -> BatchWriter:
    """Each batch split into good and bad rows, and its violations counted, in one pass.

    Rows are written once, into a folder for each half. The counts are observed in the stage
    that writes, where every task counts once, also when it is repeated; they become a small
    table with a row per rule.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        marked = with_violations(batch, rules)
        counted = marked.observe(seen, F.count(F.lit(1)).alias("rows"), *rule_counts(marked, rules))
        halves = counted.withColumn("obeys", F.size("violated_rules") == 0)
        halves.write.mode("overwrite").partitionBy("obeys").parquet(f"{path}/rows/batch_id={batch_id}")
        found = seen.get
        lines = [(i, r.kind, r.label, found[f"c{i}"] or 0, found[f"v{i}"] or 0) for i, r in enumerate(rules)]
        if lines:
            literal_rows(batch.sparkSession, lines, COUNTS).coalesce(1).write.mode("overwrite").parquet(
                f"{path}/counts/batch_id={batch_id}")
        _commit(batch.sparkSession, path, batch_id, found["rows"])

    return write


def good_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of complete batches that obey every rule, with their own columns."""
    return read_committed(spark, path, "rows").filter(F.col("obeys").cast("boolean")).drop("obeys", "violated_rules", "batch_id")


def bad_rows(spark: SparkSession, path: str) -> DataFrame:
    """The other rows, with the positions of the rules they break."""
    return read_committed(spark, path, "rows").filter(~F.col("obeys").cast("boolean")).drop("obeys", "batch_id")


def rule_totals(spark: SparkSession, path: str) -> DataFrame:
    """One row per rule: checked and violations over all complete batches, and the pass rate."""
    sums = read_committed(spark, path, "counts").groupBy("rule_id", "type", "column").agg(
        F.sum("checked").alias("checked"), F.sum("violations").alias("violations"))
    return sums.withColumn("pass_rate", F.try_divide(F.col("checked") - F.col("violations"), F.col("checked")))


# --- duplicates over all batches ---------------------------------------------


def dedup_writer(path: str, subset: Sequence[str] | None = None, order_by: Sequence[str] = ()) -> BatchWriter:
    """Rows whose key no earlier batch holds, the first of each key, and the sizes of all groups.

    The state is a table of keys with counts, a folder per batch: a batch costs itself and a
    look at the keys before it, never the rows before it. NULLs are equal to each other. Long
    texts are kept as digests.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        group_sizes(batch, subset).write.mode("overwrite").parquet(f"{path}/sizes/batch_id={batch_id}")
        keys = groupable(batch, subset or batch.columns)
        firsts = remove_duplicates(batch, subset, "first", order_by)
        before = committed(spark, path).filter(F.col("batch_id") < batch_id)
        if not before.isEmpty():
            names = [f"__k{i}" for i in range(len(keys))]
            known = read_committed(spark, path, "sizes").filter(F.col("batch_id") < batch_id)
            known = known.select(*[F.col(n).alias(f"{n}_") for n in names])
            same = None
            for n in names:
                equal = F.col(n).eqNullSafe(F.col(f"{n}_"))
                same = equal if same is None else same & equal
            firsts = firsts.select("*", *compact_keys(firsts, keys)).join(known, same, "left_anti").drop(*names)
        firsts.write.mode("overwrite").parquet(f"{path}/rows/batch_id={batch_id}")
        rows = spark.read.parquet(f"{path}/sizes/batch_id={batch_id}").agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
        _commit(spark, path, batch_id, rows)

    return write


def first_rows(spark: SparkSession, path: str) -> DataFrame:
    """The first row of every key over all complete batches."""
    return read_committed(spark, path, "rows").drop("batch_id")


def duplicate_totals(spark: SparkSession, path: str) -> DataFrame:
    """rows, duplicates, members, groups and duplicate_pct over all complete batches, from the keys alone."""
    sizes = read_committed(spark, path, "sizes")
    keys = [c for c in sizes.columns if c.startswith("__k")]
    n = F.col("__n")
    return sizes.groupBy(*[col(k) for k in keys]).agg(F.sum("__n").alias("__n")).agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("rows"), F.coalesce(F.sum(n - 1), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("members"), F.count_if(n > 1).alias("groups"),
    ).withColumn("duplicate_pct", percent(F.col("duplicates"), F.col("rows")))


def compact_sizes(spark: SparkSession, path: str, target: str) -> None:
    """The sizes of all complete batches as one batch older than any to come, below ``target``.

    A writer and its readers move to the new path; rows already written stay where they are.
    """
    sizes = read_committed(spark, path, "sizes")
    keys = [c for c in sizes.columns if c.startswith("__k")]
    whole = sizes.groupBy(*[col(k) for k in keys]).agg(F.sum("__n").alias("__n"))
    whole.write.mode("errorifexists").parquet(f"{target}/sizes/batch_id=-1")
    _commit(spark, target, -1, spark.read.parquet(f"{target}/sizes/batch_id=-1").agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0])
