"""Positions of rows in their files, in the order in which the files hold them.

A file knows the number of each of its rows, so a position is that number plus the rows of all
files before it. Nothing is sorted and no row is shuffled: the only table made is one of row
counts per file, which is broadcast. Files follow by path, which is the order of the writer's
part files.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.schema import col, require
from .ordinal import ROWS_PER_BUCKET, fill_in_order

MAX_FILES = 2_000_000  # 16 bytes each are broadcast


def with_source_ordinal(df: DataFrame, name: str = "_ord") -> DataFrame:
    """Add the 0-based position of each row in the files that the table is read from.

    For a table as it is read, with or without some of its columns. Where rows have been
    filtered out the positions still ascend, with gaps between files that end in such rows.
    Runs one small job (rows per file, from row numbers alone).
    """
    if name in df.columns:
        raise ValueError(f"there is a column {name!r} already")
    names = df.columns
    try:
        rows = df.select("*", F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
        files = df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException as error:
        raise ValueError("the table is not read from files (or not directly)") from error
    sizes = files.groupBy("path").agg((F.max("row") + 1).alias("size"))
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    offsets = sizes.select("path", F.xxhash64("path").alias("__f"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("__before"))
    table = offsets.select("__f", "__before").toArrow()
    if table.num_rows > MAX_FILES or len(set(table["__f"].to_pylist())) < table.num_rows:
        raise ValueError(f"{table.num_rows} files: compact them first, at most {MAX_FILES} offsets are broadcast")
    known = df.sparkSession.createDataFrame(table, "__f bigint, __before bigint")
    placed = rows.join(F.broadcast(known), F.col("__file") == F.col("__f"))  # MAX_FILES rows at most
    return placed.select(*[col(c) for c in names], (F.col("__before") + F.col("__row")).alias(name))


def head_of_source(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows in the order of the files."""
    if n < 0:
        raise ValueError("n is negative")
    ordered = with_source_ordinal(df, "__ord").filter(F.col("__ord") < n)
    return ordered.orderBy("__ord").select(*[col(c) for c in df.columns])


def forward_fill_source(df: DataFrame, column: str, *, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Fill missing cells with the last value above in the order of the files.

    Positions cut the rows into even ranges by division, so no sample, bound or hash of the
    row is needed.
    """
    require(df, column)
    ordered = with_source_ordinal(df, "__ord")
    filled = fill_in_order(ordered, column, "__ord", rows_per_bucket=rows_per_bucket)
    return filled.select(*[col(c) for c in df.columns])
