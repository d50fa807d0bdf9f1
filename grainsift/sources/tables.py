"""Reading tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.schema import col


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet files of one table as a stream."""
    schema = table(spark, folder, name).schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", f"{name}.parquet")
        .parquet(folder)
    )


def from_rows(spark: SparkSession, rows: Sequence[dict], schema: T.StructType | str) -> DataFrame:
    """A table from row dictionaries, for tests and literal additions."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    return spark.createDataFrame([tuple(r.get(n) for n in schema.names) for r in rows], schema)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN cells of floating columns as NULL, the one form of "missing" here."""
    return df.select(*[
        F.when(~F.isnan(col(f.name)), col(f.name)).alias(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else col(f.name)
        for f in df.schema.fields
    ])
