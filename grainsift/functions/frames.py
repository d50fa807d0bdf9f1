"""Small tables: literal rows, and one-row tables side by side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .schema import typed_literal


def literal_rows(
    spark: SparkSession, rows: Sequence[Sequence], schema: T.StructType | str
) -> DataFrame:
    """A few literal rows as plan literals, so that no Python worker is started."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    structs = [
        F.struct(*[typed_literal(v, f.dataType).alias(f.name) for v, f in zip(r, schema.fields)])
        for r in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))


def side_by_side(parts: Mapping[str, DataFrame]) -> DataFrame:
    """One row with a struct column per part; a part without a row gives NULL.

    The parts are appended and folded rather than joined or nested as subqueries, so
    each is planned once and all can run at the same time.
    """
    stacked = None
    for name, df in parts.items():
        one = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias(name))
        stacked = one if stacked is None else stacked.unionByName(one, allowMissingColumns=True)
    return stacked.agg(*[F.first(n, ignorenulls=True).alias(n) for n in parts])
