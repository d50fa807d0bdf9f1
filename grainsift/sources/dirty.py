"""Dirtied views of the sample tables, defined by arithmetic on their keys.

They stand in for real dirty data: the sample tables hold no NULLs and no copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import rules
from .tables import table

# The categories of the sample tables.
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def _repeat_where(df: DataFrame, chosen: Column) -> DataFrame:
    """Rows once, chosen rows twice; ``__copy`` is 1 on the second."""
    return df.withColumn(
        "__copy", F.explode(F.sequence(F.lit(0), F.when(chosen, 1).otherwise(0)))
    )


def orders_dirty(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with missing, extreme and negative prices, mixed text and exact copies."""
    o = table(spark, folder, "orders")
    k, price, priority = F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_orderpriority")
    day = F.col("o_orderdate").cast("date")
    cents = F.round(price * 100).cast("bigint").cast("string")
    return _repeat_where(o, k % 12 == 8).select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.when(k % 10 == 3, None).when(k % 97 == 5, price * 100).when(k % 53 == 7, -price)
        .otherwise(price).alias("o_totalprice"),
        "o_orderdate",
        F.when(k % 19 == 2, None).when(k % 7 == 1, F.lower(priority))
        .when(k % 11 == 4, F.concat(F.lit("  "), priority, F.lit(" ")))
        .otherwise(priority).alias("o_orderpriority"),
        F.when(k % 41 == 6, "n/a").when(k % 20 == 4, F.concat(F.lit("$"), cents))
        .otherwise(cents).alias("price_text"),
        F.when(k % 5 == 0, F.date_format(day, "dd/MM/yyyy"))
        .when(k % 5 == 1, F.date_format(day, "MM-dd-yyyy"))
        .when(k % 5 == 2, F.date_format(day, "dd MMM yyyy"))
        .otherwise(F.date_format(day, "yyyy-MM-dd")).alias("date_text"),
    )


def customer_dirty(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with missing and misspelt segments and near copies under new keys."""
    c = table(spark, folder, "customer")
    k, segment = F.col("c_custkey"), F.col("c_mktsegment")
    copied = F.col("__copy") == 1
    return _repeat_where(c, k % 50 == 13).select(
        F.when(copied, k + 1_000_000_000).otherwise(k).alias("c_custkey"),
        F.when(copied, F.lower("c_name")).otherwise(F.col("c_name")).alias("c_name"),
        "c_nationkey", "c_acctbal",
        F.when(k % 20 == 9, None)
        .when(k % 30 == 11, F.left(segment, F.length(segment) - 1))
        .when(k % 17 == 3, F.lower(segment))
        .otherwise(segment).alias("c_mktsegment"),
    )


def events_dirty_from(events: DataFrame) -> DataFrame:
    """Events (a table or a stream) with missing, negative and extreme values."""
    k, value = F.col("event_id"), F.col("value")
    dirty = (
        F.when(k % 25 == 6, None).when(k % 83 == 12, -value).when(k % 211 == 40, value + 10000)
        .otherwise(value)
    )
    return events.withColumn("value", dirty)


def events_dirty(spark: SparkSession, folder: str) -> DataFrame:
    return events_dirty_from(table(spark, folder, "events"))


ORDER_RULES = (
    rules.value_range("o_totalprice", 0, 500000, "price lies between 0 and 500000"),
    rules.not_null("o_orderkey", "order key is required"),
    rules.categorical("o_orderpriority", PRIORITIES, "priority is one of five"),
)
CUSTOMER_RULES = (
    rules.categorical("c_mktsegment", SEGMENTS, "segment is one of five"),
    rules.pattern("c_name", r"Customer#[0-9]+", "name carries a number"),
    rules.not_null("c_custkey", "customer key is required"),
)
LINEITEM_RULES = (
    rules.cross_column("l_extendedprice", "l_quantity", "greater_than", "price exceeds quantity"),
)
EVENT_RULES = (
    rules.value_range("value", 0, 1000, "value lies between 0 and 1000"),
    rules.not_null("value", "value is required"),
)
