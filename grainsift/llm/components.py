"""Connected components of a table of links, as rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest reachable id) for every id in links (a, b bigint).

    Each round every id takes the smallest component of its neighbours (aggregated before the
    shuffle, so an id with many links is no burden) and then the component of its component,
    which halves chains. Only ids and components are moved; nothing reaches the driver but
    the number of changes. Null ids are ignored, repeated links count once.
    """
    links = links.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).dropna()
    both = stored(links.union(links.select("b", "a")).filter("a <> b").distinct(), "links")
    start = both.groupBy("a").agg(F.min("b").alias("b"))
    now = stored(start.select(F.col("a").alias("id"), F.least("a", "b").alias("component")), "components")
    while True:
        near = (both.join(now, both.b == now.id).groupBy("a").agg(F.min("component").alias("least")))
        hooked = now.join(near, now.id == near.a, "left").select(
            "id", F.col("component").alias("before"), F.least("component", "least").alias("step"))
        jump = now.select(F.col("id").alias("step"), F.col("component").alias("beyond"))
        after = stored(hooked.join(jump, "step", "left").select(
            "id", "before", F.least("step", "beyond").alias("component")), "components")
        if after.filter("component <> before").isEmpty():
            return after.select("id", "component")
        now = after.select("id", "component")
