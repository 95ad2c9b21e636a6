"""Connected components of a link table by alternating star contractions (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links (a, b) of longs or of structs of longs, in any order, with repeats and self links -> (id, component_id): the smallest id reachable.

    Only ids that have a link are returned. Each round is two shuffles that pre-aggregate the
    neighbours' minimum, so a hub's links are split among tasks; rounds grow with the logarithm of
    the longest path. Nothing but two counts comes to the driver.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = cut(small.where("u <> v").distinct())
        drop_cut(edges)
        edges = new
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components are not complete after {most_rounds} rounds")
    return edges.groupBy("u").agg(F.min("v").alias("component_id")).select(F.col("u").alias("id"), "component_id").union(edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
