"""Connected components of links between long ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _nearest(edges: DataFrame) -> DataFrame:
    """Each u with the smallest of itself and its neighbours v."""
    return edges.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))


def components(links: DataFrame) -> DataFrame:
    """links: u, v. Returns (id, component_id) of every id in a link; component_id is its smallest id.

    A round links each id to the smallest one around it, first its larger, then its smaller neighbours,
    until nothing changes: the number of rounds grows with the logarithm of the longest chain. Minima are
    combined before the shuffle, so an id with very many links is no hot key; Spark splits its join.
    Links with a null end and those of an id with itself say nothing; without links there are no rows."""
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, seen = materialise(edges, "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_nearest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        near = _nearest(down)
        small = down.join(near, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(near.select("u", F.col("low").alias("v")))
        before, edges = edges, materialise(small.where("u <> v").distinct(), "stars")
        discard(before)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
