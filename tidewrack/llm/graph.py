"""Connected components of an edge table, in DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, staged


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of edges (a, b) that isn't its component's smallest, root being that.

    Alternates the large-star and small-star steps: every node hands its larger
    neighbours, then its smaller ones, to the least node it knows. Both are a
    grouping with partial minima and a join on the same key, so no node's
    neighbours are ever collected; each round is written to the shared folder, in the last one's place.
    Rounds grow with the logarithm of the longest path. Loops and edges with
    nulls are left out; no edges give no rows.
    """
    links = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = staged(links, "links")
    before = _signature(links)
    while before[0]:
        both = links.union(links.select(F.col("v"), F.col("u")))
        least = both.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m")).select("_u", F.least("_u", "_m").alias("_m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("_m").alias("v"))
        large = large.union(links.join(least, F.col("u") == F.col("_u")).where("_m < u").select("u", F.col("_m").alias("v"))).distinct()
        least = large.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m"))
        small = large.join(least, F.col("u") == F.col("_u")).where("v != _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
        links, done = staged(small.union(least.select("_u", "_m")).distinct(), "links"), links
        removed(done)
        after = _signature(links)
        if after == before:
            break
        before = after
    return links.select(F.col("u").alias("id"), F.col("v").alias("root"))


def _signature(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return (row[0], row[1])
