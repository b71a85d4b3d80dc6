"""Connected components of a link table by alternating large-star and small-star steps.

Every step is an aggregate with map-side combining and a join of two plain exchanges, which AQE can split when one node
has very many links. Each round is stored in the shared folder; nothing is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortry.session import written


def _pointed(edges: DataFrame) -> DataFrame:
    """Edges u-v with the least node next to u, u itself included."""
    least = written(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least")), "least")
    return edges.join(least, "u")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node that can be reached, for every node that has a link. NULL ends are no links."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    edges, state = written(edges, "edges"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _pointed(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
        small = _pointed(written(large, "large-star"))
        small = small.select("v", "least").unionByName(small.select(F.col("u").alias("v"), "least")).where("v <> least")
        edges = written(small.select(F.col("v").alias("u"), F.col("least").alias("v")).distinct(), "small-star")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        state = now
