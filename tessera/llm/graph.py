"""Connected components of a graph whose edges are a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every vertex of edges(a, b), root being the smallest vertex of its component.

    Large-star and small-star steps alternate until every edge points from a
    vertex to the root of its star. Both steps are a partial minimum for each
    vertex and an equi-join, so a vertex with very many edges is pre-aggregated
    before the shuffle and its join side can be split. Each round is written
    to the shared checkpoint folder. Loops and repeated edges are harmless;
    edges with a null end are ignored; no edges give no rows.
    """
    e = cut(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = large.where("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(moved.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        # done if every vertex has one edge up, and none that an edge leads to has any
        ups = e.select("u", F.lit(1).alias("up")).union(e.select("v", F.lit(0))).groupBy("u").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
        if ups.where("ups > 1 or (ups = 1 and least = 0)").limit(1).count() == 0:
            break
    roots = e.select("v").distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).union(roots.select(F.col("v").alias("id"), F.col("v").alias("root")))
