"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a grouped minimum (combined map-side) and a join that adaptive execution may split; links are contracted
towards the smallest node, in a number of steps that grows with the logarithm of the longest path. Each step's links are
written to the shared folder, so a lost executor costs one step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.sources.shared import materialize


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(
        F.col("m").alias("a"), F.col("v").alias("b")
    ).where("a != b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    # links hold a < b: b's smaller neighbours are its a's.
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    joined = links.join(least, "b")
    to_min = joined.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a != b")
    return to_min.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node. Self-links are ignored."""
    links = materialize(
        links.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).where("a != b").distinct(),
        "links"
    )
    state = None
    for _ in range(max_rounds):
        links = materialize(_small_star(_large_star(links)), "links")
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    roots = links.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
