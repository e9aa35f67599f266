"""Connected components of link tables by star contraction, as DataFrame joins.

Each round hangs every node's larger neighbours, then its smaller ones, on the smallest node
it knows (large star, small star), and writes the links to the shared folder. A hub's links are
aggregates and skew-split joins; neither driver nor any task holds a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.sources.workspace import pin


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("low"))
    hung = down.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return hung.unionByName(least.select("a", F.col("low").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """``a`` and the smallest node ``b`` of its component, for each node that is not it.

    ``links`` has columns ``a`` and ``b``, in any direction, with or without repeats.
    """
    now = pin(links.where("a <> b").distinct())
    while True:
        turned = pin(_small_star(_large_star(now)).where("a <> b").distinct())
        left = turned.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"),
        ).first()
        was = now.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"),
        ).first()
        now = turned
        if left == was:
            return now
