"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release


def _smallest(pairs: DataFrame) -> DataFrame:
    """(u, m): the smallest of u and its partners.  Cut, so that joins on it can split a hot u."""
    return cut(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _smallest(down)
    hung = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionAll(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """links: (u, v) bigint.  Returns (u, root), root the smallest node reachable from u, for every node but the roots.

    Each round only aggregates and joins on a node, so no component is ever gathered anywhere; tables between rounds
    are written to the shared folder.  Stops when a round leaves the same links (the sum of their hashes tells).
    """
    now = cut(links.where("u <> v").select("u", "v").distinct())
    seen = None
    while True:
        now = cut(_small_star(_large_star(now)).where("u <> v").distinct())
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        release(links.sparkSession)
        if mark == seen:
            return now.select("u", F.col("v").alias("root"))
        seen = mark
