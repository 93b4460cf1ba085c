"""Connected components of a table of links, by alternating large and small stars.

Each round replaces every node's links by links to the least of its neighbours (published as the
large-star and small-star operations); a logarithmic number of rounds leaves one star a component.
Rounds are cut by tables in the shared folder; only a count and a checksum of each reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, own: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node of it) of every node that has a link to another node.

    Reads a table of ``own``.
    """
    held, state = _round(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), own)
    seen = None
    while state[0] and state != seen:
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        stars = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        seen = state
        held, state = _round(stars.distinct(), own)
        own.drop(-2)
    return held.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(held.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _round(links: DataFrame, own: Scratch) -> tuple[DataFrame, tuple]:
    """The links as a table, and their number and checksum."""
    told = Observation()
    held = own.written(links.observe(told, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("sum")), "links")
    return held, (told.get["n"], told.get["sum"])
