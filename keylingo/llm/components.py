"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a combined minimum per node and one plain equi-join; links never
leave the executors. Each step's links are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``; the root is the component's smallest node.

    Rounds grow with the logarithm of the longest chain. Links of a node to
    itself are ignored, repeated links do no harm.
    """
    now = scratch.keep(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links0")
    seen, number = None, 0
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        number += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = scratch.keep(least, f"large-least{number}")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.keep(large, f"large{number}")
        least = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")), f"small-least{number}")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        made = scratch.keep(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), f"links{number}")
        scratch.drop(f"links{number - 1}", f"large-least{number}", f"large{number}", f"small-least{number}")
        state = made.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now = made
        if state == seen:
            break
        seen = state
    # stars now: every node but a root has one link, to its root
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
