"""Connected components of a link table by alternating large and small stars; nothing but scalars reaches the driver.

Joins with a table of one row a key are merge joins, which the adaptive planner splits where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressleaf.llm.common import cut, discard


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.join(least.hint("merge"), "u").where("v > u and v <> m")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(u, v) links without loops -> (node, component): every linked node with the least node that it reaches."""
    now = cut(links.select("u", "v").where("u <> v").distinct(), "links")
    state = _state(now)
    while state[0]:
        half = cut(_large_star(now), "stars")
        after = cut(_small_star(half), "stars")
        discard(now, half)
        now = after
        before, state = state, _state(now)
        if state == before:
            break
    least = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return least.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
