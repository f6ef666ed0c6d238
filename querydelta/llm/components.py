"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querydelta.llm.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node around it."""
    both = edges.union(edges.select(F.col("low").alias("high"), F.col("high").alias("low"))).toDF("at", "other")
    least = both.groupBy("at").agg(F.min("other").alias("least"))
    least = least.select("at", F.least("at", "least").alias("least"))
    return (
        both.where("other > at").join(least, "at")
        .select(F.col("other").alias("high"), F.col("least").alias("low")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    least = edges.groupBy("high").agg(F.min("low").alias("least"))
    moved = edges.where("true").join(least, "high").where("low > least").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return moved.union(least.select("high", F.col("least").alias("low"))).distinct()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node, root`` for every node of ``links (a, b)``; the root is the smallest node reachable.

    Both steps are group-bys and joins on a node; a hub is pre-aggregated before the shuffle. Repeats until no edge
    changes, which takes a number of rounds logarithmic in the longest path.
    """
    a, b = F.col("a"), F.col("b")
    edges = links.where(a != b).select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct()
    edges = scratch.table(f"{name}_0", edges)
    state, turn = None, 0
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            break
        state, turn = now, turn + 1
        edges = scratch.table(f"{name}_{turn}", _small_star(_large_star(edges)))
        scratch.drop(f"{name}_{turn - 1}")
    return edges.select(F.col("high").alias("node"), F.col("low").alias("root")).union(
        edges.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct()
    )
