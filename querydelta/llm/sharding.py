"""Placement by a weighted hash tree: a row descends from regions over racks to a shard.

At each node every child draws ``-ln(u) / weight``, where ``u`` is a hash of the row's
key and the child, and the smallest draw wins. A child is so chosen in proportion to its
weight, and a draw depends on nothing but its own child: a changed weight moves rows only
to or from the subtree that holds it, a new subtree takes rows only into itself, and all
draws below untouched nodes stay as they were.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task numbers; more rows make more tasks.
ROWS_PER_TASK = 10_000


@dataclass(frozen=True)
class Tree:
    """``regions[r][k]`` lists the ``(shard, weight)`` pairs of rack ``k`` in region ``r``."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    def __post_init__(self):
        shards = [shard for racks in self.regions for rack in racks for shard, _ in rack]
        if len(set(shards)) != len(shards) or not shards:
            raise ValueError("shards must be named once, and there must be one")
        if any(weight <= 0 for racks in self.regions for rack in racks for _, weight in rack):
            raise ValueError("weights must be positive")

    def with_region(self, racks: Sequence[Sequence[tuple[int, float]]]) -> Tree:
        """The tree with one more region, which alone takes rows."""
        return Tree((*self.regions, tuple(tuple(rack) for rack in racks)))

    def levels(self) -> list[list[list[tuple[int, float]]]]:
        """Per level and node the ``(child, weight)`` pairs; nodes are numbered along each level."""
        root, racks, shards = [], [], []
        for region, own in enumerate(self.regions):
            root.append((region, sum(weight for rack in own for _, weight in rack)))
            racks.append([])
            for rack in own:
                racks[-1].append((len(shards), sum(weight for _, weight in rack)))
                shards.append(list(rack))
        return [[root], racks, shards]


def even_tree(n_shards: int, racks: int = 2, per_rack: int = 4) -> Tree:
    """Shards of weight 1, ``per_rack`` to a rack and ``racks`` to a region, in order of their numbers."""
    shards = [(shard, 1.0) for shard in range(n_shards)]
    full = [tuple(shards[at : at + per_rack]) for at in range(0, n_shards, per_rack)]
    return Tree(tuple(tuple(full[at : at + racks]) for at in range(0, len(full), racks)))


def shard_of(df: DataFrame, key: Column, tree: Tree, name: str) -> DataFrame:
    """Add the shard of ``key`` as column ``name``; a NULL key has a shard like any other."""
    out, node, used = df.withColumn("key__", key), F.lit(0), ["key__"]

    def draws_at(level: int):
        def draw(child: Column) -> Column:
            drawn = F.shiftrightunsigned(F.xxhash64(F.col("key__"), F.lit(level), child["id"]), 11)
            return F.struct((-F.log((drawn + 0.5) / float(1 << 53)) / child["weight"]).alias("draw"), child["id"].alias("id"))

        return draw

    for level, nodes in enumerate(tree.levels()):
        children = F.array(*[
            F.array(*[F.struct(F.lit(id_).alias("id"), F.lit(float(weight)).alias("weight")) for id_, weight in own])
            for own in nodes
        ])
        draws = F.transform(F.get(children, node), draws_at(level))
        column = f"node{level}__"
        out = out.withColumn(column, F.array_min(draws)["id"])
        node = F.col(column)
        used.append(column)
    return out.withColumn(name, node).drop(*used)


def shard_documents(
    docs: DataFrame, tree: Tree, grown: Tree | None = None, id_col: str = "doc_id", text_col: str = "text",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    The id alone decides the shard (law ``key``); ``grown_shard`` is that in ``grown``. ``size`` is the text's UTF-8 bytes
    and 8, ``slot`` numbers the rows of a shard without gaps from 0. A NULL text counts as empty; a NULL id is a key of its
    own; repeated rows share a shard and have slots of their own; an empty table gives an empty one; other columns are
    ignored.

    A shard may hold billions of rows, so it is never sorted whole: ids are hashed into parts of about ``rows_per_task``
    rows, parts are counted from the ids alone, and a row's slot is its rank in its part plus the rows of earlier parts.
    """
    n_shards = sum(len(rack) for racks in tree.regions for rack in racks)
    keys = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = keys.select("doc_id").count() // (n_shards * rows_per_task) + 1
    part = F.pmod(F.xxhash64("doc_id", F.lit("slot")), F.lit(parts)).alias("part")
    counted = shard_of(keys.select("doc_id"), F.col("doc_id"), tree, "shard").groupBy("shard", part).agg(
        F.count(F.lit(1)).alias("n")
    )
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("shard", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    placed = shard_of(keys, F.col("doc_id"), tree, "shard")
    if grown is None:
        placed = placed.withColumn("grown_shard", F.lit(None).cast("int"))
    else:
        placed = shard_of(placed, F.col("doc_id"), grown, "grown_shard")
    placed = placed.select(
        "doc_id", (F.octet_length("text") + 8).cast("bigint").alias("size"), F.crc32("text").alias("text_crc32"),
        "shard", "grown_shard", part,
    )
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32")
    return placed.join(offsets, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("offset") + F.row_number().over(inside) - 1).alias("slot"), "grown_shard",
    )
