"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Every source is a queue of its shuffled documents, up to some copies of each. A document's virtual finish time is the
tokens of its source up to and with it, divided by the source's target; at time 1 each source has given its target. All
queues are merged by finish time and cut where the budget is used up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querydelta.operators.positions import null_safe_lookup, running
from querydelta.session import durable


def source_targets(sized: DataFrame, weights: Sequence[float], most: float, budget: float = 1.0) -> DataFrame:
    """``source, source_size, target`` per source of ``sized (source, size)``.

    Sources in code point order, NULL last, take ``weights`` in turn and share ``budget`` times all sizes in proportion. A
    target stops at ``most`` times its source's size; what is left over is shared by the others, by weight again.
    The level at which the rest fits is found by running sums over the sources in the order in which they fill up.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = running(sizes, [], ["source nulls last"], position="place__")
    cycle = F.array(*[F.lit(float(weight)) for weight in weights])
    capped = placed.select(
        "source", "source_size", F.get(cycle, ((F.col("place__") - 1) % len(weights)).cast("int")).alias("weight"),
        (F.col("source_size") * float(most)).alias("cap"), "place__",
    )
    sums = {"caps": ("sum", F.col("cap")), "parts": ("sum", F.col("weight"))}
    filling = capped.withColumn("full__", F.col("cap") / F.col("weight"))
    filling = durable(running(filling, [], ["full__", "place__"], sums, position="turn__"))
    totals = filling.agg((F.sum("source_size") * float(budget)).alias("all"), F.sum("weight").alias("parts"))
    rest = F.lit(totals.select("all").scalar()) - F.col("caps") + F.col("cap")
    level = rest / (F.lit(totals.select("parts").scalar()) - F.col("parts") + F.col("weight"))
    fits = filling.select("turn__", "full__", level.alias("level")).where("level <= full__")
    level = fits.agg(F.min_by("level", "turn__").alias("level")).scalar()
    return durable(filling.select("source", "source_size", F.least("cap", level * F.col("weight")).alias("target")))


def mix_documents(sized: DataFrame, targets: DataFrame, most: int, budget: float = 1.0, seed: str = "mix") -> DataFrame:
    """The mix in order: ``doc_id, source, place, copy, size, finish, upto, taken`` per queued copy of a document.

    ``sized``: doc_id, source, size, tie. ``place`` is the document's place in its source's shuffle (by a hash of the
    id; ``tie`` orders rows of one id), ``upto`` the tokens of the mix up to and with this copy, ``taken`` whether they
    are within the budget. Whole documents are taken, each at most ``most`` times, so a source comes within about one
    document of its target. Documents without tokens are not queued; rows equal in everything are queued one by one.
    A source of any share of the rows is summed in chunks.
    """
    key = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10)
    queued = sized.where("size > 0").select("doc_id", "source", "size", "tie", key.cast("bigint").alias("key__"))
    line = running(queued, ["source"], ["key__", "doc_id", "tie"], {"sum__": ("sum", F.col("size"))}, "place", spread=True)
    line = null_safe_lookup(line.drop("key__", "tie"), targets, ["source"])
    copies = line.select("*", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("copy"))
    finish = ((F.col("copy") - 1) * F.col("source_size") + F.col("sum__")) / F.col("target")
    copies = copies.select("doc_id", "source", "place", "copy", "size", finish.alias("finish"))
    order = ["finish", "source nulls last", "copy", "place"]
    merged = running(copies, [], order, {"upto": ("sum", F.col("size"))}, "turn", spread=True)
    limit = sized.agg(F.sum("size") * float(budget)).scalar()
    return merged.select("doc_id", "source", "place", "copy", "size", "finish", "upto", (F.col("upto") <= limit).alias("taken"))


def sized_documents(
    docs: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """``doc_id, source, size, tie``: only what the mix reads, so that no other column can clash."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(size, F.lit(0)).cast("bigint").alias("size"),
        F.xxhash64(F.col(text_col)).alias("tie"),
    )


def mix_sources(
    docs: DataFrame, size: Column, weights: Sequence[float] = (1, 2, 3), most: int = 3, budget: float = 1.0,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """``doc_id, size, source, source_size, target, taken`` per document: the tokens that the mix takes of it.

    ``taken`` counts repeats and is at most ``most`` times the size. A NULL size counts as 0; documents without tokens take
    nothing; a source without tokens has the target 0; NULL is a source of its own, the last one. Repeated rows
    and ids stay rows of their own; an empty table gives no rows. The same rows give the same mix.
    """
    sized = durable(sized_documents(docs, size, id_col, source_col, text_col))
    targets = source_targets(sized, weights, most, budget)
    mix = mix_documents(sized, targets, most, budget)
    taken = mix.groupBy("source", "place").agg(
        F.first("doc_id").alias("doc_id"), F.first("size").alias("size"),
        F.coalesce(F.sum(F.when(F.col("taken"), F.col("size"))), F.lit(0)).alias("taken"),
    )
    nothing = sized.where("size = 0").select("doc_id", "size", "source", F.lit(0).cast("bigint").alias("taken"))
    everything = taken.select("doc_id", "size", "source", "taken").unionAll(nothing)
    return null_safe_lookup(everything, targets, ["source"]).select("doc_id", "size", "source", "source_size", "target", "taken")
