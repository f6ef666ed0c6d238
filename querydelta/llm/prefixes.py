"""The trie of all prefixes of conversations, built from neighbours in sorted order.

Distinct sequences are sorted by range. Neighbours are joined by union-find over their longest common prefixes, deepest
first: a component is a stretch of neighbours, and each merge makes the node at which they branch; between two merges a
stretch is a chain of nodes. Every partition so builds a forest. A node on its first or last sequence may go on in the
partition beside it; such nodes are contracted to sums that add up, and are merged by one aggregate.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from querydelta.llm.scratch import Scratch
from querydelta.operators.positions import running

#: Hex digits of a turn in a sequence's key, and of a node's name.
TOKEN = 32
#: Distinct sequences that one task turns into a forest.
SEQUENCES = 20_000
#: Members of a node that are joined to one string before they are hashed.
MEMBERS = 10_000

_NODE = (
    "node string, parent string, depth bigint, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "repeated bigint, once bigint, open boolean, parent_conv_id bigint"
)


def turn_token(role: Column, text: Column) -> Column:
    """A turn as 32 hex digits; NULL is the empty string."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, TOKEN)


def _shared(a: str, b: str) -> int:
    """Turns that two keys begin with in common."""
    at = 0
    while at < len(a) and a[at : at + TOKEN] == b[at : at + TOKEN]:
        at += TOKEN
    return at // TOKEN


def _name(prefix: str) -> str:
    return hashlib.sha256(prefix.encode()).hexdigest()[:TOKEN]


class Forest:
    """The nodes over sorted distinct sequences, and which of them the neighbours ``before`` and ``after`` share.

    ``left`` and ``right`` are the turns shared with the last sequence before and the first one after (-1: none).
    ``once`` adds up words of nodes that no earlier partition has, ``repeated`` those of every member.
    """

    def __init__(self, keys: Sequence[str], counts, convs, words, before: str | None, after: str | None):
        self.keys, self.words = keys, words
        self.left = -1 if before is None else _shared(before, keys[0])
        self.right = -1 if after is None else _shared(keys[-1], after)
        n = len(keys)
        shared = [_shared(keys[at], keys[at + 1]) for at in range(n - 1)]
        self.low, self.high = list(range(n)), list(range(n))
        self.top = [len(key) // TOKEN for key in keys]
        self.count, self.conv = list(counts), list(convs)
        self.leaves = [int(depth < top) for depth, top in zip([*shared, self.right], self.top, strict=True)]
        self.repeated, self.once, self.children = [0] * n, [0] * n, [0] * n
        self.below: list[list[int]] = [[] for _ in range(n)]
        self.root_of = list(range(n))
        self.nodes: list[list] = []
        for edge in sorted(range(n - 1), key=lambda at: -shared[at]):
            self._merge(self._find(edge), self._find(edge + 1), shared[edge])
        self._climb(self._find(0), -1)

    def _find(self, at: int) -> int:
        while self.root_of[at] != at:
            self.root_of[at] = at = self.root_of[self.root_of[at]]
        return at

    def _climb(self, at: int, depth: int) -> None:
        """Make the nodes of a component from its top to just below ``depth``."""
        low, edge = self.low[at], self.high[at] == len(self.keys) - 1
        key, words = self.keys[low], self.words[low]
        for own in range(self.top[at], depth, -1):
            known = low == 0 and own <= self.left
            weight = words[own - 1] if own else 0
            self.repeated[at] += self.count[at] * weight
            self.once[at] += 0 if known else weight
            for child in self.below[at]:
                self.nodes[child][-1] = len(self.nodes)
            self.below[at] = [len(self.nodes)]
            self.nodes.append([
                key[: own * TOKEN], own, self.conv[at], self.count[at], self.children[at], self.leaves[at],
                self.repeated[at], self.once[at], known or (edge and own <= self.right) or own == 0, None,
            ])
            self.children[at] = int(not known)
        self.top[at] = depth

    def _merge(self, a: int, b: int, depth: int) -> None:
        self._climb(a, depth)
        self._climb(b, depth)
        if len(self.below[a]) < len(self.below[b]):
            a, b = b, a
        self.root_of[b] = a
        self.low[a], self.high[a] = min(self.low[a], self.low[b]), max(self.high[a], self.high[b])
        self.conv[a] = min(self.conv[a], self.conv[b])
        self.below[a] += self.below[b]
        for sums in (self.count, self.leaves, self.repeated, self.once, self.children):
            sums[a] += sums[b]

    def rows(self) -> Iterator[tuple]:
        names = [_name(node[0]) for node in self.nodes]
        for name, (prefix, depth, *sums, open_, parent) in zip(names, self.nodes, strict=True):
            up = None if parent is None else names[parent]
            closed = parent is not None and not self.nodes[parent][8]
            yield name, up, depth, *sums, open_, self.nodes[parent][2] if closed else None


def _forests(arrow: pa.Schema, batches):
    """One forest per part; rows come by part, then the sequence before, its own ones in order, and the one after."""
    rows = (row for batch in batches for row in zip(*[column.to_pylist() for column in batch.columns], strict=True))
    for _, part in itertools.groupby(rows, key=lambda row: row[0]):
        before, own, after = None, [], None
        for _, side, key, *rest in part:
            if side == 0:
                before = key
            elif side == 2:
                after = key
            else:
                own.append((key, *rest))
        columns = list(zip(*Forest(*zip(*own, strict=True), before, after).rows(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(values, type=field.type) for values, field in zip(columns, arrow, strict=True)], schema=arrow)


def prefix_trie(sequences: DataFrame, per_task: int = SEQUENCES) -> tuple[DataFrame, DataFrame]:
    """The trie's nodes, and the members that end at each.

    ``sequences``: ``conv_id``, one row each and not NULL, and ``turns``, an array of ``token`` (see ``turn_token``) and
    ``words``, which may be empty or NULL. Nodes: ``node, parent, depth, conv_id`` (the smallest member), ``n_convs,
    n_children, n_leaves, saved_tokens, parent_conv_id``; a node is a distinct sequence of first turns, ``depth`` 0 the
    empty one. Ends: ``node, conv_id``. An empty table gives no nodes. Equal sequences are counted before they are
    sorted; a task holds ``per_task`` distinct ones, whatever share of all conversations they stand for.
    """
    spark = sequences.sparkSession
    scratch = Scratch(spark)
    turns = F.coalesce("turns", F.array().cast(sequences.schema["turns"].dataType))
    keyed = scratch.table("keyed", sequences.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.array_join(F.transform(turns, lambda turn: turn["token"]), "").alias("key"),
        F.transform(turns, lambda turn: turn["words"].cast("bigint")).alias("words"),
    ))
    distinct = scratch.table("distinct", keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv"), F.first("words").alias("words")
    ))
    parts = max(1, -(-distinct.count() // per_task))
    ranged = scratch.table("ranged", distinct.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()))
    ends = ranged.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    line = Window.orderBy("part")  # one row per task
    sides = ends.select("part", F.lag("high").over(line).alias("before"), F.lead("low").over(line).alias("after"))
    own = ranged.select("part", F.lit(1).alias("side"), "key", "n", "conv", "words")
    nothing = [F.lit(None).cast(kind) for kind in ("bigint", "bigint", "array<bigint>")]
    for side, name in ((0, "before"), (2, "after")):
        own = own.unionAll(sides.where(F.col(name).isNotNull()).select("part", F.lit(side), name, *nothing))
    forests = own.repartition(parts, "part").sortWithinPartitions("part", "side", "key").mapInArrow(
        partial(_forests, to_arrow_schema(StructType.fromDDL(_NODE))), _NODE
    )
    nodes = scratch.table("nodes", forests)
    merged = scratch.table("merged", nodes.where("open").groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        *[F.sum(name).alias(name) for name in ("n_convs", "n_children", "n_leaves", "repeated", "once")],
        F.lit(None).cast("bigint").alias("parent_conv_id"),
    ))
    columns = merged.columns
    whole = nodes.where("not open").select(*columns).unionAll(merged)
    upper = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("upper__"))
    # a parent that several tasks share is known after the merge only; one row per parent, so a hot one just makes the other side uneven
    found = whole.where("parent_conv_id is null").join(upper, "parent", "left").withColumn("parent_conv_id", F.col("upper__"))
    trie = whole.where("parent_conv_id is not null").select(*columns).unionAll(found.select(*columns))
    members = keyed.select(F.substring(F.sha2("key", 256), 1, TOKEN).alias("node"), "conv_id")
    return trie.select(
        "node", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("repeated") - F.col("once")).alias("saved_tokens"), "parent_conv_id",
    ), members


def member_digests(members: DataFrame) -> DataFrame:
    """``node, ends_sha256``: the hash of a node's ids, ascending and joined by commas.

    Ids are numbered and joined in blocks first, so a node with a third of all members is read as few rows, in a stream.
    """
    placed = running(members, ["node"], ["conv_id"], position="at", spread=True)
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda id_: id_.cast("string"))
    blocks = placed.groupBy("node", F.floor((F.col("at") - 1) / MEMBERS).alias("block")).agg(F.array_join(ids, ",").alias("ids"))

    def run(batches):
        rows = (row for batch in batches for row in zip(*[column.to_pylist() for column in batch.columns], strict=True))
        out = []
        for node, group in itertools.groupby(rows, key=lambda row: row[0]):
            digest = hashlib.sha256()
            for at, (_, _, ids) in enumerate(group):
                digest.update(b"," * (at > 0) + ids.encode())
            out.append((node, digest.hexdigest()))
            if len(out) == MEMBERS:
                yield pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*out, strict=True)], ["node", "ends_sha256"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*out, strict=True)], ["node", "ends_sha256"])

    return blocks.repartition("node").sortWithinPartitions("node", "block").mapInArrow(run, "node string, ends_sha256 string")
