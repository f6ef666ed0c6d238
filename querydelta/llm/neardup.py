"""Near duplicates by MinHash bands, sequential Bayesian verification and full shingle sets.

Texts with equal shingle sets are one node. Each node has 240 minimum hashes, cut into
48 bands of 5; nodes that agree on a band are candidates, which a pair of similarity
0.75 misses with a chance of ``(1 - 0.75 ** 5) ** 48``, about two in a million. For a
candidate pair the signatures are compared batch by batch: after ``m`` equal hashes of
``n`` the chance that the similarity reaches the threshold, under an even prior, is
``P(Binomial(n + 1, threshold) <= m)``, and the pair is dropped as soon as that is below
the miss probability. What is left is decided on the full sets.

A bucket is never expanded into all its pairs at once. First every node is compared with
the smallest node of each of its buckets. Nodes then outside the largest component of a
bucket, the strays, are compared with the bucket's nodes in blocks of bounded size, by signatures. Those that may be similar
to a node of the largest component are then compared with the full sets of that component; those that may be similar to each other
go on, block by block, to be compared by full sets there. No pair becomes a row: a block gives the nodes that go on, and
then at most one link per node.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querydelta.llm.batches import document_columns, map_columns, map_groups
from querydelta.llm.components import components
from querydelta.llm.scratch import Scratch, records_per_batch
from querydelta.llm.shingles import mix, shingle_sets

SHINGLE_WORDS = 5
#: Similarity that links, as a fraction.
NEEDED = (75, 100)
BANDS, BAND_ROWS = 48, 5
BATCH_HASHES = 48
MISS_PROBABILITY = 1e-7
#: Nodes on either side of a block in which all are compared.
BLOCK_NODES = 128
#: Rows with texts or sets that one Arrow batch may hold.
LARGE_ROWS = 500


@functools.cache
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds[:n] >> np.uint64(32)).astype(np.uint32), (seeds[n:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def signatures(sets: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """One row of ``n`` minimum hashes, each folded to 16 bits, per non-empty set."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    starts = starts[ends > starts]
    out = np.empty((len(starts), n), np.uint16)
    if not len(starts):
        return out
    short = (sets >> np.uint64(32)).astype(np.uint32)
    changed = np.empty_like(short)
    for at, (flip, factor) in enumerate(zip(*_permutations(n), strict=True)):
        np.bitwise_xor(short, flip, out=changed)
        np.multiply(changed, factor, out=changed)
        least = np.minimum.reduceat(changed, starts)
        out[:, at] = (least ^ (least >> np.uint32(16))).astype(np.uint16)
    return out


def _signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text_hash, n_shingles, digest, signature`` of every row; no words: NULL digest and signature."""

    def sign(ids, texts, hashes):
        counts, digests, signs = [], [], []
        for sets, ends in shingle_sets(texts, SHINGLE_WORDS):
            rows = iter(signatures(sets, ends, BANDS * BAND_ROWS))
            first = 0
            for last in ends.tolist():
                counts.append(last - first)
                digests.append(hashlib.blake2b(sets[first:last].tobytes(), digest_size=16).digest() if last > first else None)
                signs.append(next(rows).tobytes() if last > first else None)
                first = last
        return ids, hashes, counts, digests, signs

    return map_columns(
        document_columns(docs, id_col, text_col, _text_hash(text_col).alias("text_hash")), sign,
        "doc_id bigint, text_hash bigint, n_shingles bigint, digest binary, signature binary",
    )


def _text_hash(text_col: str) -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _band_keys(signs: np.ndarray) -> np.ndarray:
    """The bucket of every band, per row of a signature."""
    rows = signs.reshape(-1, BANDS, BAND_ROWS).astype(np.uint64)
    total = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
    for at in range(BAND_ROWS):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, at])
    return total.view(np.int64)


def _bands(nodes: DataFrame) -> DataFrame:
    """``node, n_shingles, key``: one row per band of a node."""

    def keys(ids, counts, signs):
        return ids, counts, list(_band_keys(np.frombuffer(b"".join(signs), np.uint16)))

    banded = map_columns(
        nodes.select("node", "n_shingles", "signature"), keys, "node bigint, n_shingles bigint, keys array<bigint>"
    )
    return banded.select("node", "n_shingles", F.explode("keys").alias("key"))


def _sizes_allow(a: Column, b: Column) -> Column:
    """A set cannot be similar to one that is too small to hold enough of it."""
    return F.least(a, b) * NEEDED[1] >= F.greatest(a, b) * NEEDED[0]


@functools.cache
def fewest_matches(batch: int, n: int, threshold: float, miss: float) -> tuple[int, ...]:
    """Per batch the fewest equal hashes with which a pair goes on."""
    out = []
    for seen in range(batch, n + 1, batch):
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += math.comb(seen + 1, m) * threshold**m * (1 - threshold) ** (seen + 1 - m)
        out.append(m)
    return tuple(out)


def _plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that sequential verification leaves."""
    n, needed = BANDS * BAND_ROWS, fewest_matches(BATCH_HASHES, BANDS * BAND_ROWS, NEEDED[0] / NEEDED[1], MISS_PROBABILITY)

    def prune(a, b, signs_a, signs_b):
        one = np.frombuffer(b"".join(signs_a), np.uint16).reshape(-1, n)
        two = np.frombuffer(b"".join(signs_b), np.uint16).reshape(-1, n)
        left, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
        for at, least in enumerate(needed):
            part = slice(at * BATCH_HASHES, (at + 1) * BATCH_HASHES)
            matches = matches + (one[left, part] == two[left, part]).sum(axis=1)
            left, matches = left[matches >= least], matches[matches >= least]
        return np.asarray(a)[left], np.asarray(b)[left]

    signs = nodes.select("node", "signature")
    joined = pairs.join(signs.toDF("b", "sign_b"), "b").join(signs.toDF("a", "sign_a"), "a")
    return map_columns(joined.select("a", "b", "sign_a", "sign_b"), prune, "a bigint, b bigint")


def _linked(one: np.ndarray, two: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    common = len(np.intersect1d(one, two, assume_unique=True))
    return NEEDED[1] * common >= NEEDED[0] * (len(one) + len(two) - common)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def confirm(a, b, sets_a, sets_b):
        kept = [
            at for at, (x, y) in enumerate(zip(sets_a, sets_b, strict=True))
            if _linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
        ]
        return [a[at] for at in kept], [b[at] for at in kept]

    joined = pairs.join(sets.toDF("b", "set_b"), "b").join(sets.toDF("a", "set_a"), "a")
    return map_columns(joined.select("a", "b", "set_a", "set_b"), confirm, "a bigint, b bigint")


def _sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``node, shingles`` of the given nodes, from the texts of their documents."""

    def build(ids, texts, digests):
        kept, out, at = [], [], 0
        for sets, ends in shingle_sets(texts, SHINGLE_WORDS):
            first = 0
            for last in ends.tolist():
                own = sets[first:last].tobytes()
                if hashlib.blake2b(own, digest_size=16).digest() == digests[at]:
                    kept.append(ids[at])
                    out.append(own)
                first, at = last, at + 1
        return kept, out

    texts = document_columns(docs, id_col, text_col)
    wanted = nodes.select("node", "digest", F.col("doc_id").alias("of"))
    joined = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("of"))).select("node", "text", "digest")
    return map_columns(joined, build, "node bigint, shingles binary").dropDuplicates(["node"])


def _open_members(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``key, node, n_shingles, root`` of the buckets that hold more than one component."""
    placed = members.join(roots, "node", "left").select(
        "key", "node", "n_shingles", F.coalesce("root", "node").alias("root")
    )
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
    return placed.join(mixed.select("key"), "key", "left_semi")


def _blocks(members: DataFrame, strays: DataFrame, of: str) -> DataFrame:
    """``of, row, column, stray, node ...``: every stray of ``of`` meets every member in one block of bounded size.

    Both sides are dealt into blocks of about ``BLOCK_NODES`` by a hash of the node, and each block of one side is sent to all of
    the other.
    """

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(of).agg(F.ceil(F.count(F.lit(1)) / BLOCK_NODES).cast("int").alias(name))

    sizes = blocks(members, "rows").join(blocks(strays, "columns"), of)

    def dealt(df: DataFrame, stray: bool) -> DataFrame:
        own, other = ("columns", "rows") if stray else ("rows", "columns")
        known = df.join(sizes, of).withColumn("own", F.pmod(F.xxhash64("node"), F.col(own)).cast("int"))
        known = known.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        row, column = ("other", "own") if stray else ("own", "other")
        return known.select(of, F.col(row).alias("row"), F.col(column).alias("column"), F.lit(stray).alias("stray"), *df.columns[1:])

    return dealt(members, False).union(dealt(strays, True))


def _sides(rows: list[tuple]) -> tuple[list[tuple], list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    """Members and strays of a block (``node, n_shingles, root, signature ...``), the members' signatures, sizes and roots."""
    members = [row[4:] for row in rows if not row[3]]
    strays = [row[4:] for row in rows if row[3]]
    signs = np.frombuffer(b"".join([row[3] for row in members]), np.uint16).reshape(-1, BANDS * BAND_ROWS)
    return members, strays, signs, np.array([row[1] for row in members]), np.array([row[2] for row in members])


def _alike(stray: tuple, signs: np.ndarray, sizes: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Places of the members of other components that sequential verification leaves for a stray."""
    needed = fewest_matches(BATCH_HASHES, BANDS * BAND_ROWS, NEEDED[0] / NEEDED[1], MISS_PROBABILITY)
    fits = np.minimum(sizes, stray[1]) * NEEDED[1] >= np.maximum(sizes, stray[1]) * NEEDED[0]
    left = np.flatnonzero((roots != stray[2]) & fits)
    own, matches = np.frombuffer(stray[3], np.uint16), np.zeros(len(left), np.int64)
    for at, least in enumerate(needed):
        part = slice(at * BATCH_HASHES, (at + 1) * BATCH_HASHES)
        matches = matches + (signs[left, part] == own[part]).sum(axis=1)
        left, matches = left[matches >= least], matches[matches >= least]
    return left


def _plausible_strays(placed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes outside their bucket's largest component that may have a partner.

    With ``root``: one in that component. Without: one among the other nodes of the block ``key, row, column``, on whose
    side ``stray`` it is; a pair counts in the first bucket that it shares only.
    """
    largest = (
        placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("largest"))
    )
    signed = placed.join(largest, "key").join(nodes.select("node", "signature"), "node")
    columns = ["key", "node", "n_shingles", "root", "signature"]
    members = signed.select(*columns, (F.col("root") == F.col("largest")).alias("inner"))
    strays = signed.where("root != largest").select(*columns, F.lit(False).alias("inner"))

    def compare(rows):
        members, strays, signs, sizes, roots = _sides(rows)
        inner, keys = np.array([row[4] for row in members], bool), _band_keys(signs)
        place, found, open_ = rows[0][:3], [], np.zeros(len(members), bool)
        for stray in strays:
            left = _alike(stray, signs, sizes, roots)
            if inner[left].any():
                found.append((*place, stray[0], True, int(roots[left[inner[left]][0]])))
            left = left[~inner[left]]
            own = _band_keys(np.frombuffer(stray[3], np.uint16))[0]
            left = left[own[(keys[left] == own).argmax(axis=1)] == place[0]]
            if len(left):
                found.append((*place, stray[0], True, None))
                open_[left] = True
        return found + [(*place, members[at][0], False, None) for at in np.flatnonzero(open_).tolist()]

    return map_groups(
        _blocks(members, strays, "key"), ["key", "row", "column"], compare,
        "key bigint, row int, column int, node bigint, stray boolean, root bigint",
    )


def _links_to_roots(near: DataFrame, full: DataFrame) -> DataFrame:
    """A link of each ``node, root`` of ``near``, if it has one, by the full sets of all nodes of that component."""
    members = full.join(near.select("root").distinct(), "root", "left_semi").select(
        F.col("root").alias("of"), "node", "n_shingles", "root", "signature", "shingles"
    )
    strays = near.toDF("node", "of").join(full, "node").select("of", "node", "n_shingles", "root", "signature", "shingles")
    return map_groups(_blocks(members, strays, "of"), ["of", "row", "column"], _first_links, "a bigint, b bigint")


def _links_in_blocks(near: DataFrame, full: DataFrame) -> DataFrame:
    """Links among the nodes ``key, row, column, stray, node`` of each block, by full sets."""
    known = near.join(full, "node").select(
        "key", "row", "column", "stray", "node", "n_shingles", "root", "signature", "shingles"
    )
    return map_groups(known, ["key", "row", "column"], _first_links, "a bigint, b bigint")


def _first_links(rows: list[tuple]) -> list[tuple]:
    """Links of strays to members in a block, but none between nodes that links or components join already."""
    members, strays, signs, sizes, roots = _sides(rows)
    hashes, found = [np.frombuffer(row[4], np.uint64) for row in members], []
    joined = {row[2]: row[2] for row in (*members, *strays)}

    def top(root):
        while joined[root] != root:
            joined[root] = root = joined[joined[root]]
        return root

    for stray in strays:
        own = np.frombuffer(stray[4], np.uint64)
        for at in _alike(stray, signs, sizes, roots).tolist():
            one, two = top(stray[2]), top(members[at][2])
            if one != two and _linked(own, hashes[at]):
                joined[one] = two
                found.append((stray[0], members[at][0]))
    return found


def _grouped(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id, root`` of every row."""
    spark = docs.sparkSession
    with records_per_batch(spark, LARGE_ROWS):
        signed = scratch.table("signed", _signed(docs, id_col, text_col))
    nodes = scratch.table(
        "nodes",
        signed.where("n_shingles > 0").groupBy("digest").agg(
            F.min("doc_id").alias("doc_id"), F.any_value("n_shingles").alias("n_shingles"),
            F.any_value("signature").alias("signature"),
        ).withColumn("node", F.monotonically_increasing_id()),
    )
    bands = _bands(nodes)
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("center")).where("n > 1")
    members = scratch.table(
        "members", bands.join(shared, "key").select("key", "node", "n_shingles", "center")
    )
    known = members.select("node").distinct()
    with records_per_batch(spark, LARGE_ROWS):
        sets = scratch.table("sets", _sets(docs, nodes.join(known, "node", "left_semi"), id_col, text_col))

    sizes = nodes.select("node", "n_shingles")

    def decided(pairs: DataFrame, name: str) -> DataFrame:
        """The links among the pairs ``a, b``, as a table."""
        sized = pairs.distinct().join(sizes.toDF("a", "n_a"), "a").join(sizes.toDF("b", "n_b"), "b")
        fitting = sized.where(_sizes_allow(F.col("n_a"), F.col("n_b"))).select("a", "b")
        plausible = scratch.table(f"{name}_plausible", _plausible(fitting, nodes))
        with records_per_batch(spark, LARGE_ROWS):
            links = scratch.table(f"{name}_links", _confirmed(plausible, sets))
        scratch.drop(f"{name}_plausible")
        return links

    links = decided(members.where("node != center").select(F.col("center").alias("a"), F.col("node").alias("b")), "stars")
    placed = _open_members(members, scratch.table("roots", components(links, scratch, "star")))
    placed = scratch.table("open", placed)
    near = scratch.table("near", _plausible_strays(placed, nodes))
    full = placed.select("node", "n_shingles", "root").distinct().join(nodes.select("node", "signature"), "node").join(sets, "node")
    with records_per_batch(spark, LARGE_ROWS):
        outer = scratch.table("outer", _links_to_roots(near.where("root is not null").select("node", "root").distinct(), full))
        among = scratch.table("among", _links_in_blocks(near.where("root is null").drop("root"), full))
    scratch.drop("members", "sets", "open", "near")

    final = components(links.union(outer).union(among), scratch, "last")
    named = nodes.select("node", "digest", "doc_id").join(final, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = named.join(least, "root").select("digest", "component_id", "root")
    return signed.select("doc_id", "text_hash", "n_shingles", "digest").join(classes, "digest", "left").select(
        "doc_id", "text_hash", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "root",
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    ``component_id`` is the smallest id that links lead to. A text without words, empty or NULL has no shingles and stands
    alone; fewer than five words are one shingle. Rows are linked by their texts, so repeated rows and rows of one id with
    different texts each have a row in the result. A NULL id names a component only if no other id is in it; ``kept`` compares NULLs
    as equal. An empty table gives an empty one; other columns are ignored.
    """
    grouped = _grouped(docs, Scratch(docs.sparkSession), id_col, text_col)
    return grouped.select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but one of each component, which has its smallest id.

    Of rows with that id in one component, the one with the smallest text hash stays, and of equal ones any. Rows without
    words, NULL and empty texts among them, all stay. All columns stay as they are, whatever their names. An empty table gives an
    empty one.
    """
    grouped = _grouped(docs, Scratch(docs.sparkSession), id_col, text_col)
    first = F.struct(F.col("doc_id").isNull().alias("k1__"), F.coalesce("doc_id", F.lit(0)).alias("k2__"), F.col("text_hash").alias("k3__"))
    named = grouped.where((F.col("n_shingles") > 0) & F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = named.groupBy("root").agg(F.min(first).alias("first")).select("first.*", F.lit(True).alias("stays__"))
    keys = ["k1__", "k2__", "k3__"]
    keyed = docs.select(
        F.struct("*").alias("row__"), F.col(id_col).isNull().alias("k1__"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)).alias("k2__"),
        _text_hash(text_col).alias("k3__"), F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]").alias("words__"),
    )
    copy = F.row_number().over(Window.partitionBy(*keys).orderBy("words__"))
    judged = keyed.join(stay, keys, "left").withColumn("copy__", copy)
    return judged.where(~F.col("words__") | (F.col("stays__") & (F.col("copy__") == 1))).select("row__.*")
