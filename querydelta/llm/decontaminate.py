"""Benchmark passages in documents, by SimHash over windows of the passages' own size.

Words are runs of letters and digits, whatever stands between them. For every item a
window of as many words slides over a document; window and item are sums of weighted
word shingles, whose signs are a 64-bit fingerprint. Fingerprints of items are cut into
``radius + 1`` blocks and indexed by block: two that differ in at most ``radius`` bits
agree on a block, so the index yields all of them. What is near is decided by the exact
weighted Jaccard similarity of the shingles. A shingle weighs the more the fewer items
of the whole benchmark hold it.

A window that shares no shingle with an item has similarity 0, so only windows over a
shingle of an item of that size are hashed. Items are taken in blocks of a fixed number, each of
them against all documents, so a task holds one block of items, and the counts of shingles that several items share.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querydelta.llm.batches import document_columns, keep_rows, map_columns, slices
from querydelta.llm.shingles import LOOSE, runs, sequence_hashes

SHINGLE_WORDS = 5
SIMILARITY = 0.75
#: Two passages of similarity 0.75 differ in 11 of 64 bits on average; 23 is four deviations more.
RADIUS = 23
#: Items that are compared with all documents in one pass.
ITEMS_PER_PASS = 5_000
_BITS = np.arange(64, dtype=np.uint64)
_SIEVE_BITS = 20


def _signs(hashes: np.ndarray) -> np.ndarray:
    return ((hashes[:, None] >> _BITS) & np.uint64(1)).astype(np.int8) * 2 - 1


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << _BITS).sum(axis=1, dtype=np.uint64)


class Passages:
    """One block of benchmark items, indexed."""

    def __init__(
        self, ids: list, texts: list[str], radius: int = RADIUS, similarity: float = SIMILARITY,
        shared: tuple[int, np.ndarray, np.ndarray] | None = None,
    ):
        """``shared``: what ``holders`` counts over the whole benchmark; without it the block is the whole."""
        self.radius, self.similarity = radius, similarity
        words, counts = LOOSE(texts)
        ends = np.cumsum(counts)
        self.ids, self.sizes = [], []
        self.shingles: list[np.ndarray] = []
        for at, (size, end) in enumerate(zip(counts.tolist(), ends.tolist(), strict=True)):
            if size:
                self.ids.append(ids[at])
                self.sizes.append(size)
                self.shingles.append(sequence_hashes(words[end - size : end], min(SHINGLE_WORDS, size)))
        distinct = [np.unique(own) for own in self.shingles]
        self.known, held = np.unique(np.concatenate(distinct), return_counts=True) if distinct else (np.zeros(0, np.uint64),) * 2
        total, self.weighted, held = shared or (len(self.ids), self.known, held)
        self.weights = np.log1p(total / np.maximum(held, 1))
        self.other = np.log1p(total)
        self.sieve = np.zeros(1 << _SIEVE_BITS, bool)
        self.sieve[self.known >> np.uint64(64 - _SIEVE_BITS)] = True
        holders = defaultdict(set)
        self.index: dict[int, dict[tuple[int, int], list[int]]] = defaultdict(lambda: defaultdict(list))
        self.prints = np.zeros(len(self.ids), np.uint64)
        self.cuts = np.linspace(0, 64, radius + 2).astype(int)
        for item, own in enumerate(self.shingles):
            for shingle in distinct[item].tolist():
                holders[shingle].add(self.sizes[item])
            weighted = _signs(own) * self._weight(own)[:, None]
            self.prints[item] = _fingerprints(weighted.sum(axis=0, keepdims=True))[0]
            for block in self._blocks(int(self.prints[item])):
                self.index[self.sizes[item]][block].append(item)
        self.sizes_with = dict(holders)
        self.by_length = {min(SHINGLE_WORDS, size) for size in self.sizes}

    def _weight(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.weighted):
            return np.full(len(hashes), self.other)
        at = np.minimum(np.searchsorted(self.weighted, hashes), len(self.weighted) - 1)
        return np.where(self.weighted[at] == hashes, self.weights[at], self.other)

    def _blocks(self, fingerprint: int) -> Iterator[tuple[int, int]]:
        for number, (low, high) in enumerate(zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist(), strict=True)):
            yield number, fingerprint >> low & ((1 << high - low) - 1)

    def _similarity(self, window: np.ndarray, item: int) -> float:
        """Weighted Jaccard of two bags of shingles."""
        both = np.concatenate([window, self.shingles[item]])
        values, at = np.unique(both, return_inverse=True)
        one = np.bincount(at[: len(window)], minlength=len(values))
        two = np.bincount(at[len(window) :], minlength=len(values))
        weight = self._weight(values)
        return float((np.minimum(one, two) * weight).sum() / (np.maximum(one, two) * weight).sum())

    def _hits(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of shingles that an item holds."""
        likely = np.flatnonzero(self.sieve[hashes >> np.uint64(64 - _SIEVE_BITS)])
        if not len(likely) or not len(self.known):
            return likely[:0]
        at = np.minimum(np.searchsorted(self.known, hashes[likely]), len(self.known) - 1)
        return likely[self.known[at] == hashes[likely]]

    def _windows(self, shingles: np.ndarray, hits: np.ndarray, n_words: int, size: int):
        """``(start, length, fingerprint)`` of the windows of ``size`` words over a hit."""
        n = min(SHINGLE_WORDS, size)
        length = min(size, n_words) - n + 1
        last = len(shingles) - length
        starts = np.unique((hits[:, None] - np.arange(length)).clip(0, last))
        base, top = int(starts[0]), int(starts[-1]) + length
        weighted = _signs(shingles[base:top]) * self._weight(shingles[base:top])[:, None]
        sums = np.zeros((top - base + 1, 64))
        np.cumsum(weighted, axis=0, out=sums[1:])
        prints = _fingerprints(sums[starts - base + length] - sums[starts - base])
        return zip(starts.tolist(), prints.tolist(), strict=True), length

    def _judge(self, shingles: np.ndarray, hits: np.ndarray, n_words: int, size: int) -> Iterator[tuple[int, float, int, int]]:
        windows, length = self._windows(shingles, hits, n_words, size)
        index = self.index[size]
        for start, fingerprint in windows:
            near = {item for block in self._blocks(fingerprint) for item in index.get(block, ())}
            for item in near:
                distance = (fingerprint ^ int(self.prints[item])).bit_count()
                if distance <= self.radius:
                    similarity = self._similarity(shingles[start : start + length], item)
                    if similarity >= self.similarity:
                        yield item, similarity, -start, -distance

    def matches(self, texts: list[str]) -> list[list[tuple]]:
        """Per text ``(item id, similarity, first word, words, distance)`` of each item found, at its best window."""
        out: list[list[tuple]] = []
        for first, last in slices(texts):
            words, counts = LOOSE(texts[first:last])
            best: list[dict[int, tuple]] = [{} for _ in range(last - first)]
            for n in sorted(self.by_length):
                found = runs(words, counts, n)
                hits = self._hits(found.hashes)
                bounds = np.searchsorted(found.text_of, np.arange(last - first + 1))
                for text in np.unique(found.text_of[hits]).tolist():
                    low, high = int(bounds[text]), int(bounds[text + 1])
                    own = hits[np.searchsorted(hits, low) : np.searchsorted(hits, high)] - low
                    shingles = found.hashes[low:high]
                    by_size = defaultdict(list)
                    for at in own.tolist():
                        for size in self.sizes_with[int(shingles[at])]:
                            if min(SHINGLE_WORDS, size) == n:
                                by_size[size].append(at)
                    for size, places in by_size.items():
                        for item, *quality in self._judge(shingles, np.array(places), int(counts[text]), size):
                            if tuple(quality) > best[text].get(item, (-1.0,)):
                                best[text][item] = tuple(quality)
            for text, items in enumerate(best):
                out.append([
                    (self.ids[item], similarity, -start, min(self.sizes[item], int(counts[text])), -distance)
                    for item, (similarity, start, distance) in sorted(items.items())
                ])
        return out


def holders(benchmark: DataFrame, text_col: str) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of items with words, and the shingles that several items hold, sorted, with the number of these items."""
    def shingles(texts):
        words, counts = LOOSE(texts)
        ends, found, first = np.cumsum(counts), [], []
        for size, end in zip(counts.tolist(), ends.tolist(), strict=True):
            if size:
                own = np.unique(sequence_hashes(words[end - size : end], min(SHINGLE_WORDS, size)))
                found += own.view(np.int64).tolist()
                first += [1] + [0] * (len(own) - 1)
        return found, first

    texts = benchmark.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    held = map_columns(texts, shingles, "shingle bigint, first bigint")
    total = held.agg(F.coalesce(F.sum("first"), F.lit(0)).alias("n")).first().n
    common = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1").toArrow()
    hashes = common.column("shingle").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return int(total), hashes[order], common.column("n").to_numpy()[order]


def passes(benchmark: DataFrame, id_col: str, text_col: str, per_pass: int) -> Iterator[tuple[list, list[str]]]:
    """The items in blocks of about ``per_pass``; only one block is held at a time."""
    items = benchmark.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_blocks = -(-items.count() // per_pass)
    for block in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == block).collect()
        yield [row.id for row in rows], [row.text for row in rows]


def find_passages(
    docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY,
    per_pass: int = ITEMS_PER_PASS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``doc_id, item_id, similarity, first_word, n_words, distance``: one row per document and item found in it.

    The best window of an item counts, of equal ones the first. An item of fewer than five words is one shingle; a
    document shorter than an item is one window. Empty and NULL texts, on either side, match nothing; a NULL id stays; a
    repeated row, on either side, has rows of its own; empty tables give an empty one; other columns are ignored.
    """
    schema = "doc_id bigint, item_id bigint, similarity double, first_word bigint, n_words bigint, distance bigint"
    texts = document_columns(docs, id_col, text_col)
    out, shared = None, holders(benchmark, item_text_col)
    for ids, items in passes(benchmark, item_col, item_text_col, per_pass):
        block = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, ids, items, shared))

        def search(doc_ids, doc_texts, block=block):
            rows = [
                (doc_id, *match)
                for doc_id, found in zip(doc_ids, _passages(block, radius, similarity).matches(doc_texts), strict=True)
                for match in found
            ]
            return list(zip(*rows, strict=True)) if rows else [[]] * 6

        found = map_columns(texts, search, schema)
        out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


_BUILT: dict = {}


def _passages(block, radius: int, similarity: float) -> Passages:
    """The index of a broadcast block; a worker process keeps the last one it built."""
    name, ids, texts, shared = block.value
    if (name, radius, similarity) not in _BUILT:
        _BUILT.clear()
        _BUILT[name, radius, similarity] = Passages(ids, texts, radius, similarity, shared)
    return _BUILT[name, radius, similarity]


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY,
    per_pass: int = ITEMS_PER_PASS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all columns as they are; no row is moved.

    NULL and empty texts stay, and so does everything if the benchmark is empty; repeated rows stay or go together.
    """
    shared = holders(benchmark, item_text_col)
    for ids, items in passes(benchmark, item_col, item_text_col, per_pass):
        block = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, ids, items, shared))

        def clean(texts, block=block):
            return np.array([not found for found in _passages(block, radius, similarity).matches(texts)], bool)

        docs = keep_rows(docs, text_col, clean)
    return docs
