"""Runs: stretches of words that repeat with a short period, found from longest common extensions.

A run of period ``q`` and exponent ``e`` holds a point of the grid with step ``(e - 1) * q`` at which the text equals
itself ``q`` words on. So all grids together have ``n log n`` points, and a run is what such a point extends to on either
side. An extension compares at most ``MODULUS`` words to reach two positions that both belong to a difference cover, and
reads the rest from a sparse table over the sorted suffixes of the cover alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from querydelta.llm.batches import document_columns, slices

#: Every difference modulo ``MODULUS`` is one of two members of ``COVER``.
MODULUS, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Grid points looked at together.
POINTS = 1 << 20


def _steps_to_cover() -> np.ndarray:
    """``[a, b]``: the least step that takes both remainders into the cover."""
    inside = np.isin(np.arange(MODULUS), COVER)
    steps = np.full((MODULUS, MODULUS), -1)
    for step in reversed(range(MODULUS)):
        moved = np.roll(inside, -step)
        steps[moved[:, None] & moved[None, :]] = step
    return steps


_STEPS = _steps_to_cover()


def _matches(words: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many of the next ``most`` words from ``i`` and ``j`` on are equal."""
    found = np.zeros(len(i), np.int64)
    open_ = np.flatnonzero(most > 0)
    while len(open_):
        at = found[open_]
        open_ = open_[words[i[open_] + at] == words[j[open_] + at]]
        found[open_] += 1
        open_ = open_[found[open_] < most[open_]]
    return found


def _dense(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by ``keys`` and the rank of each row; equal rows have one rank."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for key in keys:
        new[1:] |= key[order[1:]] != key[order[:-1]]
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(new)
    return order, ranks


class Extensions:
    """Longest common extensions in ``words``, non-negative numbers whose last one occurs nowhere else."""

    def __init__(self, words: np.ndarray):
        self.words, n = words, len(words)
        classes = [np.arange(first, n, MODULUS) for first in COVER]
        places = np.concatenate(classes)
        ends = np.cumsum([len(own) for own in classes])
        self.left = np.repeat(ends, [len(own) for own in classes]) - np.arange(len(places))  # members of the class from here on
        self.slot = np.full(n, -1)
        self.slot[places] = np.arange(len(places))
        self.levels = [self._block_ranks(places)]
        order, width = np.argsort(self.levels[0], kind="stable"), 1
        while self.levels[-1].max(initial=-1) + 1 < len(places):
            ranks = self.levels[-1]
            order, longer = _dense([ranks, self._later(ranks, width)])
            self.levels.append(longer)
            width *= 2
        self.table = [self._neighbours(places, order)]
        while 2 << (len(self.table) - 1) <= len(self.table[0]):
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    def _block_ranks(self, places: np.ndarray) -> np.ndarray:
        """Rank the first ``MODULUS`` words of every sampled suffix, several words to a key."""
        padded = np.concatenate([self.words + 1, np.zeros(MODULUS, np.int64)])
        bits = int(padded.max()).bit_length()
        keys, per = [], max(1, 62 // bits)
        for first in range(0, MODULUS, per):
            key = np.zeros(len(places), np.int64)
            for at in range(first, min(first + per, MODULUS)):
                key = (key << bits) | padded[places + at]
            keys.append(key)
        return _dense(keys)[1]

    def _later(self, ranks: np.ndarray, width: int) -> np.ndarray:
        """The rank ``width`` blocks on, -1 past the end."""
        later = np.full(len(ranks), -1)
        inside = np.flatnonzero(self.left > width)
        later[inside] = ranks[inside + width]
        return later

    def _neighbours(self, places: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Equal words of suffixes next to each other in the order: whole blocks from the ranks, then single words."""
        a, b = order[:-1], order[1:]
        blocks = np.zeros(len(a), np.int64)
        for level in reversed(range(len(self.levels))):
            ranks = self.levels[level]
            open_ = np.flatnonzero((self.left[a] > blocks) & (self.left[b] > blocks))
            same = open_[ranks[a[open_] + blocks[open_]] == ranks[b[open_] + blocks[open_]]]
            blocks[same] += 1 << level
        done = blocks * MODULUS
        i, j = places[a] + done, places[b] + done
        room = len(self.words) - np.maximum(i, j)
        return done + _matches(self.words, i, j, np.minimum(room, MODULUS))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from ``i`` and from ``j`` on are equal (``i`` and ``j`` differ)."""
        steps = _STEPS[i % MODULUS, j % MODULUS]
        found = _matches(self.words, i, j, steps)
        far = np.flatnonzero(found == steps)
        ranks = self.levels[-1]
        a, b = ranks[self.slot[i[far] + steps[far]]], ranks[self.slot[j[far] + steps[far]]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp(high - low)[1] - 1
        for k in np.unique(level):
            own = np.flatnonzero(level == k)
            found[far[own]] += np.minimum(self.table[k][low[own]], self.table[k][high[own] - (1 << k)])
        return found


def _grid(starts: np.ndarray, sizes: np.ndarray, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(text, place, period)`` of the grid points of every period, about ``POINTS`` at a time."""
    periods = sizes // exponent
    text = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = (exponent - 1) * period
    points = (sizes[text] - period - 1) // step + 1
    cuts = np.searchsorted(np.cumsum(points), np.arange(1, points.sum() // POINTS + 1) * POINTS)
    for own in np.split(np.arange(len(text)), cuts):
        n = points[own]
        which = np.repeat(own, n)
        at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        yield text[which], starts[text[which]] + at * step[which], period[which]


def _promising(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, exponent: int) -> tuple[np.ndarray, ...]:
    """Grid points that may lie in a run: equal one period on, and not cut off on both sides within a few words."""
    backward, n = words[::-1], len(words)
    kept = [(np.zeros(0, np.int64),) * 3]
    for text, i, q in _grid(starts, sizes, exponent):
        same = words[i] == words[i + q]
        text, i, q = text[same], i[same], q[same]
        most = np.full(len(i), MODULUS)
        after, before = _matches(words, i, i + q, most), _matches(backward, n - i, n - i - q, most)
        open_ = (after + before >= (exponent - 1) * q) | (after == MODULUS) | (before == MODULUS)
        kept.append((text[open_], i[open_], q[open_]))
    return tuple(map(np.concatenate, zip(*kept, strict=True)))


def find_runs(texts: list[np.ndarray], exponent: int = 4, least: int = 6) -> list[np.ndarray]:
    """Per text of word numbers its runs as rows ``start, length, period``, by start, then period.

    A run is as long as it can be, with its smallest period, at least ``exponent`` periods and ``least`` words.
    """
    sizes = np.array([len(text) for text in texts], np.int64)
    words, starts = _joined(texts, sizes)
    text, i, q = _promising(words, starts, sizes, exponent)
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    if not len(i):
        return out
    held, text = np.unique(text, return_inverse=True)
    inside = i - starts[held][text]
    words, starts = _joined([texts[at] for at in held], sizes[held])
    i, n = inside + starts[text], len(words)
    after = Extensions(words)(i, i + q)
    before = Extensions(words[::-1].copy())(n - i, n - i - q)
    length = before + after + q
    long = length >= np.maximum(least, exponent * q)
    rows = np.stack([text, inside - before, length, q], axis=1)[long]
    rows = rows[np.lexsort(rows.T[::-1])]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)  # one stretch, found with multiples of its period too
    rows = rows[new]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    for at, own in zip(held, np.split(rows, np.searchsorted(rows[:, 0], np.arange(1, len(held)))), strict=True):
        out[at] = own[:, 1:]
    return out


def _joined(texts: list[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, with a number of its own before, between and after them, and their starts."""
    top = max((int(text.max()) for text in texts if len(text)), default=-1) + 1
    starts = np.cumsum(sizes + 1) - sizes
    words = np.empty(int(sizes.sum()) + len(texts) + 1, np.int64)
    borders = np.concatenate([[0], starts + sizes])
    words[borders] = top + np.arange(len(borders))
    for start, text in zip(starts, texts, strict=True):
        words[start : start + len(text)] = text
    return words, starts


def _kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay when of every run only its first period does."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.flatnonzero(np.cumsum(change[:n]) == 0)


_RUN = "struct<start: bigint, length: bigint, period: bigint>"
RESULT = f"doc_id bigint, n_words bigint, runs array<{_RUN}>, strongest {_RUN}, collapsed string"


def collapse_runs(
    docs: DataFrame, exponent: int = 4, least: int = 6, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_words, runs, strongest, collapsed`` of every whole text.

    Words are what lies between ASCII white space, numbered from 0. ``runs`` are ordered by start, then period;
    ``strongest`` has the greatest length in periods (ties: the smallest start, then period), NULL without a run.
    ``collapsed`` holds the words, joined by one space, that no run has after its first period. A NULL or empty text has
    no words, no runs and an empty ``collapsed``; repeated rows and ids stay rows of their own, a NULL id stays NULL; an
    empty table gives no rows; other columns are not read. Texts are taken by slices of bounded length, one longer
    text on its own.
    """
    types = StructType.fromDDL(RESULT)
    arrow = to_arrow_schema(types)

    def run(batches):
        for batch in batches:
            ids, texts = (column.to_pylist() for column in batch.columns)
            for first, last in slices(texts):
                rows = zip(ids[first:last], _collapsed(texts[first:last], exponent, least), strict=True)
                columns = zip(*[(id_, *row) for id_, row in rows], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values, type=field.type) for values, field in zip(columns, arrow, strict=True)], schema=arrow
                )

    return document_columns(docs, id_col, text_col).mapInArrow(run, types)


def _collapsed(texts: list[str], exponent: int, least: int) -> Iterator[tuple]:
    numbers: dict[bytes, int] = {}
    split = [text.encode().split() for text in texts]  # bytes are split at ASCII white space only
    coded = [np.array([numbers.setdefault(word, len(numbers)) for word in words], np.int64) for words in split]
    for words, runs in zip(split, find_runs(coded, exponent, least), strict=True):
        named = [dict(zip(("start", "length", "period"), row, strict=True)) for row in runs.tolist()]
        best = min(named, key=lambda r: (-Fraction(r["length"], r["period"]), r["start"], r["period"]), default=None)
        kept = [words[at] for at in _kept(len(words), runs).tolist()] if named else words
        yield len(words), named, best, b" ".join(kept).decode()
