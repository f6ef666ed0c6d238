"""Texts of an Arrow column as bytes in numpy, and the runs of bytes by which a text shows what it holds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

#: Lengths in bytes of passages that are searched alike; a passage counts as the longest that it reaches.
SIZES = (8, 16, 32, 64)
#: Bytes that are hashed at once, whatever the length of texts: few enough for a core's own cache.
PART_BYTES = 1 << 16
#: The first bits of a run, by which a text's runs are sieved.
SIEVE_BITS = 24
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def octets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values one after another (NULL: none), and the bounds of each value in them."""
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]
    octets = np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]]
    return octets, bounds - bounds[0]


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * _MIX[0]
    values = (values ^ (values >> np.uint64(27))) * _MIX[1]
    return values ^ (values >> np.uint64(31))


def _extremes(values: np.ndarray, n: int, pick: np.ufunc) -> np.ndarray:
    """The least (or largest) of every ``n`` neighbours."""
    span = 1
    while 2 * span <= n:
        values, span = pick(values[:-span], values[span:]), 2 * span
    return pick(values[: span - n], values[n - span :]) if n > span else values


def _part_runs(octets: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the runs of every ``size`` neighbouring bytes that lie within ``bounds``."""
    n = max(8, size // 2)
    if len(octets) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes, width = _mixed(np.ndarray(len(octets) - 7, "<u8", octets, strides=(1,))), 8
    while width < n:
        hashes, width = _mixed(hashes[:-width] * _STEP + hashes[width:]), 2 * width
    hashes |= np.uint64(1)
    near = size - n + 1
    least = _extremes(hashes, near, np.minimum)
    ends = np.repeat(bounds[1:], np.diff(bounds))[: len(least)]
    least = np.where(np.arange(len(least)) + size <= ends, least, np.uint64(0))
    around = np.zeros(near - 1, np.uint64)
    at = np.flatnonzero(_extremes(np.concatenate([around, least, around]), near, np.maximum) == hashes)
    return at, _mixed(hashes[at] + np.uint64(size))


def byte_runs(octets: np.ndarray, bounds: np.ndarray, size: int, part_bytes: int = PART_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(place, run)`` in parts: places in ``octets`` and hashes of runs that a text shares with every text that holds it.

    Of all runs of half as many bytes (8 at least) within each ``size`` neighbouring bytes the one with the least hash
    stands for them. So each passage of ``size`` bytes has one, whatever stands around it, and a text has about four per
    ``size`` bytes. A run may come twice.
    """
    octets = np.ascontiguousarray(octets)
    for first in range(0, len(octets), part_bytes):
        part = octets[first : first + part_bytes + size - 1]
        places, hashes = _part_runs(part, np.clip(bounds - first, 0, len(part)), size)
        yield places + first, hashes


def runs_of_texts(
    texts: pa.Array, sizes: Sequence[int], salts: np.ndarray | None = None, own: np.ndarray | None = None,
    sieve: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of texts and their runs of all ``sizes``, each pair once.

    With ``salts`` (one per text), runs of texts agree only if these do. With ``own`` (one per text), a text has runs of this
    size only. With ``sieve``, only runs whose first bits are marked in it.
    """
    octets, bounds = octets_of(texts)
    numbers, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for size in sizes:
        for places, runs in byte_runs(octets, bounds, size):
            if salts is not None:
                runs = _mixed(runs ^ salts[np.searchsorted(bounds, places, "right") - 1])
            if sieve is not None:
                first = runs >> np.uint64(64 - SIEVE_BITS)
                marked = sieve[first >> np.uint64(3)] >> (first & np.uint64(7)).astype(np.uint8) & 1 == 1
                places, runs = places[marked], runs[marked]
            number = np.searchsorted(bounds, places, "right") - 1
            if own is not None:
                number, runs = number[own[number] == size], runs[own[number] == size]
            numbers.append(number)
            found.append(runs)
    numbers, found = np.concatenate(numbers), np.concatenate(found)
    order = np.lexsort((found, numbers))
    numbers, found = numbers[order], found[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (numbers[1:] != numbers[:-1])
    return numbers[new], found[new]
