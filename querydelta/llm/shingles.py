"""Words and word shingles of many texts at once, as 64-bit hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from querydelta.llm.batches import slices

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(values: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all others."""
    values = (values ^ (values >> np.uint64(30))) * _MIX[0]
    values = (values ^ (values >> np.uint64(27))) * _MIX[1]
    return values ^ (values >> np.uint64(31))


class Splitter:
    """Cuts UTF-8 texts into words at the bytes of ``separators``; A-Z count as a-z."""

    def __init__(self, separators: bytes):
        self.separates = np.zeros(256, bool)
        self.separates[np.frombuffer(separators, np.uint8)] = True
        folded = np.arange(256, dtype=np.uint8)
        folded[ord("A") : ord("Z") + 1] += 32
        self.letters = mix(folded.astype(np.uint64) + np.uint64(1))
        self.powers = self.inverses = np.ones(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            steps = np.full(n, _STEP)
            steps[0] = 1
            self.powers = np.cumprod(steps)
            steps[1:] = _BACK
            self.inverses = np.cumprod(steps)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The hash of every word, and the number of words of each text.

        A word's hash is a polynomial over its bytes, from the difference of two running sums over the whole slice.
        """
        parts = [text.encode() for text in texts]
        raw = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
        self._grow(len(raw))
        apart = self.separates[raw]
        border = np.flatnonzero(apart[1:] != apart[:-1]) + 1
        if len(raw) and not apart[0]:
            border = np.concatenate([[0], border])
        starts, ends = border[0::2], border[1::2]
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.letters[raw] * self.powers[: len(raw)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))
        bounds = np.cumsum([0, *[len(part) + 1 for part in parts]])
        return hashes, np.diff(np.searchsorted(starts, bounds))


#: Space, tab, newline, vertical tab, form feed, return.
PLAIN = Splitter(b"\x20\t\n\x0b\x0c\r")
#: Every ASCII character but letters and digits.
LOOSE = Splitter(bytes(at for at in range(128) if not chr(at).isalnum()))


def sequence_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of ``n`` word hashes."""
    total = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for at in range(n):
        total = total * _STEP + words[at : at + len(total)]
    return mix(total)


@dataclass(frozen=True)
class Runs:
    """The hashes of all runs of words of some texts in order, and the text each is from."""

    hashes: np.ndarray
    text_of: np.ndarray


def runs(words: np.ndarray, counts: np.ndarray, n: int) -> Runs:
    """Runs of ``n`` words that lie in one text."""
    ends = np.cumsum(counts)
    hashes = sequence_hashes(words, n)
    text_of = np.repeat(np.arange(len(counts)), counts)[: len(hashes)]
    inside = np.arange(len(hashes)) + n <= ends[text_of] if len(hashes) else np.zeros(0, bool)
    return Runs(hashes[inside], text_of[inside])


def _filled(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts of fewer than ``n`` words, but for empty ones, filled up to ``n`` with the hash 0."""
    sizes = np.where(counts > 0, np.maximum(counts, n), 0)
    before = np.cumsum(sizes - counts) - (sizes - counts)
    out = np.zeros(int(sizes.sum()), np.uint64)
    out[np.arange(len(words)) + np.repeat(before, counts)] = words
    return out, sizes


def shingle_sets(texts: list[str], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per slice of ``texts`` the distinct shingle hashes, sorted within a text, and the end of each text's part.

    Fewer than ``n`` words are one shingle, filled up with a hash that no word has but by chance; no words are none.
    """
    for first, last in slices(texts):
        found = runs(*_filled(*PLAIN(texts[first:last]), n), n)
        hashes, sizes = found.hashes, np.bincount(found.text_of, minlength=last - first)
        at = 0
        for size in sizes.tolist():
            hashes[at : at + size].sort()
            at += size
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (found.text_of[1:] != found.text_of[:-1])
        yield hashes[new], np.cumsum(np.bincount(found.text_of[new], minlength=last - first))
