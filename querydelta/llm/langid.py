"""Language identification by character models with interpolated Kneser-Ney smoothing.

Texts are reduced to lower-case letters with single blanks between words. One model per
language gives each character a probability after the two before it: absolute
discounting of the counts, the rest handed to bigrams and letters by the number of different
characters that stand before them. All n-grams are held in sorted arrays of 64-bit
hashes, next to a matrix with one log-probability per language, so a text is scored for
all languages by one search per character. The language of the lowest cross-entropy per
character wins. Scores and the rejection limit are calibrated on training documents.
"""

from __future__ import annotations

import functools
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querydelta.llm.batches import document_columns, hash_sample, map_columns, slices, smallest
from querydelta.llm.scratch import Scratch

#: Documents by which scores and rejection are calibrated.
CALIBRATION_DOCUMENTS = 2_000
#: Share of a language's own calibration documents that the rejection limit lets through.
ACCEPTED = 0.995
UNKNOWN = "und"
_BLANK = 32
_CHAR_BITS = 21


@functools.cache
def _letters() -> np.ndarray:
    """The lower-case letter of every code point, a combining mark as it is; a blank for all else."""
    table = np.full(0x110000, _BLANK, np.int64)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            lower = char.lower()
            table[code] = ord(lower) if len(lower) == 1 else code
    table[_marks()] = np.flatnonzero(_marks())
    return table


@functools.cache
def _marks() -> np.ndarray:
    """Whether each code point is a mark that belongs to the letter before it, such as a vowel sign."""
    return np.array([unicodedata.category(chr(code)) in ("Mn", "Mc") for code in range(0x110000)])


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The reduced texts one after another, each between blanks, and where each ends; no letters: nothing.

    A mark stays in the word of the letter before it, and without one (as behind a symbol) counts as a blank.
    """
    raw = np.frombuffer("".join([f" {text} " for text in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes, marks = _letters()[raw], _marks()[raw]
    if marks.any():
        carrier = np.maximum.accumulate(np.where(marks, 0, np.arange(len(codes))))
        codes[marks & (codes[carrier] == _BLANK)] = _BLANK
    bounds = np.cumsum([0, *[len(text) + 2 for text in texts]])
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != _BLANK) | (codes[:-1] != _BLANK)
    starts = bounds[:-1]
    keep[starts] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    ends = kept[bounds[1:]]
    sizes = np.diff(np.concatenate([[0], ends]))
    bare = np.flatnonzero((sizes <= 1) & (sizes > 0))
    codes = codes[keep]
    if len(bare):
        codes = np.delete(codes, ends[bare] - 1)
        sizes[bare] = 0
    return codes, np.cumsum(sizes)


def _ngrams(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams that lie in one text, hashed without loss, and the text of each."""
    keys = (codes[:-2] << 2 * _CHAR_BITS) | (codes[1:-1] << _CHAR_BITS) | codes[2:]
    text_of = np.searchsorted(ends, np.arange(len(keys)), "right")
    inside = np.arange(len(keys)) + 2 < ends[text_of] if len(keys) else np.zeros(0, bool)
    return keys[inside], text_of[inside]


def count_ngrams(texts: DataFrame) -> DataFrame:
    """``lang, ngram, n`` over all rows of ``text, lang``; counted per task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, own in by_lang.items():
                for first, last in slices(own):
                    found = np.unique(_ngrams(*letters(own[first:last]))[0], return_counts=True)
                    held[lang] = _add(held[lang], found) if lang in held else found
        for lang, (keys, counts) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(counts, pa.int64())],
                names=["lang", "ngram", "n"],
            )

    partial = texts.select("text", "lang").mapInArrow(count, "lang string, ngram bigint, n bigint")
    return partial.groupBy("lang", "ngram").agg(F.sum("n").alias("n"))


def _add(one, two):
    keys, at = np.unique(np.concatenate([one[0], two[0]]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([one[1], two[1]])).astype(np.int64)


@dataclass
class Level:
    """The union of n-grams of all languages in ascending order, and one row of values each."""

    keys: np.ndarray
    values: np.ndarray
    missing: np.ndarray

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        return self.values[self.places(keys)]

    def places(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self.places(keys)
        return np.where((at >= 0)[:, None], self.values[at] if len(self.keys) else self.missing, self.missing)


def _discount(counts: np.ndarray) -> float:
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return once / (once + 2 * twice) if once and twice else 0.5


def _per_context(contexts: np.ndarray, counts: np.ndarray, discount: float):
    """Contexts in ascending order, the total of each, and the probability it hands down."""
    keys, at = np.unique(contexts, return_inverse=True)
    total = np.bincount(at, counts, len(keys))
    return keys, total[at], discount * np.bincount(at, minlength=len(keys)) / total


def _aligned(tables: list[tuple[np.ndarray, np.ndarray]], missing: float) -> Level:
    keys = np.unique(np.concatenate([own for own, _ in tables]))
    values = np.full((len(keys), len(tables)), missing)
    for lang, (own, value) in enumerate(tables):
        values[np.searchsorted(keys, own), lang] = value
    return Level(keys, values, np.full(len(tables), missing))


class Models:
    """The models of all languages from ``{lang: (trigrams, counts)}``."""

    def __init__(self, counted: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counted)
        low, pair = (1 << _CHAR_BITS) - 1, (1 << 2 * _CHAR_BITS) - 1
        letters_seen = np.unique(np.concatenate([keys & low for keys, _ in counted.values()]))
        even = 1 / (len(letters_seen) + 1)
        ones, twos, backs_two, backs_three, threes = [], [], [], [], []
        for lang in self.langs:
            keys, counts = counted[lang]
            pairs, before = np.unique(keys & pair, return_counts=True)
            chars, before_one = np.unique(pairs & low, return_counts=True)
            cut = _discount(before_one)
            total = before_one.sum()
            p_one = (np.maximum(before_one - cut, 0) + cut * len(chars) * even) / total
            ones.append((chars, np.log(p_one)))
            self_even = cut * len(chars) * even / total
            cut = _discount(before)
            heads, totals, back = _per_context(pairs >> _CHAR_BITS, before, cut)
            p_two = np.maximum(before - cut, 0) / totals + back[np.searchsorted(heads, pairs >> _CHAR_BITS)] * p_one[
                np.searchsorted(chars, pairs & low)]
            twos.append((pairs, np.log(p_two)))
            backs_two.append((heads, np.log(back)))
            cut = _discount(counts)
            heads, totals, back = _per_context(keys >> _CHAR_BITS, counts, cut)
            p_three = np.maximum(counts - cut, 0) / totals + back[np.searchsorted(heads, keys >> _CHAR_BITS)] * p_two[
                np.searchsorted(pairs, keys & pair)]
            threes.append((keys, np.log(p_three)))
            backs_three.append((heads, np.log(back)))
            ones[-1] = (*ones[-1], np.log(self_even))
        self.one = _aligned([own[:2] for own in ones], 0.0)
        unseen = np.array([own[2] for own in ones])
        self.one.values = np.where(self.one.values == 0.0, unseen, self.one.values)
        self.one.missing = unseen
        self.back_two, self.back_three = _aligned(backs_two, 0.0), _aligned(backs_three, 0.0)
        self.two = self._completed(_aligned(twos, np.nan), self._two)
        self.three = self._completed(_aligned(threes, np.nan), self._three)
        self.three.values = self.three.values.astype(np.float32)

    @staticmethod
    def _completed(level: Level, fall_back) -> Level:
        """Fill in the languages that never saw an n-gram of the union."""
        level.values = np.where(np.isnan(level.values), fall_back(level.keys), level.values)
        return level

    def _two(self, pairs: np.ndarray) -> np.ndarray:
        return self.back_two.get(pairs >> _CHAR_BITS) + self.one.get(pairs & (1 << _CHAR_BITS) - 1)

    def _three(self, keys: np.ndarray) -> np.ndarray:
        pairs = keys & (1 << 2 * _CHAR_BITS) - 1
        at = self.two.places(pairs)
        lower = np.where((at >= 0)[:, None], self.two.values[at], 0.0)
        gone = np.flatnonzero(at < 0)
        lower[gone] = self._two(pairs[gone])
        return self.back_three.get(keys >> _CHAR_BITS) + lower

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character of every text (rows) under every language, and the characters scored."""
        all_sums, all_sizes = [np.zeros((0, len(self.langs)))], [np.zeros(0, np.int64)]
        for first, last in slices(texts):
            codes, ends = letters(texts[first:last])
            keys, text_of = _ngrams(codes, ends)
            at = self.three.places(keys)
            logs = self.three.values[at] if len(keys) else np.zeros((0, len(self.langs)))
            gone = np.flatnonzero(at < 0)
            if len(gone):
                logs[gone] = self._three(keys[gone])
            sizes = np.bincount(text_of, minlength=last - first)
            sums = np.stack([
                np.bincount(text_of, logs[:, lang], last - first) for lang in range(len(self.langs))
            ], axis=1)
            all_sums.append(-sums / np.maximum(sizes, 1)[:, None])
            all_sizes.append(sizes)
        return np.concatenate(all_sums), np.concatenate(all_sizes)


@dataclass
class Calibration:
    """Posterior ``softmax(-sharpness * nats)``; texts above a language's limit of nats per character are rejected."""

    sharpness: float
    limits: np.ndarray

    def posterior(self, entropies: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        nats = -self.sharpness * entropies * np.sqrt(sizes)[:, None]
        nats -= nats.max(axis=1, keepdims=True)
        weights = np.exp(nats)
        return weights / weights.sum(axis=1, keepdims=True)


def calibrate(entropies: np.ndarray, sizes: np.ndarray, truth: np.ndarray, n_langs: int) -> Calibration:
    """The sharpness of the best likelihood, and the entropy that ``ACCEPTED`` of a language's texts stay below."""
    best, rows = None, np.arange(len(truth))
    for sharpness in (0.25, 0.5, 1.0, 2.0, 4.0, 8.0):
        right = Calibration(sharpness, np.zeros(0)).posterior(entropies, sizes)[rows, truth]
        loss = -np.log(np.maximum(right, 1e-12)).sum()
        if best is None or loss < best[0]:
            best = loss, sharpness
    limits = np.full(n_langs, np.inf)
    for lang in range(n_langs):
        own = entropies[truth == lang, lang]
        if len(own):
            limits[lang] = np.quantile(own, ACCEPTED) * 1.1
    return Calibration(best[1], limits)


def train(training: DataFrame, scratch: Scratch) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """All trigrams of each language of ``text, lang`` with their counts.

    The driver holds each different trigram of a language once. Their number follows the alphabets and spellings of
    the languages, not the rows.
    """
    found = scratch.table("ngrams", count_ngrams(training.where("lang is not null and text is not null"))).toArrow()
    scratch.drop("ngrams")
    langs, keys, counts = (found.column(name).to_numpy(zero_copy_only=False) for name in ("lang", "ngram", "n"))
    out = {}
    for lang in sorted(set(langs.tolist())):
        own = langs == lang
        order = np.argsort(keys[own])
        out[lang] = keys[own][order], counts[own][order]
    return out


_BUILT: dict = {}


def _models(shared) -> Models:
    """The models of a broadcast; a worker process keeps the last it built."""
    name, counted = shared.value
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Models(counted)
    return _BUILT[name]


def _calibration(training: DataFrame, shared, langs: list[str], documents: int) -> Calibration:
    """From at most ``documents`` distinct training rows, chosen by a hash of the row and scored where they are."""
    share = min(1.0, documents / max(1, training.count()))

    def score(texts, own, places):
        entropies, sizes = _models(shared).entropies(texts)
        return own, sizes.tolist(), list(entropies), places

    sample = hash_sample(training.where(F.col("lang").isin(langs)), share, "calibration", ["doc_id", "text", "lang"])
    scored = map_columns(
        sample.select("text", "lang", "place"), score, "lang string, size bigint, entropies array<double>, place bigint"
    )
    rows = [row for row in smallest(scored, documents).collect() if row.size]
    if not rows:
        return Calibration(1.0, np.full(len(langs), np.inf))
    truth = np.array([langs.index(row.lang) for row in rows])
    return calibrate(np.array([row.entropies for row in rows]), np.array([row.size for row in rows]), truth, len(langs))


def identify_languages(
    docs: DataFrame, held_out: Column, lang_col: str = "lang",
    calibration_documents: int = CALIBRATION_DOCUMENTS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, entropy, rejected`` of every row.

    Models learn from the texts and languages of all rows that are not ``held_out`` (NULL: not) and have both. ``score`` is
    the calibrated posterior of the prediction; ``rejected`` marks a text with more nats per character than its language's
    limit. A text that is NULL or has no letter is ``und`` with score 0, not rejected and without entropy, and so is
    every text where there is nothing to learn from. Ties go to the language first by name. Repeated rows are
    counted and scored each; an empty table gives an empty one; other columns are ignored.
    """
    rows = document_columns(
        docs, id_col, text_col, F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(lang_col).alias("lang")
    )
    training = rows.where(~F.col("held_out"))
    counted = train(training, Scratch(docs.sparkSession))
    langs = sorted(counted)
    schema = "doc_id bigint, held_out boolean, lang_pred string, score double, entropy double, rejected boolean"
    if not langs:
        return rows.select(
            "doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
            F.lit(None).cast("double").alias("entropy"), F.lit(False).alias("rejected"),
        )
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, counted))
    calibration = _calibration(training, shared, langs, calibration_documents)

    def predict(ids, texts, out):
        entropies, sizes = _models(shared).entropies(texts)
        best = entropies.argmin(axis=1)
        rows_of = np.arange(len(texts))
        scores = calibration.posterior(entropies, sizes)[rows_of, best]
        lowest = entropies[rows_of, best]
        rejected = (lowest > calibration.limits[best]) & (sizes > 0)
        known = (sizes > 0).tolist()
        return (
            ids, out, [langs[at] if has else UNKNOWN for at, has in zip(best.tolist(), known, strict=True)],
            np.where(sizes > 0, scores, 0.0), [x if has else None for x, has in zip(lowest.tolist(), known, strict=True)],
            rejected.tolist(),
        )

    return map_columns(rows.select("doc_id", "text", "held_out"), predict, schema)
