"""Document quality from weak labels: heuristic labellers, their accuracies by EM, a hashed linear scorer.

Each labeller calls a text junk (1), sound (0) or abstains. How often each is right on sound
and on junk texts, and how common junk is, is estimated from their agreement alone, over the
counts of all vote patterns in the corpus, by expectation-maximisation. The
posterior of its pattern is a text's label. A logistic scorer on hashed counts of
byte-class sequences and word repetitions learns those labels from a bounded sample
and then scores every text.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querydelta.llm.batches import document_columns, hash_sample, keep_rows, map_columns, slices, smallest
from querydelta.llm.shingles import PLAIN, mix

#: Texts that the scorer learns from.
TRAINING_DOCUMENTS = 2_000
FEATURES = 1024
#: Least probability of being sound that keeps a text.
KEEP_FROM = 0.5
#: ``name: share from which a labeller calls a text junk``; below it abstains, as a text may be junk in another way.
JUNK_FROM = {
    "symbols": 0.1, "capitals": 0.4, "repeated_words": 0.1, "bare_symbol_words": 0.1, "marked_words": 0.1,
    "old_words": 0.6,
}
#: The labeller ``plain`` calls a text sound whose shares are all below these.
PLAIN_BELOW = (0.04, 0.1, 0.04, 0.02, 0.04, 0.45)
#: The labeller ``sentences`` calls a text sound by its share of words before a full stop or comma, or junk without enough.
SENTENCES, NO_SENTENCES, SOME_WORDS, MANY_WORDS = (0.04, 0.4), 0.01, 8, 30
ABSTAIN = -1
LABELLERS = (*JUNK_FROM, "plain", "sentences")
_LOWER, _UPPER, _DIGIT, _SPACE = 1, 2, 3, 4


def _byte_classes() -> np.ndarray:
    """One class for small letters (and all bytes of other scripts), capitals, digits and white space, else the byte."""
    classes = np.arange(256, dtype=np.uint8)
    classes[:33] = _SPACE
    classes[ord("a") : ord("z") + 1] = _LOWER
    classes[128:] = _LOWER
    classes[ord("A") : ord("Z") + 1] = _UPPER
    classes[ord("0") : ord("9") + 1] = _DIGIT
    return classes


_CLASSES = _byte_classes()


def describe(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(shares, features, words)``: a row per text of what labellers look at and of hashed features, and its words."""
    out = [
        (np.zeros((0, 8)), np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64)),
        *[_describe(texts[first:last]) for first, last in slices(texts)],
    ]
    return tuple(np.concatenate(parts) for parts in zip(*out, strict=True))


def _describe(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(texts)
    parts = [text.encode() for text in texts]
    raw = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    bounds = np.cumsum([0, *[len(part) + 1 for part in parts]])
    classes = _CLASSES[raw]

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds])

    upper, space = per_text(classes == _UPPER), per_text(classes == _SPACE)
    small = per_text(classes == _LOWER)
    symbol = per_text((classes > _SPACE) & (classes != ord(".")) & (classes != ord(",")))
    new = np.ones(len(classes), bool)
    new[1:] = classes[1:] != classes[:-1]
    places = np.flatnonzero(new)
    runs = classes[places].astype(np.uint64)
    text_of = np.searchsorted(bounds, places, "right") - 1

    # A word of symbols alone: a run of symbols between spaces. A marked word: letters, then symbols other than . and ,
    before, after = np.roll(runs, 1), np.roll(runs, -1)
    is_symbol = runs > _SPACE
    bare = is_symbol & (before == _SPACE) & (after == _SPACE)
    marked = is_symbol & (after == _SPACE) & (before < _SPACE) & (runs != ord(".")) & (runs != ord(","))

    def runs_per_text(flags: np.ndarray) -> np.ndarray:
        return np.bincount(text_of[flags], minlength=n)

    hashes, words = PLAIN(texts)
    word_text = np.repeat(np.arange(n), words)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (word_text[1:] == word_text[:-1])
    repeated = np.bincount(word_text[same], minlength=n)
    order = np.lexsort((hashes, word_text))
    again = np.zeros(len(hashes), bool)
    ordered, ordered_text = hashes[order], word_text[order]
    again[1:] = (ordered[1:] == ordered[:-1]) & (ordered_text[1:] == ordered_text[:-1])
    not_new = np.bincount(ordered_text[again], minlength=n)

    def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.where(whole > 0, part / np.maximum(whole, 1), np.nan)

    long = np.where(words >= 20, words, 0)
    stops = runs_per_text((after == _SPACE) & (before < _SPACE) & ((runs == ord(".")) | (runs == ord(","))))
    shares = np.stack([
        share(symbol, np.diff(bounds) - space), share(upper, np.where(words >= SOME_WORDS, upper + small, 0)), share(repeated, words),
        share(runs_per_text(bare), words), share(runs_per_text(marked), words), share(not_new, long),
        share(stops, words), words,
    ], axis=1)

    triples = mix(runs[:-2] * np.uint64(1 << 16) + runs[1:-1] * np.uint64(1 << 8) + runs[2:]) % np.uint64(FEATURES - 8)
    counts = np.bincount(
        text_of[:-2] * FEATURES + triples.astype(np.int64), minlength=n * FEATURES
    ).reshape(n, FEATURES).astype(np.float32)
    counts[:, : FEATURES - 8] /= np.maximum(1, counts.sum(axis=1, keepdims=True))
    counts[:, : FEATURES - 8] = np.sqrt(counts[:, : FEATURES - 8])
    counts[:, FEATURES - 8 : FEATURES - 2] = np.nan_to_num(shares[:, :6])
    return shares, counts, words


def votes(shares: np.ndarray) -> np.ndarray:
    """1 (junk), 0 (sound) or -1 (abstain) per text and labeller."""
    kinds, stops, words = np.nan_to_num(shares[:, :6]), np.nan_to_num(shares[:, 6]), shares[:, 7]
    by_kind = np.where(kinds >= np.array(list(JUNK_FROM.values())), 1, ABSTAIN)
    plain = np.where((kinds < np.array(PLAIN_BELOW)).all(axis=1), 0, ABSTAIN)
    without = (stops < NO_SENTENCES) & (words >= MANY_WORDS)
    fluent = (stops >= SENTENCES[0]) & (stops <= SENTENCES[1]) & (words >= SOME_WORDS)
    sentences = np.where(fluent, 0, np.where(without, 1, ABSTAIN))
    return np.concatenate([by_kind, plain[:, None], sentences[:, None]], axis=1)


def pattern_of(rows: np.ndarray) -> np.ndarray:
    """One number per row of votes, in base 3."""
    return ((rows + 1) * 3 ** np.arange(len(LABELLERS))).sum(axis=1)


@dataclass
class LabelModel:
    """``chances[class, labeller, vote + 1]``: how often a labeller votes so on sound (0) and junk (1) texts."""

    junk_share: float
    chances: np.ndarray

    def posterior(self, rows: np.ndarray) -> np.ndarray:
        """The probability that a text with these votes is junk."""
        logs = np.log(self.chances)[:, np.arange(len(LABELLERS)), rows + 1].sum(axis=2)
        return 1 / (1 + np.exp(logs[0] - logs[1] + np.log(1 - self.junk_share) - np.log(self.junk_share)))


#: Votes (abstain, sound, junk) of a labeller on sound and on junk texts, before anything is seen.
_AT_FIRST = np.array([[0.5, 0.45, 0.05], [0.5, 0.1, 0.4]])


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """EM over the distinct vote patterns and their counts.

    Each labeller starts from the same votes, which make a junk vote speak for junk, and keeps ten made-up texts of
    either kind with them, so an unused one says little and the classes cannot swap.
    """
    rows = np.array(list(itertools.product((-1, 0, 1), repeat=len(LABELLERS))))
    rows = rows[np.argsort(pattern_of(rows))][patterns] if len(patterns) else rows[:0]
    first = np.repeat(_AT_FIRST[:, None, :], len(LABELLERS), axis=1)
    model, total = LabelModel(0.2, first), counts.sum()
    for _ in range(rounds):
        junk = model.posterior(rows) * counts
        weights = np.stack([counts - junk, junk])
        votes_cast = np.stack([weights @ (rows == vote) for vote in (-1, 0, 1)], axis=2) + 10 * first
        model = LabelModel(
            float((junk.sum() + 2) / (total + 10)), votes_cast / votes_cast.sum(axis=2, keepdims=True)
        )
    return model


def count_patterns(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The vote patterns of all texts with words, of which there can be ``3 ** labellers``, and their counts."""

    def number(rows):
        shares, _, words = describe(rows)
        found, counts = np.unique(pattern_of(votes(shares))[words > 0], return_counts=True)
        return found, counts

    rows = map_columns(texts.select("text"), number, "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    rows.sort()
    return np.array([row.pattern for row in rows], np.int64), np.array([row.n for row in rows], np.float64)


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def __call__(self, features: np.ndarray) -> np.ndarray:
        """The probability of a sound text."""
        return 1 / (1 + np.exp(-(features @ self.weights + self.bias)))


def fit_scorer(features: np.ndarray, sound: np.ndarray, weight: float = 1e-3, rounds: int = 400) -> Scorer:
    """Logistic regression on posterior labels by accelerated gradient descent; both classes weigh the same."""
    if not len(sound):
        return Scorer(np.zeros(FEATURES), 0.0)
    share = float(np.clip(sound.mean(), 1e-3, 1 - 1e-3))
    importance = np.where(sound >= 0.5, 0.5 / share, 0.5 / (1 - share))
    x = np.concatenate([features, np.ones((len(features), 1), np.float32)], axis=1).astype(np.float64)
    w = ahead = np.zeros(x.shape[1])
    for turn in range(rounds):
        gradient = x.T @ (importance * (1 / (1 + np.exp(-(x @ ahead))) - sound)) / len(sound) + weight * ahead
        following = ahead - 2.0 * gradient
        ahead = following + turn / (turn + 3) * (following - w)
        w = following
    return Scorer(w[:-1], float(w[-1]))


@dataclass
class QualityModel:
    labels: LabelModel
    scorer: Scorer

    def judge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The probability of a sound text by the scorer, and by the votes alone; 0 without words."""
        shares, features, words = describe(texts)
        by_votes = 1 - self.labels.posterior(votes(shares))
        return np.where(words > 0, self.scorer(features), 0.0), np.where(words > 0, by_votes, 0.0)


def train(docs: DataFrame, training_documents: int = TRAINING_DOCUMENTS, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Vote patterns are counted over all rows; at most ``training_documents`` distinct ones, by a hash of the row, train the scorer."""
    rows = document_columns(docs, id_col, text_col)
    patterns, counts = count_patterns(rows)
    labels = fit_labels(patterns, counts)
    share = min(1.0, training_documents / max(1.0, counts.sum()))
    def features_of(texts, places):
        shares, features, words = describe(texts)
        kept = np.flatnonzero(words > 0)
        return [features[at].tobytes() for at in kept], (1 - labels.posterior(votes(shares)))[kept], [places[at] for at in kept]

    chosen = hash_sample(rows, share, "quality", ["doc_id", "text"])
    described = map_columns(chosen.select("text", "place"), features_of, "features binary, sound double, place bigint")
    sample = smallest(described, training_documents).collect()
    features = np.array([np.frombuffer(row.features, np.float32) for row in sample]).reshape(-1, FEATURES)
    return QualityModel(labels, fit_scorer(features, np.array([row.sound for row in sample])))


def score_documents(
    docs: DataFrame, training_documents: int = TRAINING_DOCUMENTS, keep_from: float = KEEP_FROM,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, quality, label_posterior, kept`` of every row.

    ``quality`` is the scorer's probability of a sound text, ``label_posterior`` that of the votes alone. A text without
    words, empty or NULL has 0 for both and is not kept. Equal texts have equal results; a NULL id stays; an empty table gives an
    empty one; other columns are ignored.
    """
    model = train(docs, training_documents, id_col, text_col)

    def score(ids, texts):
        quality, by_votes = model.judge(texts)
        return ids, quality, by_votes, quality >= keep_from

    return map_columns(
        document_columns(docs, id_col, text_col), score, "doc_id bigint, quality double, label_posterior double, kept boolean"
    )


def drop_junk(
    docs: DataFrame, training_documents: int = TRAINING_DOCUMENTS, keep_from: float = KEEP_FROM,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that the scorer keeps, with all columns as they are; no row is moved.

    A NULL or empty text is not kept; repeated rows stay or go together; an empty table gives an empty one.
    """
    model = train(docs, training_documents, id_col, text_col)
    return keep_rows(docs, text_col, lambda texts: model.judge(texts)[0] >= keep_from)
