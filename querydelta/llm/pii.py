"""Personal data: fixed patterns, and a character tagger that finds what they leave.

The patterns of the four kinds give base spans. A bidirectional LSTM over characters
with a CRF on top, trained in numpy on the base spans of a bounded sample and on the same spans rewritten in
forms that the patterns miss (phones without ``+``, other separators, letters beyond ASCII), scores windows of 64
characters that overlap by half. Where windows overlap their scores are averaged, and each stretch of
windows is decoded at once, so a span may reach over any number of them. Spans are widened to the ends of their word
or number. Those that pass the check of their
kind and touch no base span compete, and the set without overlaps and with the highest total margin is added.

A span of any kind holds a digit or ``@``, and one that is added holds one outside all base
spans; so windows without such a character are not scored, but for those over the rest of a word with ``@``.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querydelta.llm.batches import document_columns, map_columns, replace_texts

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

#: Characters of a window, and the step between two.
WINDOW, STRIDE = 64, 32
#: Documents that the tagger learns from, and windows in all: one half with spans, one half without.
TRAINING_DOCUMENTS, TRAINING_WINDOWS = 8_000, 2_400
#: Forms in which each span is shown besides its own.
FORMS = 6
_EMBED, _HIDDEN, _UPDATES, _BATCH = 12, 16, 400, 64
_SYMBOLS = 130
TAGS = ("O", *[f"{place}-{kind}" for kind in KINDS for place in "BI"])

#: Fixed patterns. Possessive repeats and the look-behind change no match, but keep long runs linear.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Numbers as tagged: parts of an address in brackets, and groups of a card with one or two separators.
_TAGGED_IP = re.compile(r"[0-9]+(?:[\[(]?\.[\])]?[0-9]+){3}")
_TAGGED_CARD = re.compile(r"[0-9](?:[\x20._/-]{0,2}[0-9])+")
_TAGGED_PHONE = re.compile(r"[+(]?[0-9](?:[\x20().+/-]{0,2}[0-9])+")
_LOWER, _ACCENTED = "abcdefghijklmnopqrstuvwxyz", "äöüéèñçø"


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _luhn(digits: str) -> bool:
    total = 0
    for at, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + at % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _is_ip(text: str) -> bool:
    return all(len(part.lstrip("0")) < 4 and int(part.lstrip("0") or "0") <= 255 for part in text.split("."))


def _is_card(text: str) -> bool:
    digits = _digits(text)
    return 14 <= len(digits) <= 19 and _luhn(digits)


def _is_phone(text: str) -> bool:
    return 10 <= len(_digits(text)) <= 15


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by start and then kind; leftmost and without overlaps per kind."""
    found: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            found.append((start, free, "email"))
        at = text.find("@", max(at + 1, free))
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if _is_ip(m.group())]
        found += [(m.start(), m.end(), "card") for m in _CARD.finditer(text) if _is_card(m.group())]
        if "+" in text:
            found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if _is_phone(m.group())]
    return sorted(found, key=lambda span: (span[0], KINDS.index(span[2]), span[1]))


def _plausible(text: str, kind: str) -> bool:
    """What a tagged span has to fulfil to count."""
    if kind == "email":
        local, at, domain = text.partition("@")
        return bool(local and at and "." in domain.strip(".") and "@" not in domain and not any(c.isspace() for c in text))
    if kind == "ip":
        return bool(_TAGGED_IP.fullmatch(text)) and _is_ip(re.sub(r"[\[\]()]", "", text))
    if kind == "card":
        return bool(_TAGGED_CARD.fullmatch(text)) and _is_card(text)
    return bool(_TAGGED_PHONE.fullmatch(text)) and _is_phone(text) and not text.isdigit()


def widened(text: str, span: Span) -> Span:
    """The span up to the ends of its address or number, without blanks or stops at its ends."""
    start, end, kind = span
    inner = "._%+-@" if kind == "email" else ""

    def belongs(char: str) -> bool:
        return char.isalnum() or char in inner if kind == "email" else "0" <= char <= "9"

    while start > 0 and belongs(text[start - 1]):
        start -= 1
    while end < len(text) and belongs(text[end]):
        end += 1
    loose = "._%+-" if kind == "email" else " .-/_)[]"
    while start < end and (text[start] in loose or text[start].isspace()):
        start += 1
    while start < end and not text[end - 1].isalnum():
        end -= 1
    if kind == "phone" and start and (text[start - 1] == "+" or text[start - 1] == "(" and ")" in text[start:end].partition("(")[0]):
        start -= 1
    return start, end, kind


def _whole(text: str, span: Span) -> bool:
    """No number is a part of a longer one, with a separator between."""
    start, end, kind = span
    before = start > 1 and text[start - 1] in "-./_" and text[start - 2].isdigit()
    after = end + 1 < len(text) and text[end] in "-./_" and text[end + 1].isdigit()
    return kind == "email" or not (before or after)


def variant(piece: str, kind: str, turn: int) -> str:
    """A base span with other letters and digits, in a form that the patterns miss; ``turn`` chooses them and the form."""
    rng = np.random.default_rng(turn)
    pool = {True: _LOWER + _ACCENTED * 2, False: _LOWER}

    def other(text: str, accents: bool) -> str:
        letters, numbers = rng.choice(list(pool[accents]), len(text)), rng.integers(0, 10, len(text))
        return "".join([str(n) if c in "0123456789" else new if c.isalpha() else c for c, new, n in zip(text, letters, numbers, strict=True)])

    form, digits = int(rng.integers(0, 1 << 16)), other(_digits(piece), False)
    if kind == "email":
        local, _, domain = piece.partition("@")
        label, dot, rest = domain.partition(".")
        middle = len(label) // 2
        label = other(label[:middle], False) + _ACCENTED[form % len(_ACCENTED)] + other(label[middle:], form % 2 > 0)
        return f"{other(local, form % 3 > 0)}@{label}{dot}{rest}"
    if kind == "ip":
        return (".", "[.]", "(.)")[1 + form % 2].join([digits[at : at + 1 + (form >> at) % 2] for at in (0, 2, 4, 6)])
    if kind == "card":
        return (".", "/", "_", "  ")[form % 4].join([digits[at : at + 4] for at in range(0, len(digits), 4)])
    a, b, c = digits[:3], digits[3:6], digits[6:10]
    return (
        f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"0{a} {b}{c[:1]} {c}", f"00{a[:2]} {a[2:]}{b[:1]} {b}{c}",
        f"({a}) {b} {c}", f"0{a[:2]} {a[2:]}{b} {c}", f"0{a}/{b}{c}",
    )[form % 9]


def harmless(turn: int) -> str:
    """A number that is nobody's: a count in groups, a date, a range of years, a book number, a version; ``turn`` chooses."""
    rng = np.random.default_rng(turn)
    d = "".join(map(str, rng.integers(0, 10, 16)))
    mark = " .,"[int(rng.integers(3))]
    return (
        f"{d[0]}{mark}{d[1:4]}{mark}{d[4:7]}{mark}{d[7:10]}", f"{d[:2]}{mark}{d[2:5]}{mark}{d[5:8]}{mark}{d[8:11]}", f"20{d[:2]}-0{d[2]}-1{d[3]} {d[4:6]}:{d[6:8]}:{d[8:10]}",
        f"19{d[:2]}-20{d[2:4]}", f"978-{d[0]}-{d[1:3]}-{d[3:9]}-{d[9]}", f"{d[0]}.{d[1:3]}.{d[3]}", f"{d[:2]}.{d[2:4]}.20{d[4:6]}, {d[6:8]}:{d[8:10]}",
    )[int(rng.integers(7))]


def rewritten(text: str, spans: list[Span], turn: int = 0) -> tuple[str, list[Span], list[Span]]:
    """The text with its spans in forms that the patterns miss, every fourth as a harmless number, and where both are now.

    A span that starts in another stays out.
    """
    out, moved, plain, at, size = [], [], [], 0, 0
    for start, end, kind in spans:
        if start < at:
            continue
        seed = zlib.crc32(text[start:end].encode("utf-8", "surrogatepass")) + turn
        is_plain = seed % 4 == 0
        piece = harmless(seed) if is_plain else variant(text[start:end], kind, seed)
        out += [text[at:start], piece]
        size += start - at
        (plain if is_plain else moved).append((size, size + len(piece), kind))
        size, at = size + len(piece), end
    return "".join([*out, text[at:]]), moved, plain


def symbols(text: str) -> np.ndarray:
    """One of 130 symbols per code point: ASCII as it is (1 to 127), other letters 128, all else 129; 0 fills up."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where(codes < 128, np.maximum(codes, 1), 129).astype(np.uint8)
    for at in np.flatnonzero(codes >= 128):
        if text[at].isalpha():
            out[at] = 128
    return out


def window_starts(marks: np.ndarray, covered: list[Span]) -> list[int]:
    """Starts of the windows that hold a digit or ``@`` (symbol codes) outside ``covered`` spans."""
    places = np.flatnonzero(((marks >= 48) & (marks <= 57)) | (marks == 64))
    if len(places) and covered:
        inside = np.zeros(len(marks) + 1, np.int64)
        for start, end, _ in covered:
            inside[start] += 1
            inside[end] -= 1
        places = places[np.cumsum(inside)[places] == 0]
    steps = np.unique(np.concatenate([places // STRIDE, places // STRIDE - 1]))
    return (steps[steps >= 0] * STRIDE).tolist()


def stretches(marks: np.ndarray, covered: list[Span]) -> list[tuple[int, int]]:
    """First start and number of windows of each run of windows that overlap.

    Besides ``window_starts`` these cover whole words that hold an ``@`` outside ``covered``: an address can go on
    for longer than a window without another digit or ``@``, which no other kind can.
    """
    steps = np.array(window_starts(marks, covered), np.int64) // STRIDE
    if not len(steps):
        return []
    at = np.flatnonzero(marks == 64)
    if len(at):
        blank = np.flatnonzero(((marks >= 9) & (marks <= 13)) | ((marks >= 28) & (marks <= 32)))
        edges = np.concatenate([[-1], blank, [len(marks)]])
        chosen = np.zeros((len(marks) - 1) // STRIDE + 2, np.int64)
        inside = np.zeros(len(marks) + 1, np.int64)
        for start, end, _ in covered:
            inside[start] += 1
            inside[end] -= 1
        word = np.unique(np.searchsorted(blank, at[np.cumsum(inside)[at] == 0]))
        for left, right in zip(edges[word] + 1, edges[word + 1], strict=True):
            chosen[max(0, left // STRIDE - 1)] += 1
            chosen[(right - 1) // STRIDE + 1] -= 1
        steps = np.union1d(steps, np.flatnonzero(np.cumsum(chosen) > 0))
    cuts = np.flatnonzero(np.diff(steps) > 1) + 1
    return [(int(run[0]) * STRIDE, len(run)) for run in np.split(steps, cuts)]


def _window(marks: np.ndarray, start: int) -> np.ndarray:
    out = np.zeros(WINDOW, np.uint8)
    part = marks[start : start + WINDOW]
    out[: len(part)] = part
    return out


def tag_row(spans: list[Span], start: int) -> np.ndarray:
    """The tags of one window; a span that the window cuts is tagged as far as it is seen."""
    out = np.zeros(WINDOW, np.uint8)
    for first, end, kind in spans:
        low, high = max(first, start) - start, min(end, start + WINDOW) - start
        if low < high:
            inside = 2 + 2 * KINDS.index(kind)
            out[low:high] = inside
            if first >= start:
                out[low] = inside - 1
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Tagger:
    """``p`` holds the embedding, both directions' input and recurrent weights and biases, the output layer and the CRF."""

    p: dict[str, np.ndarray]

    @staticmethod
    def new(seed: int = 7) -> Tagger:
        rng, n = np.random.default_rng(seed), len(TAGS)
        p = {"embed": rng.normal(0, 0.3, (_SYMBOLS, _EMBED))}
        for way in ("ahead", "back"):
            p[f"{way}_in"] = rng.normal(0, 0.3, (_EMBED, 4 * _HIDDEN))
            p[f"{way}_rec"] = rng.normal(0, 0.2, (_HIDDEN, 4 * _HIDDEN))
            p[f"{way}_bias"] = np.repeat([0.0, 1.0, 0.0, 0.0], _HIDDEN)
        p |= {"out": rng.normal(0, 0.2, (2 * _HIDDEN, n)), "out_bias": np.zeros(n), "move": np.zeros((n, n)), "first": np.zeros(n)}
        return Tagger(p)

    def _run(self, ids: np.ndarray, way: str, keep: bool):
        """Hidden states ``[time, row, hidden]`` of one direction, and what the way back needs."""
        table = self.p["embed"] @ self.p[f"{way}_in"] + self.p[f"{way}_bias"]
        inputs, rec = table[ids.T], self.p[f"{way}_rec"]
        steps, rows = inputs.shape[:2]
        hidden, cell, out, kept = np.zeros((rows, _HIDDEN)), np.zeros((rows, _HIDDEN)), np.empty((steps, rows, _HIDDEN)), []
        for t in range(steps) if way == "ahead" else reversed(range(steps)):
            z = inputs[t] + hidden @ rec
            gates, new = _sigmoid(z[:, : 3 * _HIDDEN]), np.tanh(z[:, 3 * _HIDDEN :])
            i, f, o = gates[:, :_HIDDEN], gates[:, _HIDDEN : 2 * _HIDDEN], gates[:, 2 * _HIDDEN :]
            before, cell_before = hidden, cell
            cell = f * cell + i * new
            squashed = np.tanh(cell)
            hidden = o * squashed
            out[t] = hidden
            if keep:
                kept.append((t, before, cell_before, i, f, o, new, squashed))
        return out, kept

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """``[time, row, tag]``."""
        both = np.concatenate([self._run(ids, "ahead", False)[0], self._run(ids, "back", False)[0]], axis=2)
        return both @ self.p["out"] + self.p["out_bias"]

    def scores(self, rows: np.ndarray, runs: list[tuple[int, int]], per_call: int) -> np.ndarray:
        """Emissions per place of runs of overlapping windows, run after run; ``runs`` has windows and places of each."""
        n = len(TAGS)
        out, base, first = np.zeros((sum(places for _, places in runs), n)), [], 0
        for windows, places in runs:
            base += [(first, at * STRIDE, places) for at in range(windows)]
            first += places
        times = np.zeros((len(out), 1))
        for low in range(0, len(rows), per_call):
            part = self.emissions(rows[low : low + per_call])
            for at, (first, start, places) in enumerate(base[low : low + per_call]):
                seen = max(0, min(WINDOW, places - start))
                out[first + start : first + start + seen] += part[:seen, at]
                times[first + start : first + start + seen] += 1
        return out / np.maximum(times, 1)

    def decode(self, scores: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The best tags of runs of places, run after run, and per place how far the tag's score is above that of ``O``."""
        sizes = np.array(lengths, np.int64)
        order = np.argsort(-sizes, kind="stable")
        begin, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
        active = [int(np.searchsorted(-sizes, -t, "left")) for t in range(int(sizes[0]))]
        best, back = scores[begin] + self.p["first"], np.empty(scores.shape, np.int8)
        for t in range(1, len(active)):
            n = active[t]
            through = best[:n, :, None] + self.p["move"]
            back[begin[:n] + t] = through.argmax(axis=1)
            best[:n] = through.max(axis=1) + scores[begin[:n] + t]
        tags = np.empty(len(scores), np.int64)
        tags[begin + sizes - 1] = best.argmax(axis=1)
        for t in range(len(active) - 1, 0, -1):
            places = begin[: active[t]] + t
            tags[places - 1] = back[places, tags[places]]
        return tags, scores[np.arange(len(scores)), tags] - scores[:, 0]

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean negative log-likelihood of the tag rows, and its gradients."""
        p, rows = self.p, len(ids)
        ahead, kept_ahead = self._run(ids, "ahead", True)
        back, kept_back = self._run(ids, "back", True)
        both = np.concatenate([ahead, back], axis=2)
        scores = both @ p["out"] + p["out_bias"]
        steps, n, every = scores.shape[0], scores.shape[2], np.arange(rows)
        alpha, beta = np.empty_like(scores), np.zeros_like(scores)
        alpha[0] = scores[0] + p["first"]
        for t in range(1, steps):
            alpha[t] = _log_sum(alpha[t - 1][:, :, None] + p["move"], 1) + scores[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = _log_sum(p["move"] + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
        total = _log_sum(alpha[-1], 1)
        gold = tags.T
        path = p["first"][gold[0]] + scores[0][every, gold[0]]
        d_scores, d_move = np.exp(alpha + beta - total[None, :, None]), np.zeros((n, n))
        for t in range(steps):
            d_scores[t][every, gold[t]] -= 1
            if t:
                path = path + p["move"][gold[t - 1], gold[t]] + scores[t][every, gold[t]]
                pair = alpha[t - 1][:, :, None] + p["move"] + (scores[t] + beta[t])[:, None, :] - total[:, None, None]
                d_move += np.exp(pair).sum(axis=0)
                np.add.at(d_move, (gold[t - 1], gold[t]), -1)
        d = {"move": d_move, "first": d_scores[0].sum(axis=0), "out_bias": d_scores.sum(axis=(0, 1))}
        d["out"] = np.einsum("trh,trk->hk", both, d_scores)
        d_both, d["embed"] = d_scores @ p["out"].T, np.zeros_like(p["embed"])
        for way, kept, own in (("ahead", kept_ahead, d_both[:, :, :_HIDDEN]), ("back", kept_back, d_both[:, :, _HIDDEN:])):
            self._backward(ids, way, kept, own, d)
        return float((total - path).mean()), {name: value / rows for name, value in d.items()}

    def _backward(self, ids, way, kept, d_out, d) -> None:
        p, rows = self.p, len(ids)
        d_hidden, d_cell = np.zeros((rows, _HIDDEN)), np.zeros((rows, _HIDDEN))
        d_in, d_rec, d_bias = (np.zeros_like(p[f"{way}_{part}"]) for part in ("in", "rec", "bias"))
        for t, before, cell_before, i, f, o, new, squashed in reversed(kept):
            d_h = d_out[t] + d_hidden
            d_c = d_cell + d_h * o * (1 - squashed**2)
            d_z = np.concatenate([
                d_c * new * i * (1 - i), d_c * cell_before * f * (1 - f), d_h * squashed * o * (1 - o), d_c * i * (1 - new**2),
            ], axis=1)
            d_cell, d_hidden = d_c * f, d_z @ p[f"{way}_rec"].T
            d_rec += before.T @ d_z
            d_bias += d_z.sum(axis=0)
            d_in += p["embed"][ids[:, t]].T @ d_z
            np.add.at(d["embed"], ids[:, t], d_z @ p[f"{way}_in"].T)
        d[f"{way}_in"], d[f"{way}_rec"], d[f"{way}_bias"] = d_in, d_rec, d_bias

    def spans(self, texts: list[str], fixed: list[list[Span]], per_call: int = 512) -> list[list[Span]]:
        """What the tagger adds to the ``fixed`` spans of every text."""
        found: list[dict[Span, float]] = [{} for _ in texts]
        waiting, rows = [], []

        def tag() -> None:
            scores = self.scores(np.array(rows), [(windows, places) for _, _, windows, places in waiting], per_call)
            tags, margin = self.decode(scores, [places for *_, places in waiting])
            first = 0
            for at, start, _, places in waiting:
                here, gains = tags[first : first + places], margin[first : first + places]
                first += places
                for low, high, kind in _runs(here.tolist()) if here.any() else ():
                    span, gain = widened(texts[at], (start + low, start + high, kind)), float(gains[low:high].sum())
                    if gain > 0 and _whole(texts[at], span) and _plausible(texts[at][span[0] : span[1]], kind):
                        found[at][span] = gain
            waiting.clear()
            rows.clear()

        for at, (text, covered) in enumerate(zip(texts, fixed, strict=True)):
            if "@" in text or _DIGIT.search(text):
                marks = symbols(text)
                for start, windows in stretches(marks, covered):
                    places = min(len(text) - start, (windows - 1) * STRIDE + WINDOW)
                    waiting.append((at, start, windows, places))
                    rows += [_window(marks, start + k * STRIDE) for k in range(windows)]
                    if len(rows) >= per_call:
                        tag()
        if rows:
            tag()
        return [reconcile(own, covered) for own, covered in zip(found, fixed, strict=True)]


def _runs(tags: list[int]) -> list[Span]:
    """``(first, end, kind)`` of the spans in one row of tags."""
    out, first, kind = [], 0, None
    for at, tag in enumerate([*tags, 0]):
        here = KINDS[(tag - 1) // 2] if tag else None
        if kind is not None and (here != kind or tag % 2):
            out.append((first, at, kind))
            kind = None
        if here is not None and kind is None:
            first, kind = at, here
    return out


def reconcile(candidates: dict[Span, float], fixed: list[Span]) -> list[Span]:
    """The candidates without overlaps, with each other or with ``fixed`` spans, of the highest total gain."""
    free = sorted(
        (span for span in candidates if not any(span[0] < end and start < span[1] for start, end, _ in fixed)),
        key=lambda span: (span[1], span[0], span[2]),
    )
    ends, best = [span[1] for span in free], [0.0]
    for at, span in enumerate(free):
        before = bisect_right(ends, span[0], 0, at)
        best.append(max(best[at], best[before] + candidates[span]))
    out, at = [], len(free)
    while at:
        span = free[at - 1]
        before = bisect_right(ends, span[0], 0, at - 1)
        if best[at] > best[at - 1]:
            out.append(span)
            at = before
        else:
            at -= 1
    return out


def fit(ids: np.ndarray, tags: np.ndarray, updates: int = _UPDATES, rate: float = 0.02, seed: int = 7) -> Tagger:
    """Adam, ``updates`` mini-batches of windows however many there are; no windows leave the tagger as it starts, tagging nothing well enough to count."""
    tagger, rng = Tagger.new(seed), np.random.default_rng(seed)
    mean, square = ({name: np.zeros_like(value) for name, value in tagger.p.items()} for _ in range(2))
    turn = 0
    while turn < updates and len(ids):
        order = rng.permutation(len(ids))
        for first in range(0, len(ids), _BATCH)[: updates - turn]:
            rows = order[first : first + _BATCH]
            _, slopes = tagger.gradients(ids[rows], tags[rows])
            size = np.sqrt(sum((slope**2).sum() for slope in slopes.values()))
            turn += 1
            for name, slope in slopes.items():
                slope = slope * min(1.0, 5.0 / (size + 1e-12))
                mean[name] = 0.9 * mean[name] + 0.1 * slope
                square[name] = 0.999 * square[name] + 0.001 * slope**2
                step = mean[name] / (1 - 0.9**turn) / (np.sqrt(square[name] / (1 - 0.999**turn)) + 1e-8)
                tagger.p[name] = tagger.p[name] - rate * step
    return tagger


def labelled_windows(texts: list[str]) -> tuple[list[bytes], list[bytes], list[bool]]:
    """All windows of each text over digits and ``@``, those over its rewritten spans, their tags, and whether there are any."""
    rows, tags = [], []
    for text in texts:
        spans = base_spans(text)
        forms = [rewritten(text, spans, turn) for turn in range(FORMS)] if spans else []
        for own, places, plain in ((text, spans, None), *forms):
            marks = symbols(own)
            for start in window_starts(marks, []):
                tag = tag_row(places, start)
                if plain is None or tag.any() or tag_row(plain, start).any():
                    rows.append(_window(marks, start).tobytes())
                    tags.append(tag.tobytes())
    return rows, tags, [any(tag) for tag in tags]


def train(docs: DataFrame, training_documents: int = TRAINING_DOCUMENTS, id_col: str = "doc_id", text_col: str = "text") -> Tagger:
    """Learn from windows over the whole texts of about ``training_documents`` rows that hold a digit or ``@``.

    Rows are chosen by a hash of id and text, of their distinct windows those with the smallest hashes, half of them with
    spans: ``TRAINING_WINDOWS`` rows reach the driver, however often a row is repeated. None leave the tagger untrained.
    """
    texts = document_columns(docs, id_col, text_col).where(F.col("text").rlike("[0-9@]"))
    share = min(1.0, training_documents / max(1, texts.count()))
    chosen = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit("pii")), 11) < int(share * (1 << 53))
    windows = map_columns(texts.where(chosen).select("text"), labelled_windows, "row binary, tags binary, tagged boolean")
    place = F.row_number().over(Window.partitionBy("tagged").orderBy(F.xxhash64("row", "tags"), "row", "tags"))
    kept = windows.distinct().withColumn("place", place).where(F.col("place") <= TRAINING_WINDOWS // 2)
    found = sorted(kept.select("row", "tags").collect())
    ids = np.array([np.frombuffer(x.row, np.uint8) for x in found], np.uint8).reshape(-1, WINDOW)
    tags = np.array([np.frombuffer(x.tags, np.uint8) for x in found], np.uint8).reshape(-1, WINDOW)
    return fit(ids, tags)


def joined(spans: list[Span]) -> str:
    """``kind:start:end`` by start, then kind, with commas between."""
    ordered = sorted(spans, key=lambda span: (span[0], KINDS.index(span[2]), span[1]))
    return ",".join([f"{kind}:{start}:{end}" for start, end, kind in ordered])


def find_personal_data(
    docs: DataFrame, training_documents: int = TRAINING_DOCUMENTS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, base, added``: the spans of the patterns and of the tagger in every row, as ``kind:start:end`` lists.

    Places count code points, the end is behind the span. A NULL or empty text has none; repeated rows have the same
    spans; a NULL id stays; an empty table gives an empty one; other columns are ignored. No row is moved.
    """
    tagger = train(docs, training_documents, id_col, text_col)

    def find(ids, texts):
        base = [base_spans(text) for text in texts]
        return ids, [joined(x) for x in base], [joined(x) for x in tagger.spans(texts, base)]

    return map_columns(document_columns(docs, id_col, text_col), find, "doc_id bigint, base string, added string")


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with the name of its kind in place of each span; spans that overlap become one, named by the first."""
    out, at = [], 0
    for start, end, kind in sorted(spans, key=lambda span: (span[0], KINDS.index(span[2]))):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_documents(
    docs: DataFrame, training_documents: int = TRAINING_DOCUMENTS, id_col: str = "doc_id", text_col: str = "text",
    length_col: str = "n_chars",
) -> DataFrame:
    """The rows of ``docs`` with spans replaced; a NULL text stays, and ``length_col``, where there is one, counts anew.

    All other columns stay as they are, repeated rows stay, an empty table gives an empty one; no row is moved.
    """
    tagger = train(docs, training_documents, id_col, text_col)

    def redacted(texts):
        base = [base_spans(text) for text in texts]
        return [redact(text, [*one, *two]) for text, one, two in zip(texts, base, tagger.spans(texts, base), strict=True)]

    out = replace_texts(docs, text_col, redacted)
    if length_col in docs.columns:
        counted = F.length(text_col).cast(docs.schema[length_col].dataType)
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(counted))
    return out.select(*docs.columns)
