"""Runs, mixes and tries against plain versions, and on odd and empty tables."""

from __future__ import annotations

import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from querydelta.llm import batches, mixing, periods, prefixes, queries

SMALL = "/root/testdata/sf0.001"


def plain_runs(words, exponent=4, least=6):
    """Every stretch of every period, the smallest period of each."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        at = 0
        while at + q < len(words):
            end = at
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            if end > at and end - at + q >= max(least, exponent * q):
                found.setdefault((at, end - at + q), q)
            at = max(end, at) + 1
    return sorted(((start, length, q) for (start, length), q in found.items()), key=lambda run: (run[0], run[2]))


def repetitive(rng, n):
    words = []
    while len(words) < n:
        if rng.random() < 0.5:
            words += [rng.randint(0, 2) for _ in range(rng.randint(1, 12))] * rng.randint(1, 9)
        else:
            words += [rng.randint(0, 5) for _ in range(rng.randint(0, 30))]
    return np.array(words[:n], np.int64)


@pytest.mark.parametrize("exponent, least", [(4, 6), (2, 2), (3, 1), (5, 40)])
def test_runs_against_brute_force(exponent, least):
    rng = random.Random(exponent)
    texts = [repetitive(rng, rng.randint(0, 300)) for _ in range(150)]
    for text, found in zip(texts, periods.find_runs(texts, exponent, least), strict=True):
        assert [tuple(row) for row in found.tolist()] == plain_runs(text.tolist(), exponent, least)


def test_extensions_against_brute_force():
    rng = np.random.default_rng(3)
    words = np.concatenate([[9], np.tile([0, 1, 1], 80), rng.integers(0, 2, 200), np.tile([0, 1, 1], 50), [7]])
    i, j = rng.integers(0, len(words), (2, 3000))
    i, j = i[i != j], j[i != j]

    def plain(a, b):
        n = 0
        while max(a, b) + n < len(words) and words[a + n] == words[b + n]:
            n += 1
        return n

    assert periods.Extensions(words)(i, j).tolist() == [plain(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True)]


def test_long_runs_across_slices(monkeypatch):
    monkeypatch.setattr(periods, "POINTS", 50)
    text = np.array([5] * 5000 + list(range(100)) * 40, np.int64)
    assert periods.find_runs([text])[0].tolist() == [[0, 5000, 1], [5000, 4000, 100]]


def test_collapse(spark, odd, empty):
    found = {(r.doc_id, r.n_words): r for r in periods.collapse_runs(odd).collect()}
    assert periods.collapse_runs(odd).count() == odd.count()
    long = found[4, 30_000]
    assert [tuple(run) for run in long.runs] == [(0, 30_000, 1)] and long.collapsed == "word"
    assert tuple(long.strongest) == (0, 30_000, 1)
    for key in ((2, 0), (3, 0), (5, 0)):
        assert found[key].runs == [] and found[key].strongest is None and found[key].collapsed == ""
    assert (None, 17) in found or any(doc_id is None for doc_id, _ in found)
    assert periods.collapse_runs(empty).count() == 0
    ties = spark.createDataFrame([(1, "a b " * 4 + "x " + "c d " * 4 + "e " * 7)], "doc_id bigint, text string")
    row = periods.collapse_runs(ties).first()
    assert tuple(row.strongest) == (17, 7, 1) and row.collapsed == "a b x c d e"
    best = max(row.runs, key=lambda run: (Fraction(run.length, run.period), -run.start))
    assert tuple(best) == tuple(row.strongest)


def words():
    return F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))


def test_targets_are_filled_like_water(spark):
    sizes = {"a": 10, "b": 10_000, "c": 50, "d": 0, None: 7}
    sized = spark.createDataFrame([(name, size) for name, size in sizes.items()], "source string, size bigint")
    got = {r.source: r.target for r in mixing.source_targets(sized, (1, 2, 3), 3).collect()}
    order = ["a", "b", "c", "d", None]
    weights = dict(zip(order, (1, 2, 3, 1, 2), strict=True))
    rest, open_, want = sum(sizes.values()), set(order), {}
    while True:  # share, stop those above, share again
        level = rest / sum(weights[name] for name in open_)
        above = {name for name in open_ if level * weights[name] > 3 * sizes[name]}
        if not above:
            break
        for name in above:
            want[name], rest = 3 * sizes[name], rest - 3 * sizes[name]
        open_ -= above
    want |= {name: level * weights[name] for name in open_}
    assert got == pytest.approx(want)


def test_mix(spark, odd, empty):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), None, rng.choice(["hot", "hot", "hot", "b", "c", None]), 1, 1) for i in range(1500)]
    docs = spark.createDataFrame(rows, odd.schema)
    mixed = mixing.mix_sources(docs, words())
    got = mixed.collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0 for r in got)
    total = sum(r.size for r in got)
    assert total - 60 <= sum(r.taken for r in got) <= total
    for source in ("hot", "b", "c", None):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 120
    again = mixing.mix_sources(docs.orderBy(F.rand(4)).repartition(5), words()).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in got}
    strange = mixing.mix_sources(odd, words()).collect()
    assert len(strange) == odd.count() and all(r.taken == 0 for r in strange if r.size == 0)
    assert mixing.mix_sources(empty, words()).count() == 0


def test_mix_does_not_depend_on_chunks(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    plain = {tuple(r) for r in queries.op12_fair_mix(spark, SMALL).collect()}
    monkeypatch.setattr("querydelta.operators.positions.SPREAD_ROWS", 20)
    assert {tuple(r) for r in queries.op12_fair_mix(spark, SMALL).collect()} == plain and len(plain) == docs.count()


def plain_trie(conversations):
    """Every prefix with its members; conversations: id -> list of (token, words)."""
    members, sizes = {}, {}
    for conv, turns in conversations.items():
        for depth in range(len(turns) + 1):
            key = tuple(token for token, _ in turns[:depth])
            members.setdefault(key, []).append(conv)
            sizes[key] = turns[depth - 1][1] if depth else 0
    out = {}
    for key, own in members.items():
        inside = [other for other in members if other[: len(key)] == key]
        children = [other for other in inside if len(other) == len(key) + 1]
        leaves = [other for other in inside if not any(x[: len(other)] == other and len(x) > len(other) for x in inside)]
        saved = sum((len(members[other]) - 1) * sizes[other] for other in inside)
        ends = sorted(c for c in own if len(conversations[c]) == len(key))
        out[min(own), len(key)] = (
            min(members[key[:-1]]) if key else None, len(own), len(children), len(leaves), saved,
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return out


def as_table(spark, conversations):
    rows = [
        (conv, [(hashlib.md5(token.encode()).hexdigest(), words) for token, words in turns]) for conv, turns in conversations.items()
    ]
    return spark.createDataFrame(rows, "conv_id bigint, turns array<struct<token: string, words: int>>")


@pytest.mark.parametrize("per_task", [1, 3, 1000])
def test_trie_against_brute_force(spark, per_task, monkeypatch):
    monkeypatch.setattr(prefixes, "MEMBERS", 4)
    rng = random.Random(per_task)
    size = {token: rng.randint(0, 9) for token in "abc"}
    made = {conv: [(token, size[token]) for token in rng.choices("abc", k=rng.randint(0, 6))] for conv in range(120)}
    made |= {200 + at: [("a", size["a"])] * 3 for at in range(30)}  # copies
    nodes, members = prefixes.prefix_trie(as_table(spark, made), per_task)
    digests = prefixes.member_digests(members)
    nothing = hashlib.sha256(b"").hexdigest()
    found = nodes.join(digests, "node", "left").collect()
    got = {
        (r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256 or nothing)
        for r in found
    }
    assert len(found) == len(got) and got == plain_trie(made)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turns array<struct<token: string, words: int>>")
    nodes, members = prefixes.prefix_trie(empty)
    assert nodes.count() == 0 and prefixes.member_digests(members).count() == 0
    alone = spark.createDataFrame([(5, None), (3, [])], empty.schema)
    (root,) = prefixes.prefix_trie(alone)[0].collect()
    assert (root.conv_id, root.depth, root.n_convs, root.n_children, root.n_leaves, root.saved_tokens) == (3, 0, 2, 0, 1, 0)


def test_trie_query_on_odd_turns(spark, tmp_path):
    rows = [
        (0, None, None, None, 7), (0, 1, "user", "a b", 7), (1, 1, "user", "", 7), (21, 3, "x", "y", 7), (None, 1, "user", "lost", 7),
        (20, 2, "user", "z", 7), (20, 2, "user", "z", 7),
    ]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, node int").write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op13_prefix_trie(spark, str(tmp_path)).collect()
    root = next(r for r in got if r.depth == 0)
    assert root.n_convs == 4 and root.conv_id == 0
    spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert queries.op13_prefix_trie(spark, str(tmp_path / "none")).count() == 0


def test_streamed_rows_keep_every_column(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(batches, "SLICE_CHARS", 40)
    rich = odd.selectExpr("*", "array(struct(doc_id as a)) as nested", "map('k', text) as m", "timestamp'2020-01-01 00:00:00' as t")
    kept = batches.keep_rows(rich, "text", lambda texts: np.array([len(text) != 0 for text in texts]))
    want = rich.where("length(coalesce(text, '')) > 0")
    assert kept.schema == rich.schema
    assert sorted(map(str, kept.collect())) == sorted(map(str, want.collect()))
    loud = batches.replace_texts(rich, "text", lambda texts: [text.upper() for text in texts])
    assert sorted(map(str, loud.collect())) == sorted(map(str, rich.withColumn("text", F.upper("text")).select(*rich.columns).collect()))
    assert batches.keep_rows(empty, "text", lambda texts: np.ones(len(texts), bool)).count() == 0
