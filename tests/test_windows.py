from __future__ import annotations

import datetime
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from querydelta.functions.sorting import orders, place

from querydelta.operators import datagen as D
from querydelta.operators import ordering as O
from querydelta.operators import windows as W
from querydelta.operators.positions import Total, running, scan
from querydelta.operators.selection import inside, locate, with_place
from tests.conftest import table


@pytest.fixture
def skewed(rows):
    """One partition holds most rows; the order key has ties, NULLs and a hot value."""
    rng = random.Random(7)
    data = []
    for i in range(400):
        part = "hot" if rng.random() < 0.7 else rng.choice(["a", "b", None])
        key = None if rng.random() < 0.1 else (5 if rng.random() < 0.4 else rng.randrange(20))
        data.append((i, part, key, rng.randrange(100)))
    return rows("id int, part string, k int, v int", *data)


WANTED = {fn: fn for fn in ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile")}


@pytest.mark.parametrize("order", [["k"], ["k desc"], ["k nulls last", "v"], ["k desc nulls first"]])
def test_ranks_do_not_depend_on_chunks(skewed, order):
    keys = orders(order)
    peers, line = Window.partitionBy("part").orderBy(*keys), Window.partitionBy("part").orderBy(*keys, "id")
    plain = {fn: getattr(F, fn)() for fn in WANTED if fn != "ntile"} | {"ntile": F.ntile(7)}
    want = skewed.select("id", *[plain[fn].over(line if fn in ("row_number", "ntile") else peers).alias(fn) for fn in WANTED])
    want = {r.id: tuple(round(r[fn], 9) for fn in WANTED) for r in want.collect()}
    for limit in (7, 100, 1000):
        df = scan(skewed, ["part"], order, ["id"], WANTED, buckets=7, rows_per_chunk=limit)
        assert {r.id: tuple(round(r[fn], 9) for fn in WANTED) for r in df.collect()} == want


def test_running_totals_do_not_depend_on_chunks(skewed):
    totals = {"s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))}

    def got(part, limit):
        df = running(skewed, part, ["k", "id"], totals, rows_per_chunk=limit)
        return {r.id: (r.pos, r.s, r.lo, r.hi) for r in df.collect()}

    for part in (["part"], [], ["part", "v"]):
        assert got(part, 13) == got(part, 1000)


@pytest.mark.parametrize("values", [
    lambda rng: rng.uniform(-1e9, 1e9), lambda rng: 10.0 ** rng.randint(-300, 300) * rng.choice([1, -1]),
    lambda rng: rng.choice([float("nan"), float("inf"), -float("inf"), 1.5]), lambda rng: 5e-324,
])
def test_sums_of_doubles_do_not_depend_on_chunks(rows, values):
    rng = random.Random(2)
    df = rows("id int, p int, k int, x double", *[(i, i % 2, i // 7, values(rng)) for i in range(300)])
    totals = {"a": Total("sum", F.col("x")), "b": Total("sum", F.col("x"), peers=True)}

    def got(limit):
        found = scan(df, ["p"], ["k"], ["id"], totals=totals, rows_per_chunk=limit).collect()
        return {r.id: (repr(r.a), repr(r.b)) for r in found}

    assert got(10) == got(1000)
    exact = [(r.id, r.p, r.x) for r in df.collect()]
    if all(math.isfinite(x) and abs(x) < 1e10 and abs(x) > 1 for _, _, x in exact):
        for row, (a, _) in got(10).items():
            assert float(a) == float(sum(Decimal(repr(x)) for id_, p, x in exact if id_ <= row and p == row % 2))


def _frame_rows(data, part, frame, pick):
    """``pick`` of the values in ``(first, last)`` rows around each row, by brute force."""
    out = {}
    for p in {row[1] for row in data}:
        line = sorted((row for row in data if row[1] == p), key=lambda row: (row[3], row[0]))
        for at, row in enumerate(line):
            held = [x[2] for x in line[max(0, at + frame[0]) : max(0, at + frame[1] + 1)] if x[2] is not None]
            out[row[0]] = pick(held)
    return out


@pytest.mark.parametrize("function, frame", [
    ("sum", (-3, -1)), ("sum", (-50, 0)), ("sum", (-500, 500)), ("sum", (2, 2)), ("sum", (1, 400)), ("sum", (-400, -2)),
    ("count", (-1, 1)), ("count", (3, 60)), ("min", (0, 2)), ("max", (-50, 7)),
])
def test_sliding_frames(skewed, frame, function):
    data = [(r.id, r.part, r.k, r.v) for r in skewed.collect()]
    pick = {
        "sum": lambda held: sum(held) if held else None, "count": len, "min": lambda held: min(held, default=None),
        "max": lambda held: max(held, default=None),
    }[function]
    framed = W._framed(skewed, function, F.col("k"), ["part"], ["v"], ["id"], {"x": frame})
    assert {r.id: r.x for r in framed.collect()} == _frame_rows(data, "part", frame, pick)


@pytest.mark.parametrize("function, frames", [
    ("sum", ("rows", "range")), ("sum", ("whole", "rows")), ("sum", ((-3, -1), (0, 2))), ("sum", ("range", (-1, 0))),
    ("count", ("rows", "range")), ("min", ("range", "whole")), ("max", ("rows", (-4, 1))),
])
def test_frames_do_not_depend_on_chunks(spark, skewed, frames, function):
    def got():
        df = W.frame_divergence(skewed, function, F.col("k") / 3, ["part"], ["v"], *frames, ["id"])
        return sorted((r.id, r.v_baseline, r.v_candidate) for r in df.fillna(-1).collect())

    plain = got()
    spark.conf.set("querydelta.chunkRows", "10")
    try:
        assert got() == plain
    finally:
        spark.conf.unset("querydelta.chunkRows")


def test_rows_and_range_agree_on_doubles_in_a_total_order(spark, rows):
    df = rows("id int, p int, x double", *[(i, 1, i * 0.1) for i in range(2000)])
    for limit in ("100", "5000000"):
        spark.conf.set("querydelta.chunkRows", limit)
        try:
            assert W.frame_divergence(df, "sum", "x", ["p"], ["id"], "rows", "range", ["id"]).count() == 0
        finally:
            spark.conf.unset("querydelta.chunkRows")


@pytest.mark.parametrize("order", [
    ["k"], ["k desc"], ["k nulls last"], ["k desc nulls first"], ["s desc", "k"], ["s", "d desc"], ["x desc nulls first", "s desc"],
    ["t desc", "b"], ["d", "x"], ["m desc"],
])
def test_place_sorts_as_the_order_does(rows, order):
    rng = random.Random(5)
    def one(i):
        return (
            i, rng.choice([None, -3, 0, 7]), rng.choice([None, "", "a", "ab", "b", "é"]),
            rng.choice([None, datetime.date(1969, 1, 1), datetime.date(2020, 2, 2)]),
            rng.choice([None, float("nan"), -1.5, 0.0, 2.5, float("inf")]), rng.choice([None, datetime.datetime(1960, 1, 1), datetime.datetime(2021, 5, 5, 1)]),
            rng.choice([None, True, False]), rng.choice([None, Decimal("1.50"), Decimal("-2.25")]),
        )
    df = rows("id int, k int, s string, d date, x double, t timestamp, b boolean, m decimal(9,2)", *[one(i) for i in range(60)])
    want = [r.id for r in df.orderBy(*orders([*order, "id"])).collect()]
    assert [r.id for r in df.orderBy(place(df, [*order, "id"])).collect()] == want
    facts = df.agg(F.min_by("id", place(df, [*order, "id"])).alias("a"), F.max_by("id", place(df, [*order, "id"])).alias("b")).first()
    assert (facts.a, facts.b) == (want[0], want[-1])


@pytest.mark.parametrize("order", [["k"], ["k desc nulls first"], ["part desc", "k"]])
def test_locate_finds_every_row(skewed, order):
    placed = with_place(skewed, order)
    line = placed.orderBy("at__").collect()
    for n in (1, 2, 57, 200, 399, 400):
        found = locate(placed, n, 5, 400)
        held = [r["at__"] for r in inside(placed, found).collect()]
        assert len(held) == found.rows and (len(held) <= 5 or found.one_key)
        assert line[n - 1]["at__"] in held and found.before == sum(r["at__"] < min(held) for r in line)


def test_window_paths(rows):
    scores = rows("dept string, score int", ("A", 10), ("A", 10), ("B", 20))
    row = W.window_path_profile(scores, ["dept"], ["score"]).first()
    assert (row.n_partitions, row.n_tied_peer_groups, row.n_ordered_partitions) == (2, 1, 0)
    empty = W.window_path_profile(scores.limit(0), ["dept"], ["score"]).first()
    assert (empty.n_partitions, empty.n_rows) == (0, 0)


def test_no_divergence_is_an_empty_result(rows):
    df = rows("id int, p int, k int", (1, 1, 1), (2, 1, 2), (3, 2, 1))
    assert W.rank_function_divergence(df, ["p"], ["k"], "rank", "dense_rank", ["id"]).count() == 0
    assert W.frame_divergence(df, "sum", "k", ["p"], ["k"], "rows", "range", ["id"]).count() == 0


def test_lag(rows):
    df = rows("id int, v int", (1, 5), (2, 5), (3, 7), (4, None), (5, 6))
    got = table(W.lag_lead_paths(df, "v", [], ["id"], [], 1, -1, ">=", ">="), "path", "n")
    assert got == {"null_lag": 3, "below_lag": 0, "equal_to_lag": 1, "above_lag": 1}


def test_top_k_filter_limits_groups_before_the_shuffle(skewed):
    plan = W.window_filter_boundary(skewed, ["part"], ["v"], "row_number", 3, "<=", 3, "<", ["id"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2


def test_order_separation(rows):
    employee = rows("dept string, salary int", ("A", 20), ("A", 10), ("B", 30))
    assert O.order_separation(employee, ["dept"], "salary").first().satisfied
    assert not O.order_separation(employee, ["dept", "salary"], "salary").first().satisfied
    nulls = rows("dept string, salary int", ("A", 20), ("A", None))
    assert not O.order_separation(nulls, ["dept"], "salary").first().satisfied
    assert O.order_null_path(nulls, "salary").first().satisfied


def test_cutoff_ties(rows):
    df = rows("k int", (1,), (2,), (2,), (3,))
    assert O.topn_cutoff_ties(df, ["k"], 3).first().deterministic
    row = O.topn_cutoff_ties(df, ["k"], 2).first()
    assert (row.n_tied, row.n_slots, row.deterministic) == (2, 1, False)
    assert O.topn_cutoff_ties(df, ["k"], 9).first().deterministic
    assert not O.topn_cutoff_ties(df, [], 2).first().deterministic


def test_limits(rows):
    df = rows("k int", *[(i,) for i in range(10)])
    assert O.limit_reachability(df, 3, 5).first().visible
    assert not O.limit_reachability(df, 20, 50).first().visible
    shifted = O.limit_reachability(df, 3, 3, 1, 2).first()
    assert (shifted.visible, shifted.required_rows) == (True, 2)
    got = {(r.k, r.direction) for r in O.topn_membership_diff(df, ["k"], ["k"], ["k"], 2, 2, 0, 1).collect()}
    assert got == {(0, "baseline_only"), (2, "candidate_only")}


def test_key_repair_is_unique_whatever_the_skew(rows, tiny_groups):
    df = rows("id int, seq int", *[(1, i) for i in range(10)], (2, 0), (7, 0), (7, 1))
    repaired, mapping = D.repair_duplicate_keys(df, "id", ["seq"])
    keys = [r.new_key for r in repaired.collect()]
    assert sorted(keys) == [1, 2, 7, *range(8, 18)]
    assert mapping.count() == 10 and mapping.where("new_key <= 7").count() == 0
