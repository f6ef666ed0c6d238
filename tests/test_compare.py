from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from querydelta.operators import compare as C
from querydelta.operators import sets as S
from tests.conftest import table


def _bag(df):
    return Counter(tuple(row) for row in df.collect())


def test_bag_diff_counts_copies_and_treats_nulls_alike(rows):
    a = rows("k int, v string", (1, None), (1, None), (2, "x"), (3, "y"))
    b = rows("k int, v string", (1, None), (2, "x"), (2, "x"), (4, None))
    got = {(r.k, r.v): (r.only_baseline, r.only_candidate) for r in C.bag_diff(a, b).collect()}
    assert got == {(1, None): (1, 0), (2, "x"): (0, 1), (3, "y"): (1, 0), (4, None): (0, 1)}
    swapped = {(r.k, r.v): (r.only_candidate, r.only_baseline) for r in C.bag_diff(b, a).collect()}
    assert swapped == got


def test_bag_diff_of_equal_results_is_empty(rows):
    a = rows("v double", (0.0,), (-0.0,), (float("nan"),))
    b = rows("v double", (float("nan"),), (0.0,), (0.0,))
    assert C.bag_diff(a, b).count() == 0
    assert C.result_summary(a, b).first().is_equivalent


def test_empty_inputs(rows):
    empty = rows("k int")
    assert C.bag_diff(empty, empty).count() == 0
    summary = C.result_summary(empty, empty).first()
    assert (summary.n_baseline, summary.is_equivalent) == (0, True)
    assert C.ordered_diff(empty, empty, ["k"], ["k"]).count() == 0


def test_columns_compare_by_position(rows):
    a = rows("x int, y int", (1, 2))
    b = rows("y int, x int", (1, 2))
    assert C.bag_diff(a, b).count() == 0
    assert not C.result_summary(a, b).first().column_names_match


def test_ordered_diff_reports_moved_rows_and_tails(rows):
    a = rows("k int, v string", (1, "a"), (2, "b"), (3, "c"))
    b = rows("k int, v string", (1, "a"), (2, "c"))
    got = table(C.ordered_diff(a, b, ["k"], ["k"], ["v"]), "pos", "baseline_v", "candidate_v")
    assert got == {2: ("b", "c"), 3: ("c", None)}


def test_shape_diff(rows):
    a = rows("x int, y string", (1, "a"))
    b = rows("x int, z string", (1, None))
    got = table(C.shape_diff(a, b), "column", "verdict", "n_baseline", "n_candidate")
    assert got == {"x": ("same", 1, 1), "y": ("alias_changed", 1, 0)}
    swapped = table(C.shape_diff(a, a.select("y", "x")), "column", "verdict")
    assert swapped == {"x": "position_changed", "y": "position_changed"}


def test_normalize_cells(rows):
    df = rows("d double, b binary", (3.0, b"caf\xc3\xa9"), (0.5, b"\xff"), (None, None))
    got = [tuple(r) for r in C.normalize_cells(df).collect()]
    assert got == [("3", "café"), ("0.5", "�"), (None, None)]


def test_digest_ignores_order_but_not_copies(rows):
    a = rows("k int, v string", (1, "ab"), (2, None))
    b = rows("k int, v string", (2, None), (1, "ab"))
    c = rows("k int, v string", (1, "ab"), (2, None), (2, None))
    digest = lambda df: C.table_digest(df, ["k", "v"]).first().digest
    assert digest(a) == digest(b) != digest(c)


def test_digest_keeps_cells_apart(rows):
    a = rows("x string, y string", ("1:a", "b"))
    b = rows("x string, y string", ("1", ":ab"))
    digest = lambda df: C.table_digest(df, ["x", "y"]).first().digest
    assert digest(a) != digest(b)


def test_repair_needs_a_difference_to_fix(rows):
    a, b = rows("k int", (1,)), rows("k int", (2,))
    got = table(C.repair_check(a, b, {"good": a, "bad": b}), "repair", "fixed_by_replacement")
    assert got == {"good": True, "bad": False}
    assert table(C.repair_check(a, a, {"any": a}), "repair", "fixed_by_replacement") == {"any": False}


def test_cartesian_suspect(rows):
    small, big = rows("k int", (1,), (2,)), rows("k int", *[(i,) for i in range(6)])
    assert C.cartesian_suspect(small, [small, big]).first().suspected
    assert not C.cartesian_suspect(small, [small, big], has_condition=True).first().suspected
    assert not C.cartesian_suspect(small, [small]).first().suspected


def test_set_operators_match_sparks_own(rows):
    left = rows("a int, b string", (1, "x"), (1, "x"), (2, None), (2, None), (2, None), (3, "z"), (4, "l"))
    right = rows("a int, b string", (1, "x"), (2, None), (2, None), (5, "r"), (5, "r"), (3, "z"), (3, "z"))
    real = {
        "UNION": left.union(right).distinct(), "UNION ALL": left.union(right),
        "INTERSECT": left.intersect(right), "INTERSECT ALL": left.intersectAll(right),
        "EXCEPT": left.subtract(right), "EXCEPT ALL": left.exceptAll(right),
    }
    counted = C.copies_per_row({"n_l__": left, "n_r__": right})
    for name, df in real.items():
        copies = counted.select("a", "b", S.result_copies(name).alias("n")).where("n > 0")
        assert {(r.a, r.b): r.n for r in copies.collect()} == dict(_bag(df)), name
    changes = [(a, b) for a in real for b in real]
    for row in S.set_op_effect(left, right, changes).collect():
        a, b = _bag(real[row.op_baseline]), _bag(real[row.op_candidate])
        assert (row.n_baseline, row.n_candidate) == (sum(a.values()), sum(b.values()))
        assert (row.n_only_baseline, row.n_only_candidate) == (sum((a - b).values()), sum((b - a).values()))


def test_set_paths_and_distinct(rows):
    left, right = rows("id int", (1,), (2,), (2,)), rows("id int", (2,), (3,))
    assert table(S.set_paths(left, right), "path", "n") == {"overlap": 1, "left_only": 1, "right_only": 1}
    effect = S.distinct_effect(left, ["id"]).first()
    assert (effect.n_rows, effect.n_distinct, effect.n_excess, effect.satisfied) == (3, 2, 1, True)
    assert not S.distinct_effect(right, ["id"]).first().satisfied


def test_nested_distinct(rows):
    orders = rows("customer int, product string", (1, "A"), (1, "B"), (1, "B"), (2, "A"))
    got = table(S.nested_distinct_effect(orders, ["customer", "product"], ["customer"]), "customer",
                "v_baseline", "v_candidate")
    assert got == {1: (2, 3)}


def test_same_values(rows):
    row = C.same_values(rows("n int", (7,), (7,)), rows("n int", (7,))).first()
    assert (row.same_projected_values, row.dup_baseline, row.dup_candidate) == (True, 1, 0)


def test_bag_diff_combines_before_the_shuffle(spark):
    a = spark.range(100).select((F.col("id") % 3).alias("k"))
    plan = C.bag_diff(a, a)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_sum" in plan
