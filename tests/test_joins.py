from __future__ import annotations

from collections import Counter
from itertools import product

import pytest

from querydelta.operators import aggregates as A
from querydelta.operators import joins as J
from querydelta.operators import membership as M
from tests.conftest import table

ON = [("customer_id", "id")]


def test_matched_and_dangling_keys(rows):
    orders, customers = rows("customer_id int", (1,), (2,)), rows("id int", (1,), (3,))
    got = table(J.join_path_profile(orders, customers, ON), "path", "n_keys", "satisfied")
    assert got["matched"] == (1, True) and got["dangling_left"] == (1, True) and got["dangling_right"] == (1, True)
    assert got["null_left"] == (0, False)


def test_all_null_keys_match_nothing(rows):
    nulls = rows("customer_id int", (None,), (None,))
    got = table(J.join_path_profile(nulls, nulls, [("customer_id", "customer_id")]), "path", "n_left_rows", "n_right_rows")
    assert got["matched"] == (0, 0) and got["null_left"] == (2, 0) and got["null_right"] == (0, 2)


def test_canonical_keys(rows):
    texts = rows("k string", ("1",), (" 01.0",), ("+1",), ("1e0",), ("900032",), ("1x",), (None,), ("-0",), (".50",))
    got = {(r.kind, r.key): r.n for r in J.canonical_join_key(texts, "k").collect()}
    assert got == {
        ("numeric", "1"): 4, ("numeric", "900032"): 1, ("text", "1x"): 1, (None, None): 1, ("numeric", "0"): 1,
        ("numeric", "0.5"): 1,
    }
    numbers = rows("k bigint", (1,), (10,))
    assert {r.key for r in J.canonical_join_key(numbers, "k").collect()} == {"1", "10"}


def _brute(left, right, condition):
    return sum(1 for a, b in product(left, right) if condition(a, b))


def test_condition_divergence_against_brute_force(rows):
    left = [(1, 2024), (1, 2025), (2, 2024), (None, 2024), (2, None), (3, 2024)]
    right = [(1, 2025), (1, 2024), (2, 2024), (2, 2024), (None, 2024), (4, 2020)]
    a, b = rows("id int, year int", *left), rows("id int, year int", *right)
    eq = lambda x, y: x is not None and x == y
    both = lambda p, q: eq(p[0], q[0]) and eq(p[1], q[1])
    only_id = lambda p, q: eq(p[0], q[0])
    got = table(
        J.join_condition_divergence(a, b, [("id", "id"), ("year", "year")], [("id", "id")]), "direction", "n_pairs"
    )
    assert got["both"] == _brute(left, right, both)
    assert got["baseline_only"] == 0
    assert got["candidate_only"] == _brute(left, right, lambda p, q: only_id(p, q) and not both(p, q))


def test_self_join_roles(rows):
    employee = rows("employee_id int, manager_id int", (1, 2), (2, 99))
    got = table(
        J.join_condition_divergence(
            employee, employee, [("manager_id", "employee_id")], [("employee_id", "employee_id")]
        ), "direction", "n_pairs",
    )
    assert got == {"both": 0, "baseline_only": 1, "candidate_only": 2}


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "cross"])
def test_join_type_row_counts_match_real_joins(rows, how):
    left = rows("k int", (1,), (1,), (2,), (None,))
    right = rows("j int", (1,), (3,), (None,), (1,))
    got = J.join_type_effect(left, right, [("k", "j")], "inner", how).collect()
    real = left.crossJoin(right) if how == "cross" else left.join(right, left.k == right.j, how)
    assert sum(r.n_candidate for r in got) == real.count()
    assert sum(r.n_baseline for r in got) == 4


@pytest.mark.parametrize("predicate", ["s = 'F'", "s = 'F' or s is null", "coalesce(s, 'F') = 'F'", "s is null"])
def test_outer_predicate_placement_against_real_joins(spark, rows, predicate):
    left = rows("k int, tag string", (1, "a"), (2, "b"), (3, "c"), (None, "d"), (1, "a"))
    right = rows("j int, s string", (1, "F"), (1, "O"), (2, "O"), (2, None), (9, "F"))
    left.createOrReplaceTempView("l")
    right.createOrReplaceTempView("r")
    on = spark.sql(f"select * from l left join r on k = j and ({predicate})")
    where = spark.sql(f"select * from l left join r on k = j where ({predicate})")
    a, b = Counter(tuple(r) for r in on.collect()), Counter(tuple(r) for r in where.collect())
    got = table(J.outer_predicate_placement(left, right, [("k", "j")], predicate), "direction", "n")
    assert got == {
        "both": sum((a & b).values()), "baseline_only": sum((a - b).values()), "candidate_only": sum((b - a).values())
    }


def test_presence_cardinality_and_blowup(rows):
    base = rows("k int", (1,), (2,), (3,), (None,))
    joined = rows("k int", (1,), (2,), (2,))
    got = table(J.join_presence_effect(base, joined, [("k", "k")]), "path", "n_base_rows", "n_joined_rows")
    assert got == {"filtered_out": (2, 0), "kept_once": (1, 1), "multiplied": (1, 2)}
    one = J.measured_cardinality(base, joined, [("k", "k")]).first()
    assert (one.cardinality, one.may_fan_out) == ("ONE_TO_MANY", True)
    blowup = J.cross_join_blowup(base, joined, [("k", "k")]).first()
    assert (blowup["product"], blowup.joined, blowup.ratio) == (12, 3, 4.0)
    nothing = J.cross_join_blowup(base, joined.limit(0), [("k", "k")]).first()
    assert (nothing["product"], nothing.ratio) == (0, None)


def test_fanout(rows):
    base = rows("id int, amount int, g string", (1, 10, "x"), (2, 5, "x"), (3, 7, "y"))
    lines = rows("o int", (1,), (1,), (1,), (2,))
    got = table(J.fanout_inflation(base, lines, [("id", "o")], "amount", ["g"]), "g", "base_sum", "joined_sum",
                "joined_count")
    assert got == {"x": (15, 35, 4), "y": (7, None, 0)}


@pytest.mark.parametrize("op", ["<", "<=", "=", ">=", ">", "<>"])
def test_self_join_range_against_brute_force(rows, tiny_groups, op):
    data = [(1, 5), (1, 6), (1, 6), (1, 9), (2, 5), (2, 4), (2, None), (1, 7)]
    df = rows("p int, k int", *data)
    test = {"<": int.__lt__, "<=": int.__le__, "=": int.__eq__, ">=": int.__ge__, ">": int.__gt__, "<>": int.__ne__}[op]
    want = sum(
        1 for a, b in product(data, data)
        if a[0] == b[0] and None not in (a[1], b[1]) and test(b[1], a[1] + 1)
    )
    got = J.self_join_range(df, "k", 1, op, ">", ["p"]).collect()
    assert sum(r.n_pairs for r in got if r.direction in ("both", "baseline_only")) == want


def test_membership(rows):
    outer, inner = rows("id int", (1,), (9,), (None,)), rows("employee_id int", (1,), (None,))
    got = table(M.membership_paths(outer, inner, "id", "employee_id"), "path", "n_values", "n_outer_rows")
    assert got["overlap"] == (1, 1) and got["outer_only"] == (1, 1) and got["outer_null"] == (0, 1)


@pytest.mark.parametrize("inner", [[], [(1,)], [(1,), (None,)], [(None,)]])
def test_not_in_against_not_exists(spark, rows, inner):
    a, b = rows("x int", (1,), (2,), (None,), (2,)), rows("y int", *inner)
    a.createOrReplaceTempView("a")
    b.createOrReplaceTempView("b")
    not_in = Counter(r.x for r in spark.sql("select * from a where x not in (select y from b)").collect())
    not_exists = Counter(r.x for r in spark.sql("select * from a where not exists (select 1 from b where y = x)").collect())
    got = table(M.null_antijoin_divergence(a, b, "x", "y"), "path", "n")
    assert got["both"] == sum(not_in.values())
    assert sum(got.values()) == sum(not_exists.values())
    rows_only = Counter(r.x for r in M.null_antijoin_rows(a, b, "x", "y").collect())
    assert rows_only == not_exists - not_in


def test_scalar_subquery_paths(rows):
    outer = rows("k int", (1,), (2,), (3,), (4,), (5,))
    inner = rows("k int, v int", (2, 7), (3, 7), (3, 7), (4, 7), (4, 8), (5, None), (5, 1))
    got = table(M.scalar_subquery_cardinality(outer, inner, [("k", "k")], "v"), "path", "n_rows")
    assert got == {"zero": 1, "one": 1, "many_same_value": 1, "many_values": 2}


def test_scalar_aggregate_boundary(rows):
    cars = rows("horsepower int", (51,), (50,), (49,))
    got = table(M.scalar_aggregate_boundary(cars, "horsepower", "avg(horsepower)", ">", ">="), "path", "n", "n_divergent")
    assert got == {"below": (1, 0), "at": (1, 1), "above": (1, 0), "unknown": (0, 0)}


def test_grain(rows):
    sales = rows("dept string, region string", ("A", "north"), ("A", "south"), ("B", "north"))
    got = A.group_grain_diff(sales, ["dept"], ["dept", "region"]).collect()
    assert {r.verdict for r in got} == {"candidate_finer"}
    assert {r.side: r.n_split for r in got} == {"baseline": 1, "candidate": 0}
    same = A.group_grain_diff(sales, ["dept", "region"], ["region", "dept"]).collect()
    assert {r.verdict for r in same} == {"same"}
    missing = A.group_grain_diff(sales, ["dept"], []).collect()
    assert {r.verdict for r in missing} == {"candidate_coarser"}


def test_counts_and_nulls(rows):
    employee = rows("g int, manager_id int", (1, None), (1, 7), (1, 7), (2, 8))
    null = table(A.count_null_sensitivity(employee, ["g"], "manager_id"), "g", "v_baseline", "v_candidate", "both_paths")
    assert null == {1: (2, 3, True)}
    distinct = table(A.count_distinct_sensitivity(employee, ["g"], "manager_id"), "g", "v_baseline", "v_candidate")
    assert distinct == {1: (1, 2)}
    assert A.count_null_sensitivity(employee.where("manager_id is not null"), ["g"], "manager_id").count() == 0


def test_aggregate_boundary_with_empty_groups(rows):
    sales = rows("dept string, amount int", ("A", 10), ("A", 20), ("B", 30), ("B", None))
    domain = rows("dept string", ("A",), ("B",), ("C",))
    got = table(A.aggregate_boundary(sales, ["dept"], "sum(amount)", 30, ">=", ">", domain=domain), "path", "n", "n_divergent")
    assert got == {"below": (0, 0), "at": (2, 2), "above": (0, 0), "null": (1, 0)}


def test_joined_boundary_shows_multiplied_rows(rows):
    highschooler = rows("id int, name string", (100, "Alice"), (101, "Bob"))
    friend = rows("student_id int", (100,), (100,), (101,))
    got = table(
        A.joined_aggregate_boundary(highschooler, friend, [("id", "student_id")], ["name"], 2, ">=", ">"),
        "path", "n", "n_divergent", "n_crossed",
    )
    assert got == {"below": (1, 0, 0), "at": (1, 1, 1), "above": (0, 0, 0), "null": (0, 0, 0)}


def test_order_reversals(rows, tiny_groups):
    agree = rows("g int, a int, b int", (1, 1, 10), (2, 2, 20), (3, 3, 20), (4, 4, 40), (5, 5, 50))
    assert not A.aggregate_order_reversals(agree, ["g"], "sum(a)", "sum(b)").first().satisfied
    far = rows("g int, a int, b int", (1, 1, 45), (2, 2, 50), (3, 3, 60), (4, 4, 70), (5, 5, 44))
    assert A.aggregate_order_reversals(far, ["g"], "sum(a)", "sum(b)").first().satisfied


def test_mixed_types(rows):
    tracks = rows("g int, v string", (1, "9"), (1, "10"), (1, "legacy"), (2, "b"), (2, "a"))
    got = table(A.mixed_type_extremes(tracks, ["g"], "v"), "g", "min_text", "min_typed", "max_typed")
    assert got == {1: ("10", "9", "legacy")}


def test_ratio_without_rows_to_divide_by(rows):
    df = rows("g int, flag int, m int", (1, 1, None), (2, 1, 1), (2, 0, 1))
    got = table(A.having_ratio_boundary(df, ["g"], "flag = 1", "m", 100, 50, ">=", ">"), "path", "n", "n_divergent")
    assert got == {"below": (0, 0), "at": (1, 1), "above": (0, 0), "null": (1, 0)}
