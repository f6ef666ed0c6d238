from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from querydelta.operators import audit as A
from querydelta.operators import evidence as E
from querydelta.plans.diagnosis import diagnose, findings
from tests.conftest import table

DIFFS = (
    "case_id int, diff_id string, obligation_id string, scope_id string, scope_kind string, clause string, "
    "diff_type string, target_table string, target_column string, baseline_op string, candidate_op string, "
    "baseline_sql string, candidate_sql string, severity double"
)


def _diff(case, diff, kind, clause, before="", after="", ops=("", ""), scope="root", obligation="o", severity=0.5,
          column="c"):
    return (case, diff, obligation, scope, scope.split(":")[0].upper(), clause, kind, "t", column, *ops, before, after, severity)


EFFECTS = ("case_id int, diff_id string, distinguished boolean, constraints_satisfied boolean, "
           "causal_attribution_verified boolean")
MUTATIONS = ("case_id int, mutation_test_id string, diff_ids array<string>, mutation_scope array<string>, "
             "dependent_changes array<string>, binding_quality string, replacement_exec_ok boolean, "
             "fixed_by_replacement boolean")


def test_grades(rows):
    diffs = rows(DIFFS, *[_diff(1, d, "where_changed", "WHERE") for d in "abcdef"], _diff(2, "z", "where_changed", "WHERE"))
    effects = rows(EFFECTS, (1, "a", True, True, True), (1, "b", True, None, False), (1, "c", True, False, False))
    mutations = rows(
        MUTATIONS, (1, "m1", ["d"], ["WHERE"], [], "Exact", True, True),
        (1, "m2", ["e", "f"], ["WHERE"], [], "exact", True, True), (1, "m3", ["e"], [], ["GROUP BY"], "exact", True, True),
        (1, "m4", ["f"], [], [], "clause", True, True), (1, "m5", ["b", ""], [], [], "exact", False, True),
    )
    got = table(E.evidence_grade(diffs, effects, mutations, rows("case_id int", (1,))), "diff_id", "evidence_grade")
    assert got == {
        "a": "CAUSAL_VERIFIED", "b": "PAIR_DISTINGUISHED", "c": "OUTPUT_ONLY", "d": "REPAIR_VERIFIED",
        "e": "OUTPUT_ONLY", "f": "OUTPUT_ONLY", "z": "AST_ONLY",
    }


def test_anti_join_stage_depends_on_the_clause(rows):
    kind = "null_sensitive_antijoin_equivalence"
    diffs = rows(DIFFS, _diff(1, "a", kind, "where"), _diff(1, "b", kind, "SUBQUERY"), _diff(1, "c", "x", "elsewhere"))
    got = table(E.logical_stage(diffs), "diff_id", "logical_stage", "teaching_stage")
    assert got == {"a": ("ROW_FILTER", "S2"), "b": ("SOURCE_JOIN", "S1"), "c": ("EXTENSION", "EXTENSION")}


def test_rules_do_not_catch_their_neighbours(rows):
    diffs = rows(
        DIFFS, _diff(1, "gt", "comparison_operator_changed", "WHERE", "x >= 1", "x > 1", ("GTE", "GT")),
        _diff(1, "turn", "comparison_operator_changed", "WHERE", "x >= 1", "x <= 1", ("GTE", "LTE")),
        _diff(1, "inner", "join_type_changed", "JOIN", "JOIN b", "INNER JOIN b"),
        _diff(1, "right", "join_type_changed", "JOIN", "JOIN b", "RIGHT OUTER JOIN b"),
        _diff(1, "intersect", "set_operator_changed", "SET", "INTERSECT", "EXCEPT"),
        _diff(1, "count", "aggregate_argument_changed", "SELECT", "COUNT(C)", "count( * )", column="C"),
        _diff(1, "sum", "aggregate_argument_changed", "SELECT", "SUM(c)", "SUM(d)"),
        _diff(1, "plain", "count", "SELECT"),
    )
    got = table(
        E.classify_rule(E.logical_stage(diffs), rows("table_name string, column_name string", ("T", "c"))),
        "diff_id", "rule_id",
    )
    none = "UNCLASSIFIED_SUPPORTED_DIFF"
    assert got == {
        "gt": "S2_BOUNDARY", "turn": none, "inner": none, "right": "S1_OUTER_JOIN_MISUSE", "intersect": none,
        "count": "S5_COUNT_NULL_SENSITIVITY", "sum": none, "plain": none,
    }


def test_classification_reads_declared_facts(rows):
    extra = ", baseline_side string, candidate_side string, baseline_value_kind string, candidate_value_kind string, function_name string"
    plain = [
        (_diff(1, "side", "join_type_changed", "JOIN", "b", "b"), ("left", "INNER", None, None, None), "S1_OUTER_JOIN_MISUSE"),
        (_diff(1, "cross", "join_type_changed", "JOIN", "JOIN b", "b"), (None, "cross", None, None, None), "S1_CARTESIAN_PRODUCT"),
        (_diff(1, "named", "join_type_changed", "JOIN", "a LEFT OUTER JOIN b", "a JOIN b"), (None,) * 5, "S1_OUTER_JOIN_MISUSE"),
        (_diff(1, "plain", "join_type_changed", "JOIN", "a INNER JOIN b", "a JOIN b"), (None,) * 5, "UNCLASSIFIED_SUPPORTED_DIFF"),
        (_diff(1, "kind", "comparison_operator_changed", "WHERE", "x", "y", ("IN", "EQ")), (None, None, "expression", None, None),
         "S1_SUBQUERY_CARDINALITY"),
        (_diff(1, "value", "comparison_operator_changed", "WHERE", "x", "y", ("IN", "EQ")), (None, None, "column", None, None),
         "UNCLASSIFIED_SUPPORTED_DIFF"),
        (_diff(1, "fn", "function_argument_changed", "SELECT", "x", "y"), (None, None, None, None, "case"), "S5_CASE_INCOMPLETE"),
        (_diff(1, "no", "function_argument_changed", "SELECT", "x", "y"), (None, None, None, None, "abs"), "UNCLASSIFIED_SUPPORTED_DIFF"),
    ]
    diffs = E.logical_stage(rows(DIFFS + extra, *[(*diff, *more) for diff, more, _ in plain]))
    got = table(E.classify_rule(diffs, rows("table_name string, column_name string")), "diff_id", "rule_id")
    assert got == {diff[1]: rule for diff, _, rule in plain}


def test_a_signal_lifts_the_grade_but_not_the_confidence(rows):
    diffs = E.evidence_grade(E.logical_stage(rows(DIFFS, _diff(1, "j", "join_missing", "JOIN", "JOIN b", ""))), rows(EFFECTS),
                             rows(MUTATIONS), rows("case_id int"))
    classified = E.classify_rule(diffs, rows("table_name string, column_name string"))
    cases = rows("case_id int, suspected_cartesian boolean, duplicate_delta int, has_limit boolean, has_order boolean, "
                 "aggregate_in_where boolean", (1, True, 0, False, False, False))
    found = table(E.build_candidates(E.with_signals(classified, cases)), "rule_id", "evidence_grade", "confidence", "severity")
    grade, confidence, severity = found["S1_CARTESIAN_PRODUCT"]
    assert grade == "OUTPUT_ONLY" and confidence == pytest.approx(0.42 + 0.16 * severity)


def _run(rows, diffs, effects=(), deps=()):
    return diagnose(
        rows(DIFFS, *diffs), rows(EFFECTS, *effects), rows(MUTATIONS), rows("case_id int", (1,)),
        rows("table_name string, column_name string"),
        rows("case_id int, from_diff_id string, to_diff_id string, type string", *deps),
    )


def test_case_summary_survives_but_others_go(rows):
    run = _run(rows, [
        _diff(1, "summary", "where_changed", "WHERE", "x > 1", "x >= 1"),
        _diff(1, "atomic", "comparison_operator_changed", "WHERE", "x > 1", "x >= 1", ("GT", "GTE")),
        _diff(1, "case", "case_changed", "CASE", "a", "b"),
        _diff(1, "projection", "function_argument_changed", "SELECT", "a", "b"),
        _diff(1, "loose", "projection_changed", "SELECT", "p", "q", obligation=None),
    ])
    assert {r.diff_id for r in run.diffs.collect()} == {"atomic", "case", "projection"}


def test_explicit_dependency_silences_only_unproven_findings(rows):
    diffs = [
        _diff(1, "root", "comparison_operator_changed", "WHERE", "x > 1", "x >= 1", ("GT", "GTE")),
        _diff(1, "symptom", "having_changed", "HAVING", "COUNT(*) > 1", ""),
        _diff(1, "proven", "order_direction_changed", "ORDER BY", "x", "x DESC"),
    ]
    effects = [(1, "root", True, True, True), (1, "proven", True, True, True)]
    deps = [(1, "root", "symptom", "CAUSES"), (1, "root", "proven", "CAUSES"), (1, "symptom", "proven", "MASKS")]
    run = _run(rows, diffs, effects, deps)
    got = table(run.ranked, "rule_id", "role")
    assert got == {"S2_BOUNDARY": "primary", "S4_HAVING_MISSING": "suppressed", "S6_ORDER_OFFSET": "secondary"}
    assert run.edges.where("suppresses").count() == 1
    same = _run(rows, diffs[::-1], effects[::-1], deps[::-1])
    assert table(same.ranked, "candidate_id", "role", "place") == table(run.ranked, "candidate_id", "role", "place")


def test_signals_add_candidates_once(rows):
    diffs = E.evidence_grade(E.logical_stage(rows(
        DIFFS, _diff(1, "j", "join_missing", "JOIN", "JOIN b", ""), _diff(1, "g", "aggregate_argument_changed", "SELECT", "SUM(a)", "SUM(b)"),
        _diff(1, "w", "where_changed", "WHERE", "Salary >  5", ""), _diff(1, "h", "having_changed", "HAVING", "", "salary > 5"),
        _diff(2, "w", "where_changed", "WHERE", "a > 5", ""), _diff(2, "h", "having_changed", "HAVING", "", "b > 5"),
    )), rows(EFFECTS), rows(MUTATIONS), rows("case_id int"))
    classified = E.classify_rule(diffs, rows("table_name string, column_name string"))
    cases = rows("case_id int, suspected_cartesian boolean, duplicate_delta int, has_limit boolean, has_order boolean, "
                 "aggregate_in_where boolean", (1, True, 2, False, False, False), (2, True, 2, True, False, True))
    got = {(r.case_id, r.rule_id, r.diff_id, r.evidence_grade) for r in E.signal_diffs(classified, cases).collect()}
    assert got == {
        (1, "S1_CARTESIAN_PRODUCT", "j", "OUTPUT_ONLY"), (1, "S5_FANOUT_AGGREGATE", "j", "AST_ONLY"),
        (1, "S5_FANOUT_AGGREGATE", "g", "AST_ONLY"), (1, "S4_ROW_FILTER_IN_HAVING", "w", "AST_ONLY"),
        (1, "S4_ROW_FILTER_IN_HAVING", "h", "AST_ONLY"), (2, "S2_AGGREGATE_IN_WHERE", "w", "AST_ONLY"),
    }


def test_scope_order(rows):
    nodes = rows("case_id int, scope_id string, scope_kind string", (1, "root", "ROOT"), (1, "cte:b", "CTE"),
                 (1, "cte:a", "CTE"), (2, "x", "CTE"), (2, "y", "CTE"), (2, "z", "ROOT"), (3, "only", "ROOT"))
    edges = rows("case_id int, source_scope_id string, target_scope_id string", (1, "cte:b", "cte:a"),
                 (1, "cte:a", "root"), (1, "cte:a", "cte:a"), (2, "x", "y"), (2, "y", "x"), (2, "gone", "z"))
    got = {(r.case_id, r.scope_id): (r.scope_rank, r.partial) for r in E.scope_order(nodes, edges).collect()}
    assert got == {
        (1, "cte:b"): (1, False), (1, "cte:a"): (2, False), (1, "root"): (3, False), (2, "z"): (1, True),
        (2, "x"): (2, True), (2, "y"): (3, True), (3, "only"): (1, False),
    }


RUN = "case_id int, status string, conclusion string, judge_status string, executed boolean, has_boundary boolean, has_guard boolean"


def test_verdicts_fail_closed(rows):
    runs = rows(
        RUN, (1, "SUPPORTED", "NOT_EQUIVALENT", "WRONG", True, False, False),
        (2, "KNOWN_GAP", "NOT_EQUIVALENT", "WRONG", True, False, False),
        (3, "SUPPORTED", "NO_COUNTEREXAMPLE_FOUND", "CORRECT", True, False, False),
        (4, "SUPPORTED", "NO_COUNTEREXAMPLE_FOUND", "CORRECT", True, True, False),
        (5, None, None, None, None, None, None), (6, "SUPPORTED", "NOT_EQUIVALENT", "SECURITY_REJECTED", True, False, False),
    )
    got = table(E.project_verdict(runs), "case_id", "verdict", "failure_status", "teachable")
    assert [got[i][0] for i in range(1, 7)] == ["INCORRECT", "UNDECIDED", "CORRECT", "UNDECIDED", "UNDECIDED", "UNDECIDED"]
    assert got[6][1:] == ("KNOWN_GAP", False) and got[3][1] == "ENGINE_GAP"


def test_hints_show_one_slot(rows):
    run = _run(rows, [_diff(1, "d", "comparison_operator_changed", "WHERE", "x > 1", "x >= 1", ("GT", "GTE"))],
               [(1, "d", True, True, True)])
    runs = rows(RUN, (1, "SUPPORTED", "NOT_EQUIVALENT", "WRONG", True, False, False))
    witness = rows("case_id int, witness string", (1, "row 5"))
    for level, kind in ((1, "LOCATION"), (2, "WITNESS"), (3, "REFLECTION")):
        hint = findings(run, runs, level, witness).first()
        assert (hint.kind, hint.witness) == (kind, "row 5" if level == 2 else None)
    with pytest.raises(ValueError):
        findings(run, runs, 4)


def test_stable_ids_ignore_positions(rows):
    a = E.stable_ids(rows("x int, y string", (1, "é\"q"), (2, None)), "diff", ["x", "y"])
    b = E.stable_ids(rows("y string, x int", (None, 2), ("é\"q", 1)), "diff", ["y", "x"])
    assert table(a, "x", "stable_id") == table(b, "x", "stable_id")


def test_redaction(rows):
    body = {"sql": "SELECT  a\nFROM t;", "deep": [{"Standard_SQL": "x", "note": 'says "select a from T" here'}],
            "long": "é" * 50, "n": 1, "short": "t"}
    payloads = rows("payload_id int, case_id int, payload string", (1, 1, json.dumps(body)), (2, 2, json.dumps(body)))
    secrets = rows("case_id int, secret string", (1, " select a from t ; "), (1, "t"))
    got = {r.payload_id: json.loads(r.payload) for r in A.redact_payload(payloads, secrets, max_chars=40).collect()}
    hidden = "[redacted reference content]"
    assert got[1] == {"sql": hidden, "deep": [{"note": hidden}], "long": "é" * 40, "n": 1, "short": "t"}
    assert got[2]["sql"] == body["sql"] and got[2]["deep"] == [{"note": body["deep"][0]["note"]}]


def test_leak_audit(rows):
    schema = "payload_id int, case_id int, level int, payload string, has_witness boolean"
    payloads = rows(
        schema, (1, 1, 2, json.dumps({"a": {"test_database": 1}, "m": "x select A  from t y"}), True),
        (2, 1, 2, json.dumps({"witness": "test_database: not a key", "m": "fine"}), True),
        (3, 1, 1, json.dumps({"witness": 1}), True),
    )
    got = {(r.payload_id, r.issue) for r in A.audit_leaks(payloads, rows("case_id int, secret string", (1, "SELECT a FROM t;"))).collect()}
    assert got == {(1, "forbidden_keys:test_database"), (1, "witness_slot"), (1, "full_reference"), (3, "witness_slot")}


def test_corpus_leaks_against_brute_force(spark, rows):
    words = "the cat sat on a mat while dogs ran round that old house near some river bank".split()
    docs, refs = [], []
    for i in range(60):
        docs.append((i, " ".join(words[(i * k) % len(words)] + ("s" if (i + k) % 5 == 0 else "") for k in range(1, 14 + i % 9))))
    for j in range(40):
        text = docs[(j * 7) % 60][1]
        start = j % 11
        refs.append((j, "  " + text[start : start + 8 + 3 * (j % 13)].upper().replace(" ", " \n ") + " ;"))
    refs += [(100, "short"), (101, "the the the the the"), (102, docs[3][1]), (103, "not there at all, never")]

    def fold(text):
        return " ".join(text.strip().rstrip(";").split()).lower()

    # a passage cut at a blank keeps no blank at its ends
    refs = [(j, fold(text)) for j, text in refs]
    want = {(d, j) for d, text in docs for j, ref in refs if len(ref) >= 8 and ref in fold(text)}
    a, b = rows("doc_id int, text string", *docs), rows("item_id int, text string", *refs)
    assert {(r.doc_id, r.item_id) for r in A.corpus_leaks(a, b, width=3).collect()} == want
    assert {(r.doc_id, r.item_id) for r in A.corpus_leaks(a, b).collect()} == want
    assert A.corpus_leaks(a, b.limit(0)).count() == 0
    inside = a.selectExpr("*", "doc_id % 3 as part"), b.selectExpr("*", "item_id % 3 as part")
    within = {(d, j) for d, j in want if d % 3 == j % 3}
    assert {(r.doc_id, r.item_id) for r in A.corpus_leaks(*inside, part="part").collect()} == within


def test_a_case_of_many_strings_and_secrets(spark):
    ids = spark.range(20_000)
    payloads = ids.selectExpr(
        "id as payload_id", "cast(1 as bigint) as case_id",
        "to_json(named_struct('m', concat('row ', id, ' says value number ', id * 7, ' again'))) as payload",
    )
    secrets = spark.range(4000).selectExpr("cast(1 as bigint) as case_id", "concat('Value  number ', id * 70, ' again;') as secret")
    shown = A.redact_payload(payloads, secrets)
    hidden = {r.payload_id for r in shown.where("n_changes > 0").collect()}
    # a secret of one more digit in front of the number is another number
    want = {i for i in range(20_000) if i * 7 % 70 == 0 and i * 7 // 70 < 4000}
    assert hidden == want


def test_cases_and_runs(rows):
    cases = rows("id int, a string, suite string", (1, "x  y", "s"), (2, "X\ny", "s"), (3, "z", "t"))
    assert table(A.dedupe_cases(cases, "id", ["a"]), "id", "copies") == {1: 2, 3: 1}
    assert A.declared_counts(cases, rows("suite string, declared int", ("s", 2), ("u", 1)), "suite").count() == 2
    runs = rows("repeat int, id int, digest string", (1, 1, "a"), (2, 1, "a"), (3, 1, "b"), (1, 2, "c"), (2, 2, "c"))
    assert [(r.repeat, r.id) for r in A.run_determinism(runs).collect()] == [(3, 1)]
    a, b = rows("c int, pos int, v int", (1, 1, 5), (1, 2, 6)), rows("c int, pos int, v int", (1, 1, 6), (1, 2, 5))
    assert A.replay_agreement(a.drop("pos"), b.drop("pos"), "c").first().agrees
    assert not A.replay_agreement(a, b, "c").first().agrees
    errors = rows("c int, recorded_error boolean, replayed_error boolean", (1, False, True), (2, True, True))
    states = table(A.replay_agreement(a, a, "c", errors), "c", "agrees")
    assert states == {1: False, 2: True}


def test_every_suggested_probe_exists(rows):
    from querydelta.functions.vocabulary import PROBES_OF_TYPE
    from querydelta.operators import (
        aggregates, compare, hierarchy, joins, membership, ordering, predicates, sets, windows,
    )

    modules = (aggregates, compare, hierarchy, joins, membership, ordering, predicates, sets, windows)
    for names in PROBES_OF_TYPE.values():
        for name in names.split():
            assert any(hasattr(module, name) for module in modules), name
    assert len(PROBES_OF_TYPE) == 70
    unknown = E.suggested_probes(rows(DIFFS, _diff(1, "a", "unheard_of", "WHERE"))).first()
    assert unknown.probes is None
