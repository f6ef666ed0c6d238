"""Cases that went wrong once."""

from __future__ import annotations

import datetime
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from querydelta.functions.octets import SIZES, byte_runs, octets_of, runs_of_texts
from querydelta.functions.payload import json_keys, prune_keys
from querydelta.functions.vocabulary import PROBES_OF_TYPE
from querydelta.operators import audit as A
from querydelta.operators import datagen as D
from querydelta.operators.constraints import join_fan_out
from querydelta.operators.datagen import seed_value
from querydelta.operators.evidence import hint_slot, logical_stage, unscoped_candidates
from querydelta.operators.hierarchy import hierarchy_reach


def test_payload_keys(rows):
    texts = [
        r'{"answer\u005fsql": "x", "n": 1.0e400, "m": 12345678901234567890123456789, "a": 1, "a": 2}',
        '{"deep": [{"ANSWER_SQL": {"k": [1]}, "kept": "answer_sql"}]}', '{"answer_sql": broken', '{"other": broken', None,
    ]
    df = rows("i int, payload string", *enumerate(texts))
    found = dict(df.select("i", prune_keys(F.col("payload"), ["answer_sql"])).collect())
    assert found[0] == '{"n":1.0e400,"m":12345678901234567890123456789,"a":1,"a":2}'
    assert found[1] == '{"deep":[{"kept":"answer_sql"}]}'
    assert found[2] is None and found[3] == '{"other": broken' and found[4] is None
    assert df.where("i = 0").select(json_keys(F.col("payload"))).first()[0] == ["answer_sql", "n", "m", "a"]


def test_seed_categories(spark):
    names = ["dept_name", "country_name", "job_title_name", "name", "first_name"]
    row = spark.range(1).select(*[seed_value(name, "VARCHAR", F.lit(0)).alias(name) for name in names]).first()
    assert tuple(row) == ("Comp. Sci.", "USA", "Sales Manager", "Alice", "Alice")


def test_stages(rows):
    cases = [
        ("predicate_added", "WHERE", None, "ROW_FILTER", "S2"), ("predicate_added", "WHERE", "HAVING", "GROUP_FILTER", "S4"),
        ("literal_changed", "with recursive step", " ", "CTE_PRODUCER", "S1"), ("join_missing", "SELECT", None, "SOURCE_JOIN", "S1"),
        ("logical_operator_changed", "HAVING", None, "GROUP_FILTER", "S4"), ("where_changed", None, None, "ROW_FILTER", "S2"),
        ("set_operator_changed", None, None, "SET_OP", "EXTENSION"), (None, None, None, "EXTENSION", "EXTENSION"),
    ]
    df = rows("diff_type string, clause string, mutation_clause string, stage string, teaching string", *cases)
    for row in logical_stage(df).collect():
        assert (row.logical_stage, row.teaching_stage) == (row.stage, row.teaching), row
    known = rows("diff_type string, clause string", *[(name, None) for name in PROBES_OF_TYPE])
    assert logical_stage(known).where("logical_stage is null").count() == 0


def test_redaction_keeps_keys_and_whole_texts(rows):
    text = "select a from t"
    body = {text: text, "n": ["x" * 5000, text + " ;"], "odd\\E$1": "a \\ \" b"}
    payloads = rows("payload_id int, case_id int, payload string", (1, 1, json.dumps(body)), (2, 1, "{}"), (3, 1, None))
    secrets = rows("case_id int, secret string", (1, text))
    got = {r.payload_id: r for r in A.redact_payload(payloads, secrets).collect()}
    assert json.loads(got[1].payload) == {text: A.REDACTED, "n": ["x" * 5000, A.REDACTED], "odd\\E$1": "a \\ \" b"}
    assert (got[1].n_changes, got[1].n_cut) == (2, 0) and got[2].payload == "{}" and got[3].payload is None
    cut = {r.payload_id: r for r in A.redact_payload(payloads, secrets, max_chars=100).collect()}
    assert json.loads(cut[1].payload)["n"][0] == "x" * 100 and cut[1].n_cut == 1


def test_leaks_are_not_found_across_strings(rows):
    schema = "payload_id int, case_id int, level int, payload string, has_witness boolean"
    payloads = rows(
        schema, (1, 1, 1, json.dumps({"a": "select a", "b": "from t where x"}), False),
        (2, 1, 1, json.dumps({"a": "well, SELECT a\n from t"}), False),
    )
    found = A.audit_leaks(payloads, rows("case_id int, secret string", (1, "select a from t"))).collect()
    assert [(r.payload_id, r.issue) for r in found] == [(2, "full_reference")]


def test_claims_that_cannot_hold(rows):
    day = datetime.date(2024, 5, 1)
    df = rows("slot int, a int, b int, d date", (1, 1, 1, None), (2, 2, 5, day), (3, None, 4, day))
    claims = rows(
        "row_slot int, column_name string, relation string, value string, priority int, owner string, locked boolean",
        (1, "a", "equals_column", "nope", 1, "p", True), (1, "b", "not_equals_column", "a", 1, "p", True),
        (1, "d", "not_null", None, 1, "p", True), (2, "a", "equals", "x7", 1, "p", True),
        (2, "b", "not_equals_column", "a", 1, "p", True), (2, "d", "equals", "2024-06-02", 1, "p", True),
        (3, "a", "equals_column", "b", 1, "p", True), (3, "z", "is_null", None, 1, "p", True), (9, "a", "is_null", None, 1, "p", True),
        (3, "b", "near", "1", 1, "p", True),
    )
    columns = ["a", "b", "d"]
    got = {r.slot: (r.a, r.b, r.d) for r in D.apply_overrides(df, "slot", claims, columns).collect()}
    assert got == {1: (1, 1, datetime.date(1970, 1, 1)), 2: (2, 5, datetime.date(2024, 6, 2)), 3: (4, 4, day)}
    found = {(r.row_slot, r.column_name): r.reason for r in D.unapplied_overrides(df, "slot", claims, columns).collect()}
    assert found == {
        (1, "a"): "unknown_operand", (1, "b"): "not_satisfied", (2, "a"): "bad_literal", (3, "z"): "unknown_column",
        (9, "a"): "unknown_row", (3, "b"): "unknown_relation",
    }


def test_deep_hierarchy(rows):
    chain = rows("id int, up int", (0, None), *[(i, i - 1) for i in range(1, 70)])
    got = dict(hierarchy_reach(chain, "id", "up", "up is null").collect())
    assert got == {i: i for i in range(70)}


def test_one_hint_per_case_in_one_language(rows):
    packages = rows("case_id int, verdict string, primary_rule string, witness string", (1, "INCORRECT", "R", None), (2, "CORRECT", None, None))
    schema = "language string, rule_id string, kind string, message string"
    texts = rows(schema, *[(lang, "R", "LOCATION", f"{lang}{i}") for lang in ("en", "zh") for i in (2, 1)])
    for language, extra in (("en", "en1"), ("zh", "zh1"), ("fr", "The results differ; no single rule explains it.")):
        got = {r.case_id: r.message for r in hint_slot(packages, 1, texts, language).collect()}
        assert got == {1: extra, 2: "No difference was found on the data."}
    assert hint_slot(packages, 1, texts.where("language = 'zh'").drop("language")).count() == 2


def test_expected_sets_rules_and_witnesses(rows):
    results = rows(
        "id int, status string, conclusion string, verdict string, primary_rule string, primary_grade string, repair_fixed int, "
        "hint_safe boolean, executed boolean, replay_ok boolean, has_evidence boolean, table_rows int, has_database boolean, distinguished boolean",
        (1, "A", None, "V", None, None, 0, True, False, True, True, 1, True, None), (2, None, None, "W", None, None, 0, True, False, True, True, 1, None, True),
        (3, "A", None, "V", None, None, 0, True, False, True, True, 1, None, None),
    )
    expected = rows(
        "id int, allowed_statuses array<string>, allowed_verdicts array<string>, candidate_rule string, require_witness boolean",
        (1, ["A", "B"], ["W"], "R1", True), (2, ["A"], ["V", "W"], "R1", True), (3, None, None, None, None),
    )
    candidates = rows("id int, rule_id string", (1, "R1"), (1, "R1"), (2, "R2"), (2, None), (3, "R1"))
    got = sorted(tuple(row) for row in A.check_expectations(results, expected, candidates=candidates).collect())
    assert got == [
        (1, "allowed_verdicts:actual=V"), (1, "witness_not_distinguished"), (2, "allowed_statuses:actual=None"),
        (2, "candidate_rule_missing:R1"), (2, "witness_database_missing"),
    ]
    none = sorted(row.failure for row in A.check_expectations(results, expected).collect() if row.failure.startswith("candidate"))
    assert none == ["candidate_rule_missing:R1"] * 2


def test_witness_availability(rows):
    cases = rows(
        "case_id int, has_primary boolean, incorrect boolean",
        *[(i, True, True) for i in range(1, 7)], (7, False, True), (8, False, False), (9, None, None), (10, True, True),
    )
    effects = rows(
        "case_id int, diff_id string, world_id string, causal boolean, distinguished boolean, constraints_satisfied boolean, "
        "n_baseline bigint, n_candidate bigint",
        (1, "b", "w", True, True, None, 5, 6), (1, "a", "v", False, True, True, 1, 2), (2, "a", "v", True, True, True, 1, 2),
        (3, "a", None, None, True, None, 1, 2), (4, "a", "w", False, True, False, 1, 2), (5, "a", "w", True, True, True, 1, 2),
        (6, None, "", None, True, True, 3, 4), (7, "a", "w", True, True, True, 1, 2), (99, "a", "w", True, True, True, 1, 2),
    )
    worlds = rows("case_id int, world_id string", (1, "w"), (2, "w"), (5, "w"), (6, "w"))
    claims = rows(
        "case_id int, table_name string, row_index int, n_rows int",
        (1, "t", 0, 1), (1, "t", 1, 1), (2, "t", 0, 1), (5, "t", -1, 9), (5, None, 0, 9), (5, "t", None, 9), (6, "t", 0, 1),
    )
    got = {
        row.case_id: (row.availability, row.reason, row.world_id, row.diff_id, row.n_linked)
        for row in D.witness_availability(cases, effects, worlds, claims).collect()
    }
    assert got == {
        1: ("CAUSAL_VERIFIED", None, "w", "b", 1), 2: ("OUTPUT_ONLY", "other_world", None, "a", 0),
        3: ("PAIR_DISTINGUISHED", "no_claims", None, "a", 0), 4: ("OUTPUT_ONLY", "no_claims", None, "a", 0),
        5: ("OUTPUT_ONLY", "no_such_row", None, "a", 0), 6: ("PAIR_DISTINGUISHED", None, "w", None, 1),
        7: ("OUTPUT_ONLY", "no_primary", None, None, 0), 8: (None, "no_primary", None, None, 0),
        9: (None, "no_primary", None, None, 0), 10: ("OUTPUT_ONLY", "no_claims", None, None, 0),
    }


def test_witness_totals(rows):
    df = rows("path string, k int", *[("a", i) for i in range(9)], (None, 1), (None, 2))
    got = {(row.path, row.k, row.n) for row in D.witness_sample(df, "path", ["k"], 2, total="n").collect()}
    assert got == {("a", 0, 9), ("a", 1, 9), (None, 1, 2), (None, 2, 2)}


def test_unscoped_candidates(rows):
    diffs = rows("case_id int, rule_id string", (1, "S2_AGGREGATE_IN_WHERE"), (2, "S2_BOUNDARY"))
    cases = rows("case_id int, aggregate_in_where boolean", (1, True), (2, True), (2, True), (3, False), (4, None), (5, True))
    got = {row.case_id: (row.n_diffs, row.evidence_grade, row.blocking) for row in unscoped_candidates(diffs, cases).collect()}
    assert got == {2: (0, "OUTPUT_ONLY", False), 5: (0, "OUTPUT_ONLY", False)}


def test_lines_stay_dealt_by_order_until_they_are_graded(spark):
    from querydelta.registry import evidence
    from querydelta.session import _SHARED_KEYS
    from querydelta.sources.tables import Tables

    settings = {_SHARED_KEYS: "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        plan = evidence._graded(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    # the lines of the diffs, the effects and the mutations, and the orders; no join deals rows again
    assert plan.count("Exchange ") == 4


def test_catalog_documents_are_dealt_before_they_are_parsed(spark):
    from querydelta.sources import catalogs

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        raw = spark.range(200).coalesce(1).selectExpr("id as doc_id", """'{"t": ["a", "b"]}' as json""")
        documents = catalogs._documents(raw)
        assert len(documents.inputFiles()) > 1
        assert catalogs.catalog_tables(raw).count() == 200
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def _moved(frame, spark):
    """How often the plan of ``frame`` deals rows again, with no broadcast joins."""
    from querydelta.session import _SHARED_KEYS

    settings = {_SHARED_KEYS: "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        return frame()._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_build_candidates_has_the_findings_without_diffs(spark, rows, tmp_path):
    import duckdb

    from querydelta.registry import load
    from tools.check_oracle import compare

    # parts 9, 13 and 30: a null comparison, an aggregate in WHERE, and a changed WHERE, which a signal raises
    rows(
        "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string",
        *[(order, 1, part, 1, 1.0, 0.0, 0.0, "A", "F") for order, part in ((1, 9), (2, 13), (3, 30), (6, 9))],
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    rows(
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string",
        *[(order, 1, "F", "3-MEDIUM") for order in (1, 2, 3, 4, 4)], (5, 1, "F", "5-LOW"), (6, 1, "F", "5-LOW"),
    ).write.parquet(f"{tmp_path}/orders.parquet")
    item = load()["build_candidates"]
    found = sorted((row.case_id, row.rule_id, row.scope_id, row.n_diffs) for row in item.run(spark, str(tmp_path)).collect())
    alone = ("S2_AGGREGATE_IN_WHERE", "unscoped:signal:aggregate-in-where", 0)
    assert found == [
        (1, *alone), (1, "S2_NULL_LOGIC", "root", 1), (2, "S2_AGGREGATE_IN_WHERE", "root", 1),
        (3, "S2_AGGREGATE_IN_WHERE", "root", 1), (3, "S2_ROW_FILTER_MISMATCH", "root", 1),
        (4, *alone), (6, "S2_NULL_LOGIC", "root", 1),
    ]
    con = duckdb.connect()
    for name in ("lineitem", "orders"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    ok, message = compare(spark, con, item, str(tmp_path))
    assert ok, message


def test_candidates_and_members_stay_dealt_by_case(spark):
    from querydelta.operators import evidence as E
    from querydelta.registry import evidence as R
    from querydelta.sources.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    lines, parts = R._dealt_lines(t)
    detected = R._detected(t, lines, parts)
    assert _moved(lambda: R._graded(t, lines), spark) == 1  # the orders
    assert _moved(lambda: E.build_candidates(detected), spark) == 0
    assert _moved(lambda: E.candidate_members(detected, E.build_candidates(detected)), spark) == 0
    assert not [table.name for table in spark.catalog.listTables() if table.name.startswith("querydelta_")]


def test_diagnosis_dealt_by_case_agrees_with_the_one_dealt_by_all_keys(spark):
    from querydelta.plans.diagnosis import diagnose
    from querydelta.registry import evidence as R
    from querydelta.sources.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    lines, parts = R._dealt_lines(t)
    rest = R._distinguished(t), R._nullable(t), R._deps(lines), R._cases(t), R._scope_ranks(t)
    tables = R._described(R._keyed(lines)), R._effects(lines), R._mutations(lines), *rest
    ranked = [
        diagnose(*tables, parts=given).ranked.select("case_id", "candidate_id", "place", "role", "cause_candidate_id")
        for given in (parts, None)
    ]
    assert sorted(map(repr, ranked[0].collect())) == sorted(map(repr, ranked[1].collect())) != []


def test_scope_order_writes_one_shrinking_table_per_level(spark, rows, monkeypatch):
    from querydelta.operators import evidence as E

    nodes = rows("case_id int, scope_id string, scope_kind string", *[(1, f"s{i:02}", "CTE") for i in range(20)], (2, "a", "ROOT"), (2, "b", "CTE"))
    edges = rows(
        "case_id int, source_scope_id string, target_scope_id string", *[(1, f"s{i:02}", f"s{i + 1:02}") for i in range(19)],
        (2, "a", "b"), (2, "b", "a"),
    )
    sizes, write = [], E.durable

    def counted(df, *more):
        written = write(df, *more)
        sizes.append(written.count())
        return written

    monkeypatch.setattr(E, "durable", counted)
    got = {(r.case_id, r.scope_id): (r.scope_rank, r.level, r.partial) for r in E.scope_order(nodes, edges).collect()}
    assert got == {(1, f"s{i:02}"): (i + 1, i, False) for i in range(20)} | {(2, "a"): (1, None, True), (2, "b"): (2, None, True)}
    assert len(sizes) <= 2 + 20 + 3
    assert sum(sizes) < 20 * 20


def test_scopes_are_not_dealt_by_the_few_columns_of_their_tables(spark):
    from querydelta.operators.constraints import unresolved_references

    scopes = spark.range(1000).selectExpr("id as scope_id", "'a' as alias", "concat('t', id % 2) as table_name")
    refs = spark.range(1000).selectExpr("id as scope_id", "id as ref_id", "if(id % 2 = 0, 'a', null) as qualifier", "if(id < 990, 'x0', 'y') as column_name")
    # as many rows as no broadcast would take, but two columns
    columns = spark.range(2_000_000).selectExpr("concat('t', id % 2) as table_name", "concat('x', id % 1) as column_name")
    found = unresolved_references(refs, scopes, columns)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(table_name" not in plan
    assert {(row.ref_id, row.status) for row in found.collect()} == {(n, "missing") for n in range(990, 1000)}


def test_a_text_shares_the_runs_of_passages_in_it():
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(list("ab é日🙂"), n)) for n in (0, 3, 9, 40, 400, 3000)] + ["a" * 500]
    octets, bounds = octets_of(pa.array(texts))
    for size in SIZES:
        # parts shorter than most texts give the same runs
        whole = {int(run) for _, runs in byte_runs(octets, bounds, size) for run in runs}
        assert whole == {int(run) for _, runs in byte_runs(octets, bounds, size, part_bytes=50) for run in runs}
    for text in texts:
        for _ in range(40):
            start = int(rng.integers(0, len(text) + 1))
            passage = text[start : start + int(rng.integers(8, 200))]
            reached = [size for size in SIZES if size <= len(passage.encode())]
            for size in reached:
                # whatever stands around it, and whichever text comes before it in the column
                alone = set(runs_of_texts(pa.array(["x", passage]), [size])[1].tolist())
                assert alone and alone <= set(runs_of_texts(pa.array(["abab", "x" + text + "y"]), [size])[1].tolist())


def test_leak_search_leaves_no_row_for_other_runs(rows):
    words = ["".join(chr(97 + (i * k) % 26) for k in range(1, 9)) for i in range(2000)]
    docs = rows("doc_id int, text string", *[(i, " ".join(words[i : i + 200])) for i in range(0, 1800, 100)])
    refs = rows("item_id int, text string", (1, words[5] + " " + words[6]), (2, words[1850]), (3, "nowhere at all"))
    passages = refs.selectExpr("item_id", "text", "16 as size", "0L as salt").where("item_id = 1")
    sieve = A._sieve(A._runs(passages, "item_id", [16], True))
    found = A._runs(docs.selectExpr("*", "0L as salt"), "doc_id", [16], False, sieve)
    assert 0 < found.count() < 20 and found.select("doc_id").distinct().collect()[0][0] == 0
    folded = {row.doc_id: row.text for row in docs.collect()}
    want = {(d, r.item_id) for d, text in folded.items() for r in refs.collect() if r.text in text}
    assert {(r.doc_id, r.item_id) for r in A.corpus_leaks(docs, refs).collect()} == want


def test_join_fan_out_in_parts_that_grow_with_its_tables(rows, tiny_groups):
    many = range(60)
    fks = rows(
        "catalog_id int, from_table string, from_columns array<string>, to_table string, to_columns array<string>",
        *[(i, "a", ["r"], "b", ["id"]) for i in many],
    )
    keys = rows("catalog_id int, table_name string, columns array<string>", *[(i, "a", ["r"]) for i in many if i % 2])
    joins = rows(
        "catalog_id int, join_id string, left_table string, left_columns array<string>, right_table string, right_columns array<string>",
        *[(i, "up", "a", ["r"], "b", ["id"]) for i in many], *[(i, "down", "b", ["id", "n"], "a", ["r", "n"]) for i in many],
        *[(i, "other", "b", ["n"], "a", ["n"]) for i in many],
    )
    found = join_fan_out(joins, fks, keys)
    got = {(r.catalog_id, r.join_id): r.at_most_one for r in found.collect()}
    assert got == {
        (i, join): True if join == "up" or join == "down" and i % 2 else False if i % 2 else None
        for i in many for join in ("up", "down", "other")
    }
    # 180 joins in parts of at most half a chunk of three rows
    assert found.rdd.getNumPartitions() == 120
