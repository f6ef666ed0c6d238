from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from querydelta.operators import constraints as K
from querydelta.operators import datagen as D
from querydelta.operators import hierarchy as H
from querydelta.sources import catalogs as G
from tests.conftest import table


def test_hierarchy_paths(rows):
    employee = rows("id int, boss int", (1, None), (2, 1), (3, 2), (4, 99))
    assert table(H.hierarchy_paths(employee, "id", "boss"), "path", "n") == {"root": 1, "child": 2, "orphan": 1}


def test_reach_survives_cycles(rows):
    nodes = rows("id int, up int", (1, None), (2, 1), (3, 2), (4, 5), (5, 4), (3, 1))
    got = table(H.hierarchy_reach(nodes, "id", "up", "up is null"), "id", "depth")
    assert got == {1: 0, 2: 1, 3: 1, 4: None, 5: None}
    effect = table(H.recursion_effect(H.hierarchy_reach(nodes, "id", "up", "up is null")), "path", "n")
    assert effect == {"root": 1, "one_level": 2, "recursive_only": 0, "unreached": 2}


def test_reach_does_not_cut_deep_hierarchies(rows):
    chain = rows("id int, up int", (0, None), *[(i, i - 1) for i in range(1, 12)])
    assert table(H.hierarchy_reach(chain, "id", "up", "up is null", max_depth=11), "id", "depth")[11] == 11
    with pytest.raises(ValueError):
        H.hierarchy_reach(chain, "id", "up", "up is null", max_depth=5)


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    chain = spark.range(10_000).selectExpr("id", "case when id > 0 then id - 1 end as up")
    rounds = []
    monkeypatch.setattr(H, "durable", lambda df, write=H.durable: rounds.append(1) or write(df))
    got = H.hierarchy_reach(chain, "id", "up", "up is null")
    assert got.where("depth <> id or depth is null").isEmpty() and got.count() == 10_000
    assert len(rounds) <= 22
    edges = chain.where("up is not null")
    paths = H.path_multiplicity(edges.unionAll(edges.where("id in (5, 77)")), "up", "id", spark.range(1).toDF("up"))
    wrong = paths.where("first_depth <> node or last_depth <> node or n_paths <> 1 + int(node >= 5) + 2 * int(node >= 77)")
    assert wrong.isEmpty() and paths.count() == 10_000


def test_reach_along_the_shortest_way(rows):
    # chains of different length that meet, a cycle behind the start, and one that nothing leads to
    up = [(0, None), (1, 0), (2, 1), (3, 2), (4, 3), (4, 0), (5, 4), (6, 5), (2, 6), (7, 8), (8, 7), (9, 8), (10, 99)]
    got = table(H.hierarchy_reach(rows("id int, up int", *up), "id", "up", "up is null"), "id", "depth")
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 1, 5: 2, 6: 3, 7: None, 8: None, 9: None, 10: None}


def test_diamond(rows):
    edges = rows("a int, b int", (1, 2), (1, 3), (2, 4), (3, 4), (4, 1))
    got = table(H.path_multiplicity(edges, "a", "b", rows("a int", (1,)), 3), "node", "n_paths", "union_all_differs")
    assert got == {1: (3, True), 2: (1, False), 3: (1, False), 4: (2, True)}


def test_paths_of_any_length(rows):
    chain = rows("a int, b int", *[(n, n + 1) for n in range(40)], (0, 2), (0, 2))
    got = table(H.path_multiplicity(chain, "a", "b", rows("a int", (0,))), "node", "n_paths", "first_depth", "last_depth")
    assert len(got) == 41 and got[1] == (1, 1, 1) and got[40] == (3, 39, 40)
    ring = rows("a int, b int", (1, 2), (2, 3), (3, 4), (4, 2), (4, 5), (1, 6), (1, 6), (8, 9), (9, 8), (9, 6))
    got = table(H.path_multiplicity(ring, "a", "b", rows("a int", (1,))), "node", "n_paths", "first_depth", "last_depth",
                "union_all_differs")
    assert got == {
        1: (1, 0, 0, False), 6: (2, 1, 1, True), 2: (None, 1, None, True), 3: (None, 2, None, True),
        4: (None, 3, None, True), 5: (None, 4, None, True),
    }


def test_join_paths_of_any_length(rows):
    names = "abcdefghijkl"
    fks = rows("catalog_id int, from_table string, from_columns array<string>, to_table string, to_columns array<string>",
               *[(1, x, ["id"], y, ["id"]) for x, y in zip(names, names[1:], strict=False)])
    asks = rows("catalog_id int, source string, target string", (1, "a", "g"), (1, "a", "l"), (1, "l", "a"), (1, "a", "z"))
    found = {(r.source, r.target): (r.path, r.hops) for r in K.join_paths(fks, asks).collect()}
    assert found == {
        ("a", "g"): ("a>b>c>d>e>f>g", 6), ("a", "l"): (">".join(names), 11), ("l", "a"): (">".join(reversed(names)), 11),
        ("a", "z"): (None, None),
    }


def test_constraints(rows):
    child = rows("id int, parent int, x int", (1, 1, None), (1, 9, 2), (None, None, 3), (2, 9, 4))
    got = table(
        K.check_constraints(child, ["x"], {"pk": ["id"]}, {"up": (["parent"], rows("k int", (1,)), ["k"])}),
        "constraint", "n_violations", "n_keys", "satisfied",
    )
    assert got == {"not_null:x": (1, 1, False), "unique:pk": (1, 1, False), "foreign_key:up": (2, 1, False)}
    clean = K.check_constraints(child.limit(0), ["x"], {"pk": ["id"]})
    assert all(r.satisfied for r in clean.collect())


FKS = "catalog_id int, from_table string, from_columns array<string>, to_table string, to_columns array<string>"


def test_cardinality_bridges_and_paths(rows):
    fks = rows(
        FKS, (1, "takes", ["s_id"], "student", ["s_id"]), (1, "takes", ["c_id"], "course", ["c_id"]),
        (1, "course", ["d"], "department", ["d"]), (1, "badge", ["s_id"], "student", ["s_id"]),
        (1, "student", ["mentor"], "student", ["s_id"]),
    )
    keys = rows(
        "catalog_id int, table_name string, columns array<string>",
        (1, "student", ["s_id"]), (1, "takes", ["s_id", "c_id"]), (1, "badge", ["s_id"]),
    )
    got = {(r.left_table, r.right_table): (r.cardinality, r.may_fan_out)
           for r in K.declared_cardinality(fks, keys).collect()}
    assert got[("takes", "student")] == ("MANY_TO_ONE", False)
    assert got[("student", "takes")] == ("ONE_TO_MANY", True)
    assert got[("badge", "student")] == ("ONE_TO_ONE", False) == got[("student", "badge")]
    assert got[("student", "student")] == ("MANY_TO_ONE", False)
    asks = rows("catalog_id int, source string, target string", (1, "student", "course"), (1, "student", "department"),
                (1, "badge", "department"), (1, "student", "nowhere"), (1, "course", "course"))
    assert {(r.source, r.target, r.bridge) for r in K.bridge_tables(fks, asks).collect()} == {
        ("student", "course", "takes"), ("course", "course", "takes")
    }
    paths = {(r.source, r.target): (r.path, r.hops) for r in K.join_paths(fks, asks).collect()}
    assert paths == {
        ("student", "course"): ("student>takes>course", 2),
        ("student", "department"): ("student>takes>course>department", 3),
        ("badge", "department"): ("badge>student>takes>course>department", 4),
        ("student", "nowhere"): (None, None), ("course", "course"): ("course", 0),
    }
    short = K.join_paths(fks, asks.where("source = 'badge'"), max_hops=3).first()
    assert short.path is None
    refs = rows("catalog_id int, table_name string, columns array<string>", (1, "takes", ["s_id"]),
                (1, "takes", ["c_id", "s_id", "x"]), (1, "course", ["c_id"]))
    known = {(r.table_name, len(r["columns"])): r.identifies for r in K.uniquely_identified(refs, keys).collect()}
    assert known == {("takes", 1): False, ("takes", 3): True, ("course", 1): None}


def test_references(rows):
    columns = rows("table_name string, column_name string", ("s", "id"), ("t", "id"), ("t", "grade"))
    scopes = rows("scope_id int, alias string, table_name string", (1, "a", "s"), (1, "b", "t"))
    refs = rows("scope_id int, ref_id int, qualifier string, column_name string", (1, 1, None, "id"),
                (1, 2, None, "grade"), (1, 3, "a", "grade"), (1, 4, "z", "id"), (1, 5, None, "name"), (1, 6, "b", "id"))
    assert table(K.unresolved_references(refs, scopes, columns), "ref_id", "status") == {
        1: "ambiguous", 3: "missing", 4: "unknown_qualifier", 5: "missing"
    }


def _documents(rows, *bodies):
    return rows("doc_id int, json string", *[
        (i, body if isinstance(body, str) else json.dumps(body)) for i, body in enumerate(bodies)
    ])


def test_catalog_list_form(rows):
    raw = _documents(rows, {"schema": {"tables": [
        {"name": "student", "columns": [{"name": "s_id", "type": "INTEGER", "not_null": True, "primary_key": True},
                                        {"name": "name", "data_type": "varchar(80)", "nullable": False}]},
        {"name": "takes", "columns": ["s_id", {"name": "grade", "type": "money"}],
         "unique_constraints": [["s_id", "GRADE"], ["nope"]],
         "foreign_keys": [{"column": "s_id", "references_table": "STUDENT", "references_column": "S_ID"},
                          {"column": "s_id", "references_table": "gone", "references_column": "x"},
                          {"column": "zzz", "references_table": "student", "references_column": "s_id"}]},
    ]}})
    columns = {(r.table_name, r.column_name): (r.data_type, r.nullable, r.primary_key)
               for r in G.catalog_columns(raw).collect()}
    assert columns == {
        ("student", "s_id"): ("INTEGER", False, True), ("student", "name"): ("VARCHAR(80)", False, False),
        ("takes", "s_id"): (None, None, False), ("takes", "grade"): (None, None, False),
    }
    keys = {(r.table_name, r.kind, tuple(r["columns"])) for r in G.catalog_keys(raw).collect()}
    assert keys == {("student", "primary", ("s_id",)), ("takes", "unique", ("s_id", "grade"))}
    fks = [(r.from_table, r.from_columns, r.to_table, r.to_columns) for r in G.catalog_foreign_keys(raw).collect()]
    assert fks == [("takes", ["s_id"], "student", ["s_id"])]
    assert {r.limitation for r in G.catalog_limitations(raw).collect()} == {
        "INVALID_COLUMN_TYPE_DROPPED", "INVALID_UNIQUE_CONSTRAINT_DROPPED", "UNRESOLVED_FOREIGN_KEY_DROPPED",
        "INVALID_FOREIGN_KEY_DROPPED",
    }


def test_catalog_other_forms_and_bad_input(rows):
    raw = _documents(
        rows, {"a": ["x", "y"], "b": ["x"]},
        {"table_names_original": ["p", "q"], "column_names_original": [[-1, "*"], [0, "id"], [1, "p_id"]],
         "column_types": ["text", "number", "number"], "primary_keys": [1], "foreign_keys": [[2, 1]]},
        "{broken", {"tables": [{"name": "t", "columns": ["a", "A"]}]},
        {"tables": [{"name": "t", "columns": ["a"]}, {"name": "T", "columns": ["b"]}]},
        {"tables": [{"name": "x; drop", "columns": ["a"]}, {"name": "ok", "columns": ["a"]}]},
    )
    tables = {(r.doc_id, r.table_name): r.confidence for r in G.catalog_tables(raw).collect()}
    assert tables == {
        (0, "a"): "STRUCTURE_ONLY", (0, "b"): "STRUCTURE_ONLY", (1, "p"): "DECLARED", (1, "q"): "DECLARED",
        (5, "ok"): "STRUCTURE_ONLY",
    }
    codes = {}
    for r in G.catalog_limitations(raw).collect():
        codes.setdefault(r.doc_id, set()).add(r.limitation)
    plain = "CONSTRAINTS_AND_TYPES_UNKNOWN"
    assert codes == {
        0: {plain}, 2: {"SCHEMA_JSON_INVALID"}, 3: {"INVALID_OR_DUPLICATE_COLUMN"}, 4: {"DUPLICATE_TABLE"},
        5: {"INVALID_TABLE_STRUCTURE", plain},
    }


def test_every_dropped_thing_is_a_row(rows):
    raw = _documents(
        rows,
        {"tables": [
            {"name": "ok", "columns": [{"name": "a", "type": "money"}], "primary_key": ["b"],
             "foreign_keys": [{"column": "a", "references_table": "gone", "references_column": "x"}]},
            "no table", 7, {"name": "select_a_from_b", "columns": ["a"]},
        ]},
        "{broken", [1, 2], "12", {}, {"x": 1}, {"drop_table": ["a"]}, {"tables": ["a"]}, {"tables": [{"name": "t", "columns": []}]},
        {"tables": [{"name": "t", "columns": ["a"]}, {"name": "T", "columns": ["b"]}]},
        {"t": ["selected", "from_here", "update_set_at"], "updates": ["a"]},
    ).unionAll(rows("doc_id int, json string", (99, None)))
    got = {}
    for r in G.catalog_rejects(raw).collect():
        got.setdefault(r.doc_id, []).append((r.level, r.item, r.code))
    refused = {1: "SCHEMA_JSON_INVALID", 2: "SCHEMA_INPUT_UNSUPPORTED", 3: "SCHEMA_INPUT_UNSUPPORTED", 4: "SCHEMA_TABLES_MISSING",
               5: "SCHEMA_TABLES_MISSING", 6: "SCHEMA_TABLES_MISSING", 99: "SCHEMA_INPUT_UNSUPPORTED"}
    assert sorted(got.pop(0)) == [
        ("column", "ok.a", "INVALID_COLUMN_TYPE_DROPPED"), ("foreign_key", "ok.a", "UNRESOLVED_FOREIGN_KEY_DROPPED"),
        ("key", "ok", "INVALID_PRIMARY_KEY_DROPPED"), ("table", "7", "INVALID_TABLE_DROPPED"),
        ("table", "no table", "INVALID_TABLE_DROPPED"), ("table", "select_a_from_b", "INVALID_TABLE_STRUCTURE"),
    ]
    assert {doc: got.pop(doc) for doc in refused} == {doc: [("catalog", None, code)] for doc, code in refused.items()}
    assert sorted(got.pop(7), key=str) == [("catalog", None, "SCHEMA_TABLES_UNUSABLE"), ("table", "a", "INVALID_TABLE_DROPPED")]
    assert sorted(got.pop(8), key=str) == [("catalog", None, "SCHEMA_TABLES_UNUSABLE"), ("table", "t", "INVALID_TABLE_STRUCTURE")]
    assert got.pop(9) == [("catalog", None, "DUPLICATE_TABLE")]
    assert got.pop(10) == [("table", "t", "INVALID_OR_DUPLICATE_COLUMN")] and not got
    codes = {(r.doc_id, r.limitation) for r in G.catalog_limitations(raw).collect()}
    assert set(refused.items()) <= codes and (0, "INVALID_TABLE_DROPPED") in codes


def test_seed_and_perturb(spark, rows):
    ids = spark.range(20)
    parent = spark.range(7)
    seeded = D.seed_table(ids, {"id": "INTEGER", "dept_name": "TEXT", "grade": "TEXT", "parent_id": "INTEGER"},
                          {"parent_id": parent})
    assert seeded.select("id").distinct().count() == 20
    keys = seeded.select("parent_id").distinct()
    assert keys.join(D.seed_table(parent, {"id": "INTEGER"}), F.col("parent_id") == F.col("id")).count() == 7
    assert D.append_duplicates(seeded, D.hash_share(["id"], 4)).count() > 20
    nulls = D.inject_nulls(seeded, "parent_id", "id <= 5")
    assert nulls.where("parent_id is null").count() == 5
    dangling = D.add_dangling(seeded, "id", "id = 1")
    assert dangling.count() == 21 and dangling.agg(F.max("id")).first()[0] == 22


def test_overrides(rows):
    df = rows("slot int, a int, b int, s string", (1, 1, 10, "x"), (2, 2, None, None), (3, 3, 30, "z"))
    claims = rows(
        "row_slot int, column_name string, relation string, value string, priority int, owner string, locked boolean",
        (1, "a", "equals", "7", 1, "p", True), (1, "a", "equals", "8", 2, "q", True),
        (2, "b", "not_null", None, 1, "p", True), (2, "s", "not_null", None, 1, "p", True),
        (3, "b", "equals_column", "a", 1, "p", True), (3, "s", "is_null", None, 1, "p", False),
        (3, "s", "equals", "y", 0, "q", True),
    )
    got = table(D.apply_overrides(df, "slot", claims, ["a", "b", "s"]), "slot", "a", "b", "s")
    assert got == {1: (8, 10, "x"), 2: (2, 0, ""), 3: (3, 3, None)}
    assert {(r.row_slot, r.column_name) for r in D.override_conflicts(claims).collect()} == {(1, "a")}


def test_boundary_rows(rows):
    schema = "table_name string, column_name string, op string, value string, high string, members array<string>"
    specs = rows(schema, ("t", "c", ">=", "1.50", None, None), ("t", "n", "IN", None, None, ["3", "11"]),
                 ("t", "d", "BETWEEN", "5", "9", None), ("t", "s", "=", "abc", None, None))
    got = {(r.column_name, r.label): r.probe for r in D.boundary_rows(specs).collect()}
    assert (got["c", "below"], got["c", "literal"], got["c", "miss"]) == ("0.5", "1.5", "0.5")
    assert (got["n", "match"], got["n", "miss"]) == ("3", "12")
    assert (got["d", "match"], got["d", "miss"]) == ("5", "10")
    assert (got["s", "match"], got["s", "miss"], got["s", "below"]) == ("abc", "not_abc", "abc__below")
    assert all(got[name, "null"] is None for name in "cnds")
