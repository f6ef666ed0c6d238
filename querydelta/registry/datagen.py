"""Seeded tables, boundary values, perturbations and witness samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from querydelta.operators import datagen as D
from querydelta.operators.predicates import predicate_divergence
from querydelta.registry import query


@query("seed_table", """
WITH s AS (SELECT o_orderkey AS i, (SELECT count(*) FROM part) AS n FROM orders)
SELECT i + 1 AS s_id, ['Alice', 'Bob', 'Carol', 'Dave'][i % 4 + 1] AS s_name, DATE '2024-01-01' + (i % 9)::INT AS enrolled_date,
       ['A', 'B', 'C', NULL][i % 4 + 1] AS grade, ['Fall', 'Spring', 'Summer', 'Winter'][i % 4 + 1] AS semester,
       (i + 1)::DOUBLE AS score, 'comment_' || (i + 1) AS comment, 'POINT(' || i || ' ' || i || ')' AS location,
       i % n + 1 AS part_id FROM s""")
def seed_table(t):
    return D.seed_table(
        t.orders.select(F.col("o_orderkey").alias("id")),
        {
            "s_id": "INTEGER", "s_name": "VARCHAR(80)", "enrolled_date": "DATE", "grade": "TEXT", "semester": "TEXT",
            "score": "REAL", "comment": "TEXT", "location": "TEXT", "part_id": "INTEGER",
        },
        {"part_id": t.part},
    )


# Every part is one predicate: its type decides the operator, its size the literal.
_OPS = {"ECONOMY": ">", "STANDARD": ">=", "PROMO": "<", "MEDIUM": "<=", "LARGE": "=", "SMALL": "BETWEEN"}


@query("boundary_rows", f"""
WITH s AS (SELECT p_brand AS table_name, p_name AS column_name, p_size AS v,
                  CASE p_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _OPS.items())} END AS op FROM part),
  l AS (SELECT s.*, label FROM s, (VALUES ('literal'), ('below'), ('above'), ('match'), ('miss'), ('null')) x(label))
SELECT table_name, column_name, op, v::VARCHAR AS value, label,
  (CASE label WHEN 'literal' THEN v WHEN 'below' THEN v - 1 WHEN 'above' THEN v + 1
    WHEN 'match' THEN CASE op WHEN '>' THEN v + 1 WHEN '<' THEN v - 1 ELSE v END
    WHEN 'miss' THEN CASE op WHEN '>' THEN v WHEN '<' THEN v WHEN '>=' THEN v - 1 WHEN '<=' THEN v + 1
                     WHEN '=' THEN v + 1 ELSE v + 6 END END)::VARCHAR AS probe FROM l""")
def boundary_rows(t):
    ops = F.create_map(*[F.lit(x) for pair in _OPS.items() for x in pair])
    specs = t.part.select(
        F.col("p_brand").alias("table_name"), F.col("p_name").alias("column_name"), ops[F.col("p_type")].alias("op"),
        F.col("p_size").cast("string").alias("value"), (F.col("p_size") + 5).cast("string").alias("high"),
        F.lit(None).cast("array<string>").alias("members"),
    )
    return D.boundary_rows(specs)


@query("boundary_text_rows", """
WITH s AS (SELECT DISTINCT p_brand AS table_name, p_name AS v, p_type AS w FROM part),
  o AS (SELECT table_name, 'IN' AS op, v AS value, v AS match, 'not_' || v AS miss FROM s
        UNION ALL SELECT table_name, 'LIKE', '%' || v || '_', 'a' || v || 'a', 'not_' || v FROM s
        UNION ALL SELECT table_name, 'IS NULL', v, NULL, 'not_null' FROM s)
SELECT table_name, 'p_name' AS column_name, op, value, label,
       CASE label WHEN 'match' THEN match WHEN 'miss' THEN miss END AS probe
FROM o, (VALUES ('match'), ('miss'), ('null')) x(label)""")
def boundary_text_rows(t):
    parts = t.part.select("p_brand", "p_name", "p_type").distinct()
    specs = parts.select(
        F.col("p_brand").alias("table_name"), F.lit("p_name").alias("column_name"),
        F.explode(
            F.array(
                F.struct(F.lit("IN").alias("op"), F.col("p_name").alias("value")),
                F.struct(F.lit("LIKE").alias("op"), F.concat(F.lit("%"), "p_name", F.lit("_")).alias("value")),
                F.struct(F.lit("IS NULL").alias("op"), F.col("p_name").alias("value")),
            )
        ).alias("s"),
        F.array("p_name", "p_type").alias("members"),
    )
    return D.boundary_rows(
        specs.select(
            "table_name", "column_name", "s.op", "s.value", F.lit(None).cast("string").alias("high"), "members"
        )
    )


# Orders claim the columns of their customer: NULL balance, another segment.
_CLAIMS = """claims AS (
  SELECT o_custkey AS row_slot, 'c_mktsegment' AS column_name, 'equals' AS relation, o_orderpriority AS value,
         o_totalprice AS priority, o_orderkey::VARCHAR AS owner, o_orderstatus = 'F' AS locked FROM orders
  UNION ALL
  SELECT o_custkey, 'c_acctbal', CASE WHEN o_orderstatus = 'P' THEN 'is_null' ELSE 'not_null' END, NULL,
         o_totalprice, o_orderkey::VARCHAR, o_orderstatus = 'F' FROM orders WHERE o_totalprice > 300000)"""


def _claims(t):
    common = [
        F.col("o_totalprice").alias("priority"), F.col("o_orderkey").cast("string").alias("owner"),
        (F.col("o_orderstatus") == "F").alias("locked"),
    ]
    segment = t.orders.select(
        F.col("o_custkey").alias("row_slot"), F.lit("c_mktsegment").alias("column_name"),
        F.lit("equals").alias("relation"), F.col("o_orderpriority").alias("value"), *common,
    )
    balance = t.orders.where("o_totalprice > 300000").select(
        F.col("o_custkey").alias("row_slot"), F.lit("c_acctbal").alias("column_name"),
        F.when(F.col("o_orderstatus") == "P", "is_null").otherwise("not_null").alias("relation"),
        F.lit(None).cast("string").alias("value"), *common,
    )
    return segment.unionAll(balance)


@query("apply_overrides", f"""WITH {_CLAIMS},
  w AS (SELECT row_slot, column_name, relation, value FROM claims
        QUALIFY row_number() OVER (PARTITION BY row_slot, column_name ORDER BY priority DESC, owner) = 1)
SELECT c_custkey, c_name, c_nationkey, CASE WHEN b.relation = 'is_null' THEN NULL ELSE c_acctbal END AS c_acctbal,
       coalesce(s.value, c_mktsegment) AS c_mktsegment
FROM customer LEFT JOIN w s ON s.row_slot = c_custkey AND s.column_name = 'c_mktsegment'
LEFT JOIN w b ON b.row_slot = c_custkey AND b.column_name = 'c_acctbal'""")
def apply_overrides(t):
    return D.apply_overrides(t.customer, "c_custkey", _claims(t), ["c_acctbal", "c_mktsegment"])


@query("override_conflicts", f"""WITH {_CLAIMS}
SELECT row_slot, column_name, count(*) AS n_claims FROM claims WHERE locked GROUP BY 1, 2
HAVING count(DISTINCT relation) > 1 OR count(DISTINCT value) > 1""")
def override_conflicts(t):
    return D.override_conflicts(_claims(t))


_DIVERGENT = """d AS (SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_quantity::BIGINT AS quantity,
    CASE WHEN l_quantity > 45 AND l_linestatus = 'F' THEN 'baseline_only' ELSE 'candidate_only' END AS direction
  FROM lineitem WHERE (l_quantity > 45 AND l_linestatus = 'F') <> (l_quantity > 46))"""
_KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]


def _divergent(t):
    rows = t.lineitem.select("l_returnflag", *_KEYS, "l_quantity", "l_linestatus")
    return predicate_divergence(rows, "l_quantity > 45 and l_linestatus = 'F'", "l_quantity > 46").select(
        "l_returnflag", *_KEYS, F.col("l_quantity").cast("bigint").alias("quantity"), "direction"
    )


_SAMPLE = """s AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY l_orderkey, l_linenumber, l_partkey, quantity) AS rank
  FROM d QUALIFY rank <= 6)"""


@query("witness_sample", f"WITH {_DIVERGENT}, {_SAMPLE} SELECT * FROM s")
def witness_sample(t):
    return D.witness_sample(_divergent(t), "direction", [*_KEYS, "quantity"])


@query("witness_sample_cases", f"""WITH {_DIVERGENT},
  c AS (SELECT DISTINCT direction, l_returnflag FROM d),
  k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY direction ORDER BY l_returnflag) <= 2)
SELECT d.*, row_number() OVER (PARTITION BY direction, l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, quantity) AS rank
FROM d SEMI JOIN k USING (direction, l_returnflag) QUALIFY rank <= 3""")
def witness_sample_cases(t):
    return D.witness_sample(_divergent(t), "l_returnflag", [*_KEYS, "quantity"], 3, diff="direction")


@query("witness_sample_totals", f"""WITH {_DIVERGENT}, {_SAMPLE}
SELECT s.*, (SELECT count(*) FROM d WHERE d.direction = s.direction) AS n_divergent FROM s""")
def witness_sample_totals(t):
    return D.witness_sample(_divergent(t), "direction", [*_KEYS, "quantity"], total="n_divergent")


# A case is an order, an effect one of its lines in the world of its supplier; claims name lines of a table of 40 rows.
@query("witness_availability", """
WITH c AS (SELECT o_orderkey AS case_id, o_orderpriority <> '5-LOW' AS has_primary, o_orderstatus = 'F' AS incorrect,
    CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'w1' ELSE 'w0' END AS selected FROM orders),
  e AS (SELECT l_orderkey AS case_id, 'd' || l_linenumber AS diff_id, 'w' || l_suppkey % 2 AS world_id, l_returnflag = 'R' AS causal,
      l_quantity > 25 AS distinguished, l_discount <> 0.05 AS holds, l_partkey AS n_baseline, l_suppkey AS n_candidate FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_quantity > 25 THEN 1 ELSE 2 END,
      l_linenumber, l_suppkey % 2, causal, distinguished, holds, l_partkey, l_suppkey) = 1),
  k AS (SELECT l_orderkey AS case_id, count(*) AS n_claims, count(*) FILTER (WHERE l_partkey % 50 < 40) AS n_rows FROM lineitem
    WHERE l_linestatus = 'F' GROUP BY 1),
  r AS (SELECT *, CASE WHEN NOT has_primary THEN 'no_primary' WHEN world_id <> selected THEN 'other_world'
      WHEN coalesce(n_claims, 0) = 0 THEN 'no_claims' WHEN n_rows = 0 THEN 'no_such_row' END AS reason
    FROM c LEFT JOIN e USING (case_id) LEFT JOIN k USING (case_id))
SELECT case_id, reason,
  CASE WHEN NOT has_primary THEN CASE WHEN incorrect THEN 'OUTPUT_ONLY' END
    WHEN reason IS NULL THEN CASE WHEN causal THEN 'CAUSAL_VERIFIED' ELSE 'PAIR_DISTINGUISHED' END
    WHEN reason = 'no_claims' AND distinguished AND holds THEN 'PAIR_DISTINGUISHED' ELSE 'OUTPUT_ONLY' END AS availability,
  CASE WHEN reason IS NULL THEN coalesce(selected, world_id) END AS world_id, CASE WHEN has_primary THEN diff_id END AS diff_id,
  CASE WHEN reason IS NULL THEN n_rows ELSE 0 END AS n_linked, CASE WHEN has_primary THEN n_baseline END AS n_baseline,
  CASE WHEN has_primary THEN n_candidate END AS n_candidate FROM r""")
def witness_availability(t):
    case, line = F.col("o_orderkey").alias("case_id"), F.col("l_orderkey").alias("case_id")
    cases = t.orders.select(
        case, (F.col("o_orderpriority") != "5-LOW").alias("has_primary"), (F.col("o_orderstatus") == "F").alias("incorrect")
    )
    turn = F.col("o_custkey") % 4
    worlds = t.orders.select(case, F.when(turn == 1, "w1").when(turn > 1, "w0").alias("world_id"))
    effects = t.lineitem.select(
        line, F.concat(F.lit("d"), "l_linenumber").alias("diff_id"), F.concat(F.lit("w"), F.col("l_suppkey") % 2).alias("world_id"),
        (F.col("l_returnflag") == "R").alias("causal"), (F.col("l_quantity") > 25).alias("distinguished"),
        (F.col("l_discount") != 0.05).alias("constraints_satisfied"), F.col("l_partkey").alias("n_baseline"),
        F.col("l_suppkey").alias("n_candidate"),
    )
    claims = t.lineitem.where("l_linestatus = 'F'").select(
        line, F.lit("part").alias("table_name"), (F.col("l_partkey") % 50).alias("row_index"), F.lit(40).alias("n_rows")
    )
    return D.witness_availability(cases, effects, worlds, claims)


@query("witness_cells", f"""WITH {_DIVERGENT}, {_SAMPLE},
  c AS (SELECT direction, rank, unnest(['l_orderkey', 'l_linenumber', 'l_returnflag', 'l_partkey', 'quantity']) AS "column",
               unnest([l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_returnflag, l_partkey::VARCHAR, quantity::VARCHAR]) AS value,
               unnest([1, 2, 3, 4, 5]) + 5 * (rank - 1) AS cell FROM s)
SELECT direction, rank, cell, "column", value FROM c WHERE cell <= 8""")
def witness_cells(t):
    sample = D.witness_sample(_divergent(t), "direction", [*_KEYS, "quantity"])
    return D.witness_cells(sample, "direction", ["l_orderkey", "l_linenumber"])


@query("witness_delta", f"WITH {_DIVERGENT} SELECT direction, count(*) AS n FROM d GROUP BY 1")
def witness_delta(t):
    return D.witness_delta(_divergent(t), "direction")


_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


@query("repair_duplicate_keys", f"""
WITH n AS (SELECT l_orderkey, {_ORDER}, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS c FROM lineitem)
SELECT l_orderkey, {_ORDER}, (SELECT max(l_orderkey) FROM lineitem)
       + row_number() OVER (ORDER BY l_orderkey, {_ORDER}) AS new_key
FROM n WHERE c > 1""")
def repair_duplicate_keys(t):
    order = _ORDER.split(", ")
    _, mapping = D.repair_duplicate_keys(t.lineitem.select("l_orderkey", *order), "l_orderkey", order)
    return mapping


@query("repaired_keys", f"""
SELECT count(*) AS n_rows, count(*) AS n_keys, 0::BIGINT AS n_below, (SELECT max(l_orderkey) FROM lineitem)
       + count(*) - count(DISTINCT l_orderkey) AS max_key FROM lineitem""")
def repaired_keys(t):
    order = _ORDER.split(", ")
    repaired, _ = D.repair_duplicate_keys(t.lineitem.select("l_orderkey", *order), "l_orderkey", order)
    return repaired.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("new_key").alias("n_keys"),
        F.count_if(F.col("new_key") < F.col("l_orderkey")).alias("n_below"), F.max("new_key").alias("max_key"),
    )


@query("append_duplicates", """
SELECT * FROM supplier UNION ALL SELECT * FROM supplier WHERE s_acctbal > 8000""")
def append_duplicates(t):
    return D.append_duplicates(t.supplier, "s_acctbal > 8000")


@query("add_dangling", """
SELECT * FROM customer
UNION ALL SELECT c_custkey + (SELECT max(c_custkey) + 1 FROM customer), c_name, c_nationkey, c_acctbal, c_mktsegment
FROM customer WHERE c_mktsegment = 'BUILDING'""")
def add_dangling(t):
    return D.add_dangling(t.customer, "c_custkey", "c_mktsegment = 'BUILDING'")


@query("inject_nulls", """
SELECT o_orderkey, CASE WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE o_custkey END AS o_custkey, o_orderpriority FROM orders""")
def inject_nulls(t):
    return D.inject_nulls(
        t.orders.select("o_orderkey", "o_custkey", "o_orderpriority"), "o_custkey", "o_orderpriority = '2-HIGH'"
    )
