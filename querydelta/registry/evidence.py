"""Evidence records derived from line items: an order is a case, a line is a diff."""

from __future__ import annotations

from pyspark.sql import functions as F

from querydelta.operators import evidence as E
from querydelta.registry import query
from querydelta.session import dealt, durable, parts_of

# One row per kind of difference; a line picks its kind by its part number.
# diff type, clause, baseline text, candidate text, baseline op, candidate op,
# expected stage, expected teaching stage, expected rule (as SQL on the line).
KINDS = [
    ("comparison_operator_changed", "WHERE", "x >= 5", "x > 5", "GTE", "GT", "ROW_FILTER", "S2", "'S2_BOUNDARY'"),
    ("comparison_operator_changed", "HAVING", "COUNT(*) >= 2", "COUNT(*) > 2", "GTE", "GT", "GROUP_FILTER", "S4", "'S4_AGG_BOUNDARY'"),
    ("comparison_operator_changed", "WHERE", "x = 5", "x <> 5", "EQ", "NEQ", "ROW_FILTER", "S2", "'UNCLASSIFIED_SUPPORTED_DIFF'"),
    ("comparison_operator_changed", "WHERE", "x IN (SELECT y FROM t)", "x = (SELECT y FROM t)", "IN", "EQ", "ROW_FILTER", "S2", "'S1_SUBQUERY_CARDINALITY'"),
    ("join_missing", "JOIN", "JOIN b ON a.i = b.i", "", "", "", "SOURCE_JOIN", "S1",
     "CASE WHEN missing_bridge_signal THEN 'S1_MISSING_BRIDGE' ELSE 'UNCLASSIFIED_SUPPORTED_DIFF' END"),
    ("join_type_changed", "JOIN", "LEFT JOIN b", "JOIN b", "", "", "SOURCE_JOIN", "S1", "'S1_OUTER_JOIN_MISUSE'"),
    ("join_type_changed", "JOIN", "INNER JOIN b", "CROSS JOIN b", "", "", "SOURCE_JOIN", "S1", "'S1_CARTESIAN_PRODUCT'"),
    ("correlated_predicate_changed", "WHERE", "a.x = b.x", "a.y = b.y", "", "", "SOURCE_JOIN", "S1", "'S1_SUBQUERY_CARDINALITY'"),
    ("logical_operator_changed", "WHERE", "p AND q", "p OR q", "", "", "ROW_FILTER", "S2", "'S2_BOOLEAN_LOGIC'"),
    ("null_equality_changed", "WHERE", "x IS NULL", "x = NULL", "", "", "ROW_FILTER", "S2", "'S2_NULL_LOGIC'"),
    ("predicate_missing", "WHERE", "g IS NOT NULL", "", "", "", "ROW_FILTER", "S2", "'S2_NULL_LOGIC'"),
    ("predicate_missing", "WHERE", "x > 3", "", "", "", "ROW_FILTER", "S2", "'S2_ROW_FILTER_MISMATCH'"),
    ("predicate_missing", "HAVING", "COUNT(*) > 1", "", "", "", "GROUP_FILTER", "S4", "'S4_HAVING_MISSING'"),
    ("aggregate_condition_in_where", "WHERE", "", "SUM(x) > 3", "", "", "ROW_FILTER", "S2", "'S2_AGGREGATE_IN_WHERE'"),
    ("grouping_grain_too_coarse", "GROUP BY", "a, b", "a", "", "", "GROUP_AGG", "S3", "'S3_GROUP_KEY_MISSING'"),
    ("grouping_grain_too_fine", "GROUP BY", "a", "a, b", "", "", "GROUP_AGG", "S3", "'S3_GROUP_KEY_REDUNDANT'"),
    ("group_by_changed", "GROUP BY", "a", "b", "", "", "GROUP_AGG", "S3", "'S3_GRAIN_ENTITY_MISMATCH'"),
    ("having_changed", "HAVING", "COUNT(*) > 1", "", "", "", "GROUP_FILTER", "S4", "'S4_HAVING_MISSING'"),
    ("having_changed", "HAVING", "", "x > 3", "", "", "GROUP_FILTER", "S4", "'S4_GROUP_FILTER_MISMATCH'"),
    ("case_else_missing", "CASE", "ELSE 0", "", "", "", "PROJECTION", "S5", "'S5_CASE_INCOMPLETE'"),
    ("distinct_changed", "DISTINCT", "TRUE", "", "", "", "DISTINCT", "S5",
     "CASE WHEN scope_kind = 'ROOT' THEN 'S5_TOP_LEVEL_DEDUP' ELSE 'UNCLASSIFIED_SUPPORTED_DIFF' END"),
    ("aggregate_argument_changed", "SELECT", "COUNT(x)", "COUNT(*)", "", "", "PROJECTION", "S5",
     "CASE WHEN nullable THEN 'S5_COUNT_NULL_SENSITIVITY' ELSE 'UNCLASSIFIED_SUPPORTED_DIFF' END"),
    ("aggregate_distinct_changed", "SELECT", "COUNT(DISTINCT x)", "COUNT(x)", "", "", "PROJECTION", "S5",
     "CASE WHEN fanout_signal THEN 'S5_FANOUT_AGGREGATE' ELSE 'UNCLASSIFIED_SUPPORTED_DIFF' END"),
    ("order_direction_changed", "ORDER BY", "x DESC", "x ASC", "", "", "ROOT_ORDER", "S6", "'S6_ORDER_OFFSET'"),
    ("limit_changed", "LIMIT", "OFFSET 1", "OFFSET 2", "", "", "PAGINATION", "S6", "'S6_ORDER_OFFSET'"),
    ("limit_changed", "LIMIT", "LIMIT 3", "LIMIT 5", "", "", "PAGINATION", "S6", "'S6_RESULT_SHAPING_MISMATCH'"),
    ("top_n_ordering_missing", "ORDER BY", "x DESC", "", "", "", "ROOT_ORDER", "S6", "'S6_TOPN_WITHOUT_ORDER'"),
    ("order_by_tiebreaker_missing", "ORDER BY", "x, y", "x", "", "", "ROOT_ORDER", "S6",
     "CASE WHEN topn_signal THEN 'S6_TOPN_WITHOUT_ORDER' ELSE 'UNCLASSIFIED_SUPPORTED_DIFF' END"),
    ("set_operator_changed", "UNION", "UNION", "UNION ALL", "", "", "SET_OP", "EXTENSION", "'S5_TOP_LEVEL_DEDUP'"),
    ("window_function_changed", "WINDOW", "RANK()", "ROW_NUMBER()", "", "", "WINDOW", "S5", "'UNCLASSIFIED_SUPPORTED_DIFF'"),
    ("where_changed", "WHERE", "x > 3", "", "", "", "ROW_FILTER", "S2", "'S2_ROW_FILTER_MISMATCH'"),
    ("projection_changed", "SELECT", "a", "b", "", "", "PROJECTION", "S5", "'UNCLASSIFIED_SUPPORTED_DIFF'"),
    ("expression_operator_changed", "SELECT", "a", "b", "", "", "PROJECTION", "S5", "'UNCLASSIFIED_SUPPORTED_DIFF'"),
]
_N = len(KINDS)
_FIELDS = ("diff_type", "clause", "baseline_sql", "candidate_sql", "baseline_op", "candidate_op")
_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"

_DIFFS = f"""
  kinds AS (SELECT * FROM (VALUES {', '.join(f"({i}, " + ', '.join(f"'{v}'" for v in kind[:8]) + ')' for i, kind in enumerate(KINDS))})
            k(i, {', '.join(_FIELDS)}, logical_stage, teaching_stage)),
  lines AS (SELECT DISTINCT ON (l_orderkey, l_linenumber, l_partkey, l_suppkey) * FROM lineitem),
  diffs AS (SELECT l_orderkey AS case_id, {_ID} AS diff_id,
      CASE WHEN l_linenumber < 6 THEN 'o' || l_linenumber END AS obligation_id,
      CASE l_returnflag WHEN 'A' THEN 'root' WHEN 'N' THEN 'cte:x' ELSE 'subquery:y' END AS scope_id,
      CASE l_returnflag WHEN 'A' THEN 'ROOT' WHEN 'N' THEN 'CTE' ELSE 'SUBQUERY' END AS scope_kind,
      {', '.join(_FIELDS)}, 'T' || l_suppkey AS target_table, 'C' || l_linenumber AS target_column,
      l_linenumber / 10.0::DOUBLE AS severity, l_suppkey % 2 = 0 AS missing_bridge_signal,
      l_linenumber > 3 AS fanout_signal, l_linestatus = 'O' AS topn_signal,
      l_partkey % {_N} AS kind, logical_stage, teaching_stage, l_linenumber, l_partkey, l_suppkey, l_linestatus
    FROM lines JOIN kinds ON i = l_partkey % {_N})"""


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _lines(t):
    """Each line once, dealt by order, so that what is joined or counted per order (and more) stays where it is."""
    return t.lineitem.repartition("l_orderkey").dropDuplicates(_LINE)


def _dealt_lines(t):
    """``_lines`` written once with all that a query reads of them, and the number of parts by order that they lie in.

    No later step of a query moves lines, diffs or candidates to another order.
    """
    parts = parts_of(t.lineitem)
    read = t.lineitem.select(*_LINE, "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    return dealt(read.repartition(parts, "l_orderkey").dropDuplicates(_LINE), "l_orderkey", parts), parts


def _keyed(lines):
    return lines.withColumns({"case_id": F.col("l_orderkey"), "diff_id": F.expr(_ID)})


def _diffs(t):
    return _described(_keyed(_lines(t)))


def _described(lines, *more):
    """The diffs of ``lines``, row by row; columns ``more`` are kept."""
    rows = ", ".join(f"struct({', '.join(repr(value) for value in kind[:6])})" for kind in KINDS)
    named = f"array<struct<{','.join(f'{name}:string' for name in _FIELDS)}>>"
    kinds = f"element_at(cast(array({rows}) as {named}), cast(l_partkey % {_N} as int) + 1)"
    picked = lines.withColumn("kind", F.expr(kinds))
    return picked.select(
        "case_id", "diff_id",
        F.expr("case when l_linenumber < 6 then concat('o', l_linenumber) end").alias("obligation_id"),
        F.expr("case l_returnflag when 'A' then 'root' when 'N' then 'cte:x' else 'subquery:y' end").alias("scope_id"),
        F.expr("case l_returnflag when 'A' then 'ROOT' when 'N' then 'CTE' else 'SUBQUERY' end").alias("scope_kind"),
        *[F.col(f"kind.{name}") for name in _FIELDS],
        F.concat(F.lit("T"), "l_suppkey").alias("target_table"),
        F.concat(F.lit("C"), "l_linenumber").alias("target_column"),
        (F.col("l_linenumber") / 10.0).alias("severity"),
        (F.col("l_suppkey") % 2 == 0).alias("missing_bridge_signal"),
        (F.col("l_linenumber") > 3).alias("fanout_signal"), (F.col("l_linestatus") == "O").alias("topn_signal"),
        *more,
    )


@query("stable_ids", """
SELECT o_orderkey, 'diff_' || substr(sha256('{"o_custkey":"' || o_custkey || '","o_orderpriority":'
  || CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE '"' || o_orderpriority || '"' END
  || ',"o_orderstatus":"' || o_orderstatus || '"}'), 1, 16) AS stable_id FROM orders""")
def stable_ids(t):
    rows = t.orders.withColumn(
        "o_orderpriority", F.expr("case when o_orderstatus = 'P' then null else o_orderpriority end")
    )
    return E.stable_ids(rows, "diff", ["o_orderstatus", "o_custkey", "o_orderpriority"]).select(
        "o_orderkey", "stable_id"
    )


_STAGES = """CASE logical_stage WHEN 'SOURCE_JOIN' THEN 2 WHEN 'ROW_FILTER' THEN 3 WHEN 'GROUP_AGG' THEN 4 WHEN 'GROUP_FILTER' THEN 5
  WHEN 'WINDOW' THEN 6 WHEN 'PROJECTION' THEN 7 WHEN 'DISTINCT' THEN 8 WHEN 'SET_OP' THEN 9 WHEN 'ROOT_ORDER' THEN 10
  WHEN 'PAGINATION' THEN 11 ELSE 12 END"""


@query("logical_stage", f"""WITH {_DIFFS}
SELECT diff_id, diff_type, logical_stage, teaching_stage, {_STAGES} AS stage_rank FROM diffs""")
def logical_stage(t):
    return E.logical_stage(_diffs(t)).select("diff_id", "diff_type", "logical_stage", "teaching_stage", "stage_rank")


@query("suggested_probes", f"""WITH {_DIFFS}
SELECT diff_type, count(*) AS n, CASE diff_type
    WHEN 'limit_changed' THEN 'limit_reachability' WHEN 'join_missing' THEN 'join_presence_effect'
    WHEN 'set_operator_changed' THEN 'set_op_effect' WHEN 'window_function_changed' THEN 'lag_lead_paths' END AS last_probe
FROM diffs WHERE diff_type IN ('limit_changed', 'join_missing', 'set_operator_changed', 'window_function_changed') GROUP BY 1""")
def suggested_probes(t):
    kinds = ["limit_changed", "join_missing", "set_operator_changed", "window_function_changed"]
    return E.suggested_probes(_diffs(t)).where(F.col("diff_type").isin(kinds)).groupBy("diff_type").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.element_at("probes", -1)).alias("last_probe")
    )


def _effects(lines):
    """Lines of several suppliers were tried; some told the versions apart."""
    return lines.where("l_discount >= 0.03D").select(
        F.col("l_orderkey").alias("case_id"), F.expr(_ID).alias("diff_id"),
        (F.col("l_discount") >= 0.05).alias("distinguished"),
        F.expr("case when l_tax < 0.06D then l_tax < 0.04D end").alias("constraints_satisfied"),
        (F.col("l_discount") >= 0.09).alias("causal_attribution_verified"),
    )


def _mutations(lines):
    this = F.expr(_ID)
    return lines.where("l_tax >= 0.05D").select(
        F.col("l_orderkey").alias("case_id"), F.concat(F.lit("m"), this).alias("mutation_test_id"),
        F.when(F.col("l_quantity") > 40, F.array(this, F.lit("other"))).otherwise(F.array(this, F.lit(""))).alias("diff_ids"),
        F.array("l_returnflag").alias("mutation_scope"),
        F.when(F.col("l_quantity") < 5, F.array(F.lit("GROUP BY"))).otherwise(F.array().cast("array<string>"))
        .alias("dependent_changes"),
        F.when(F.col("l_linestatus") == "O", "EXACT").otherwise("clause").alias("binding_quality"),
        F.lit(True).alias("replacement_exec_ok"), (F.col("l_tax") >= 0.06).alias("fixed_by_replacement"),
    )


def _distinguished(t):
    return t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("case_id"))


_GRADED = f"""{_DIFFS},
  raw AS (SELECT {_ID} AS diff_id, l_discount AS d, l_tax AS x, l_quantity AS q, l_linestatus AS s FROM lines),
  graded AS (SELECT diffs.*, {_STAGES} AS stage_rank,
      CASE WHEN d >= 0.09 THEN 4
           WHEN x >= 0.06 AND q <= 40 AND q >= 5 AND s = 'O' THEN 3
           WHEN d >= 0.05 AND (x >= 0.06 OR x < 0.04) THEN 2
           WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END AS grade_rank
    FROM diffs JOIN raw USING (diff_id) JOIN orders ON o_orderkey = case_id)"""
_GRADE_NAME = "['AST_ONLY', 'OUTPUT_ONLY', 'PAIR_DISTINGUISHED', 'REPAIR_VERIFIED', 'CAUSAL_VERIFIED'][grade_rank + 1]"


def _graded(t, lines=None):
    """Lines are graded before they are described, so the joins move and sort few columns."""
    lines = _lines(t) if lines is None else lines
    graded = E.evidence_grade(_keyed(lines), _effects(lines), _mutations(lines), _distinguished(t))
    return E.logical_stage(_described(graded, "grade_rank", "evidence_grade"))


@query("evidence_grade", f"WITH {_GRADED} SELECT case_id, diff_id, {_GRADE_NAME} AS evidence_grade, grade_rank FROM graded")
def evidence_grade(t):
    return _graded(t).select("case_id", "diff_id", "evidence_grade", "grade_rank")


def _nullable(t):
    return t.lineitem.where("l_quantity > 30").select(
        F.concat(F.lit("t"), "l_suppkey").alias("table_name"), F.concat(F.lit("c"), "l_linenumber").alias("column_name")
    )


_RULE = "CASE kind " + " ".join(f"WHEN {i} THEN {kind[8]}" for i, kind in enumerate(KINDS)) + " END"
_CLASSIFIED = f"""{_GRADED},
  nulls AS (SELECT DISTINCT 't' || l_suppkey AS nt, 'c' || l_linenumber AS nc FROM lineitem WHERE l_quantity > 30),
  classified AS (SELECT g.*, {_RULE.replace('nullable', 'nt IS NOT NULL')} AS rule_id
    FROM graded g LEFT JOIN nulls ON lower(target_table) = nt AND lower(target_column) = nc)"""


def _classified(t, lines=None, parts=None):
    graded = _graded(t, lines)
    return E.classify_rule(graded if parts is None else dealt(graded, "case_id", parts), _nullable(t), parts)


@query("classify_rule", f"WITH {_CLASSIFIED} SELECT case_id, diff_id, diff_type, rule_id FROM classified")
def classify_rule(t):
    return _classified(t).select("case_id", "diff_id", "diff_type", "rule_id")


_SUMMARY = "('projection_changed', 'where_changed', 'group_by_changed', 'having_changed', 'order_by_changed', 'limit_changed')"
_USABLE = f"""{_CLASSIFIED},
  usable AS (SELECT * FROM classified s WHERE NOT (diff_type IN {_SUMMARY} AND EXISTS (
    SELECT 1 FROM classified o WHERE o.case_id = s.case_id AND o.scope_id = s.scope_id AND o.logical_stage = s.logical_stage
      AND o.diff_type NOT IN {_SUMMARY}
      AND ((s.baseline_sql <> '' AND s.candidate_sql <> '' AND s.baseline_sql = o.baseline_sql AND s.candidate_sql = o.candidate_sql)
           OR (s.obligation_id IS NULL AND o.obligation_id IS NOT NULL)))))"""


def _usable(t, lines, parts):
    """Usable diffs with the columns that signals and candidates read, written once."""
    classified = dealt(_classified(t, lines, parts).select(*E.CANDIDATE_COLUMNS, "obligation_id"), "case_id", parts)
    return dealt(E.drop_redundant_summaries(classified).select(*E.CANDIDATE_COLUMNS), "case_id", parts)


@query("drop_redundant_summaries", f"WITH {_USABLE} SELECT case_id, diff_id, diff_type FROM usable")
def drop_redundant_summaries(t):
    return E.drop_redundant_summaries(_classified(t)).select("case_id", "diff_id", "diff_type")


_CASES = """cases AS (SELECT o_orderkey AS case_id, o_orderpriority = '1-URGENT' AS suspected_cartesian,
    o_custkey % 3 - 1 AS duplicate_delta, o_orderpriority = '2-HIGH' AS has_limit, o_orderstatus = 'F' AS has_order,
    o_orderpriority = '3-MEDIUM' AS aggregate_in_where FROM orders)"""


def _cases(t):
    priority = F.col("o_orderpriority")
    return t.orders.select(
        F.col("o_orderkey").alias("case_id"), (priority == "1-URGENT").alias("suspected_cartesian"),
        (F.col("o_custkey") % 3 - 1).alias("duplicate_delta"), (priority == "2-HIGH").alias("has_limit"),
        (F.col("o_orderstatus") == "F").alias("has_order"), (priority == "3-MEDIUM").alias("aggregate_in_where"),
    )


_AGG = "(diff_type LIKE '%aggregate%' OR logical_stage IN ('GROUP_AGG', 'PROJECTION'))"
_SIGNALS = f"""{_USABLE}, {_CASES},
  f AS (SELECT usable.*, cases.* EXCLUDE (case_id) FROM usable JOIN cases USING (case_id)),
  fan AS (SELECT case_id, scope_id FROM f WHERE duplicate_delta > 0 GROUP BY ALL
          HAVING bool_or(logical_stage = 'SOURCE_JOIN') AND bool_or({_AGG})),
  moved AS (SELECT *, baseline_sql || candidate_sql AS cond, diff_type = 'where_changed' AS gone FROM usable
    WHERE (diff_type = 'where_changed' AND baseline_sql <> '' AND candidate_sql = '')
       OR (diff_type = 'having_changed' AND candidate_sql <> '' AND baseline_sql = '')),
  reloc AS (SELECT case_id, scope_id, cond FROM moved GROUP BY ALL HAVING bool_or(gone) AND NOT bool_and(gone)),
  extra AS (
    SELECT case_id, diff_id, scope_id, 'S4_ROW_FILTER_IN_HAVING' AS rule_id, grade_rank FROM moved SEMI JOIN reloc USING (case_id, scope_id, cond)
    UNION ALL SELECT case_id, diff_id, scope_id, 'S1_CARTESIAN_PRODUCT', greatest(grade_rank, 1) FROM f
      WHERE logical_stage = 'SOURCE_JOIN' AND suspected_cartesian
        AND case_id NOT IN (SELECT case_id FROM usable WHERE rule_id = 'S1_CARTESIAN_PRODUCT')
    UNION ALL SELECT case_id, diff_id, scope_id, 'S5_FANOUT_AGGREGATE', grade_rank FROM f SEMI JOIN fan USING (case_id, scope_id)
      WHERE (logical_stage = 'SOURCE_JOIN' OR {_AGG})
        AND case_id NOT IN (SELECT case_id FROM usable WHERE rule_id = 'S5_FANOUT_AGGREGATE')
    UNION ALL SELECT case_id, diff_id, scope_id, 'S6_TOPN_WITHOUT_ORDER', greatest(grade_rank, 1) FROM f
      WHERE has_limit AND NOT has_order AND logical_stage IN ('ROOT_ORDER', 'PAGINATION')
        AND case_id NOT IN (SELECT case_id FROM usable WHERE rule_id = 'S6_TOPN_WITHOUT_ORDER')
    UNION ALL SELECT case_id, diff_id, scope_id, 'S2_AGGREGATE_IN_WHERE', grade_rank FROM f
      WHERE aggregate_in_where AND logical_stage IN ('ROW_FILTER', 'SOURCE_JOIN')
        AND diff_type IN ('where_changed', 'subquery_removed', 'aggregate_condition_in_where')
        AND case_id NOT IN (SELECT case_id FROM usable WHERE rule_id = 'S2_AGGREGATE_IN_WHERE'))"""


@query("signal_diffs", f"WITH {_SIGNALS} SELECT * FROM extra")
def signal_diffs(t):
    raised = E.signal_diffs(_usable(t, *_dealt_lines(t)), _cases(t))
    return durable(raised.select("case_id", "diff_id", "scope_id", "rule_id", "grade_rank"), keep_dealt=True)


_TEACH = "CASE WHEN rule_id LIKE 'S_\\_%' ESCAPE '\\' AND rule_id NOT LIKE '%MISMATCH' OR rule_id = 'S3_GRAIN_ENTITY_MISMATCH' THEN substr(rule_id, 1, 2) END"
_HOME = "CASE own WHEN 'S1' THEN 'SOURCE_JOIN' WHEN 'S2' THEN 'ROW_FILTER' WHEN 'S3' THEN 'GROUP_AGG' WHEN 'S4' THEN 'GROUP_FILTER' WHEN 'S5' THEN 'PROJECTION' ELSE 'ROOT_ORDER' END"
_CANDIDATES = f"""{_SIGNALS},
  everything AS (SELECT case_id, diff_id, scope_id, rule_id, grade_rank FROM usable UNION ALL SELECT * FROM extra),
  detailed AS (SELECT e.*, u.grade_rank AS own_rank, u.severity, u.stage_rank, u.logical_stage, u.teaching_stage FROM everything e JOIN usable u USING (case_id, diff_id)),
  grouped AS (SELECT case_id, scope_id, rule_id, max(grade_rank) AS grade_rank, max(own_rank) AS own_rank, max(severity) AS severity, count(*) AS n_diffs,
      count(*) FILTER (WHERE grade_rank >= 3) AS n_verified, arg_min(logical_stage, (stage_rank, diff_id)) AS first_stage,
      arg_min(teaching_stage, (stage_rank, diff_id)) AS first_teaching, {_TEACH} AS own,
      sum(('0x' || substr(sha256(diff_id), 1, 15))::BIGINT)::DECIMAL(38,0) AS digest
    FROM detailed GROUP BY case_id, scope_id, rule_id),
  staged AS (SELECT *, CASE WHEN own IS NOT NULL AND own <> first_teaching THEN {_HOME} ELSE first_stage END AS logical_stage FROM grouped),
  candidates AS (SELECT case_id, scope_id, rule_id, 'candidate_' || substr(sha256('{{"diff_digest":"' || digest || '","n_diffs":"' || n_diffs
      || '","rule_id":"' || rule_id || '","scope_id":"' || scope_id || '"}}'), 1, 16) AS candidate_id,
      logical_stage, {_STAGES} AS stage_rank, coalesce(own, first_teaching) AS teaching_stage, n_diffs, n_verified,
      {_GRADE_NAME} AS evidence_grade, grade_rank,
      round(least(0.99, 0.42 + 0.42 * own_rank / 4.0 + 0.16 * severity), 4)::DOUBLE AS confidence, severity, grade_rank >= 3 AS blocking
    FROM staged)"""


def _detected(t, lines, parts):
    """Usable diffs and signals, written once: the later steps read them several times."""
    return dealt(E.with_signals(_usable(t, lines, parts), _cases(t)), "case_id", parts)


_UNSCOPED = """
SELECT case_id, 'unscoped:signal:aggregate-in-where' AS scope_id, 'S2_AGGREGATE_IN_WHERE' AS rule_id, 'candidate_' || substr(sha256(
    '{"diff_digest":"0","n_diffs":"0","rule_id":"S2_AGGREGATE_IN_WHERE","scope_id":"unscoped:signal:aggregate-in-where"}'), 1, 16) AS candidate_id,
  'EXTENSION' AS logical_stage, 12 AS stage_rank, 'S2' AS teaching_stage, 0::BIGINT AS n_diffs, 0::BIGINT AS n_verified,
  'OUTPUT_ONLY' AS evidence_grade, 1 AS grade_rank, 0.55::DOUBLE AS confidence, 0.6::DOUBLE AS severity, false AS blocking
FROM cases WHERE aggregate_in_where
  AND case_id NOT IN (SELECT case_id FROM usable WHERE rule_id = 'S2_AGGREGATE_IN_WHERE')
  AND case_id NOT IN (SELECT case_id FROM extra WHERE rule_id = 'S2_AGGREGATE_IN_WHERE')"""


@query("build_candidates", f"""WITH {_CANDIDATES}, unscoped AS ({_UNSCOPED})
SELECT * FROM candidates UNION ALL SELECT DISTINCT * FROM unscoped""")
def build_candidates(t):
    """Every candidate of a case: those with diffs, and the one that rests on its query text alone."""
    detected = _detected(t, *_dealt_lines(t))
    unscoped = E.unscoped_candidates(detected, _cases(t))
    return durable(E.build_candidates(detected).unionByName(unscoped), keep_dealt=True)


@query("unscoped_candidates", f"WITH {_SIGNALS}{_UNSCOPED}")
def unscoped_candidates(t):
    signalled = E.with_signals(_usable(t, *_dealt_lines(t)), _cases(t))
    return durable(E.unscoped_candidates(signalled, _cases(t)), keep_dealt=True)


_MEMBERS = f"""{_CANDIDATES},
  members AS (SELECT case_id, candidate_id, scope_id, rule_id, diff_id, max(d.grade_rank) >= 3 AS verified
    FROM detailed d JOIN candidates USING (case_id, scope_id, rule_id) GROUP BY ALL)"""


@query("candidate_members", f"WITH {_MEMBERS} SELECT * FROM members")
def candidate_members(t):
    detected = _detected(t, *_dealt_lines(t))
    return durable(E.candidate_members(detected, E.build_candidates(detected)), keep_dealt=True)


# Two lines of an order and supplier parity depend on each other.
_DEPS = """deps AS (SELECT DISTINCT a.case_id, a.diff_id AS from_diff_id, b.diff_id AS to_diff_id,
    CASE WHEN a.l_linenumber = 1 THEN 'CAUSES' WHEN a.l_linenumber = 2 THEN 'MASKS' ELSE 'AMPLIFIES' END AS type
  FROM diffs a JOIN diffs b ON a.case_id = b.case_id AND b.l_linenumber = a.l_linenumber + 1)"""


def _deps(lines):
    lines = lines.select(F.col("l_orderkey").alias("case_id"), F.expr(_ID).alias("diff_id"), "l_linenumber")
    later = lines.select("case_id", F.col("diff_id").alias("to_diff_id"), (F.col("l_linenumber") - 1).alias("l_linenumber"))
    kind = F.expr("case l_linenumber when 1 then 'CAUSES' when 2 then 'MASKS' else 'AMPLIFIES' end")
    return lines.join(later, ["case_id", "l_linenumber"]).select(
        "case_id", F.col("diff_id").alias("from_diff_id"), "to_diff_id", kind.alias("type")
    )


_GENERIC = "('UNCLASSIFIED_SUPPORTED_DIFF', 'S2_ROW_FILTER_MISMATCH', 'S4_GROUP_FILTER_MISMATCH', 'S6_RESULT_SHAPING_MISMATCH')"
_EDGES = f"""{_MEMBERS}, {_DEPS},
  sharing AS (SELECT DISTINCT x.case_id, x.candidate_id AS f, y.candidate_id AS t FROM members x
    JOIN members y ON x.case_id = y.case_id AND x.diff_id = y.diff_id AND x.candidate_id <> y.candidate_id),
  pair AS (SELECT p.case_id, p.candidate_id AS f, c.candidate_id AS t, p.rule_id AS pr, c.rule_id AS cr, p.blocking AS pb, c.blocking AS cb,
      p.grade_rank AS pg, c.grade_rank AS cg, p.scope_id = c.scope_id AS same_scope,
      o.f IS NOT NULL AS shared
    FROM candidates p JOIN candidates c ON p.case_id = c.case_id AND p.candidate_id <> c.candidate_id
    LEFT JOIN sharing o ON o.case_id = p.case_id AND o.f = p.candidate_id AND o.t = c.candidate_id),
  edges0 AS (
    SELECT d.case_id, x.candidate_id AS f, y.candidate_id AS t, d.type, d.type IN ('CAUSES', 'MASKS') AND px.blocking AND NOT py.blocking AS suppresses
      FROM deps d JOIN members x ON x.case_id = d.case_id AND x.diff_id = d.from_diff_id
      JOIN members y ON y.case_id = d.case_id AND y.diff_id = d.to_diff_id
      JOIN candidates px ON px.case_id = d.case_id AND px.candidate_id = x.candidate_id
      JOIN candidates py ON py.case_id = d.case_id AND py.candidate_id = y.candidate_id WHERE x.candidate_id <> y.candidate_id
    UNION ALL SELECT case_id, f, t, 'AMPLIFIES', shared AND NOT cb FROM pair
      WHERE same_scope AND pr IN ('S1_MISSING_BRIDGE', 'S1_CARTESIAN_PRODUCT') AND cr = 'S5_FANOUT_AGGREGATE'
    UNION ALL SELECT case_id, f, t, 'CAUSES', true FROM pair WHERE same_scope AND shared
      AND ((pr = 'S6_ORDER_OFFSET' AND cr = 'S6_TOPN_WITHOUT_ORDER') OR (pr LIKE 'S3%' AND cr = 'UNCLASSIFIED_SUPPORTED_DIFF')
           OR (pr NOT IN {_GENERIC} AND cr IN {_GENERIC} AND pg >= cg))),
  edges AS (SELECT case_id, f, t, type, bool_or(suppresses) AS suppresses FROM edges0 GROUP BY ALL)"""


def _with_edges(t):
    lines, parts = _dealt_lines(t)
    detected = _detected(t, lines, parts)
    candidates = dealt(E.build_candidates(detected), "case_id", parts)
    members = dealt(E.candidate_members(detected, candidates), "case_id", parts)
    return candidates, dealt(E.causal_edges(candidates, members, _deps(lines), parts), "case_id", parts)


@query("causal_edges", f"""WITH {_EDGES}
SELECT case_id, f AS from_candidate_id, t AS to_candidate_id, type, suppresses FROM edges""")
def causal_edges(t):
    return _with_edges(t)[1]


_RANKED = f"""{_EDGES},
  placed AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY blocking DESC,
      CASE scope_id WHEN 'subquery:y' THEN 1 WHEN 'root' THEN 2 ELSE 3 END, stage_rank, grade_rank DESC, severity DESC, scope_id, rule_id, candidate_id) AS place
    FROM candidates),
  caused AS (SELECT e.case_id, e.t AS candidate_id, arg_min(e.f, p.place) AS cause_candidate_id FROM edges e
    JOIN placed p ON p.case_id = e.case_id AND p.candidate_id = e.f WHERE e.suppresses GROUP BY ALL),
  joined AS (SELECT placed.*, cause_candidate_id,
      min(place) FILTER (WHERE blocking AND cause_candidate_id IS NULL) OVER (PARTITION BY case_id) AS first_place
    FROM placed LEFT JOIN caused USING (case_id, candidate_id)),
  ranked AS (SELECT *, CASE WHEN cause_candidate_id IS NOT NULL THEN 'suppressed' WHEN NOT blocking THEN 'unresolved'
      WHEN place = first_place THEN 'primary' ELSE 'secondary' END AS role FROM joined)"""


def _scope_ranks(t):
    ranks = F.explode(F.array(
        F.struct(F.lit("subquery:y").alias("scope_id"), F.lit(1).alias("scope_rank")),
        F.struct(F.lit("root").alias("scope_id"), F.lit(2).alias("scope_rank")),
    ))
    return t.orders.select(F.col("o_orderkey").alias("case_id"), ranks.alias("s")).select("case_id", "s.*")


@query("rank_candidates", f"""WITH {_RANKED}
SELECT case_id, candidate_id, rule_id, place, role, cause_candidate_id FROM ranked""")
def rank_candidates(t):
    candidates, edges = _with_edges(t)
    return durable(E.rank_candidates(candidates, _scope_ranks(t), edges, dealt_by_case=True).select(
        "case_id", "candidate_id", "rule_id", "place", "role", "cause_candidate_id"
    ), keep_dealt=True)


# Lines are scopes: a line feeds the next line number, lines 6 and 7 of some orders feed each other.
_SCOPES = """n AS (SELECT DISTINCT l_orderkey AS case_id, 's' || l_linenumber AS scope_id, l_linenumber AS i FROM lineitem),
  e AS (SELECT a.case_id, a.i AS a, b.i AS b FROM n a JOIN n b ON a.case_id = b.case_id AND (b.i = a.i + 1 OR b.i = a.i + 3)
        UNION ALL SELECT a.case_id, a.i, b.i FROM n a JOIN n b ON a.case_id = b.case_id AND a.i = 7 AND b.i = 6)"""


@query("scope_order", f"""WITH RECURSIVE {_SCOPES},
  bad AS (SELECT DISTINCT case_id FROM n WHERE i IN (6, 7) GROUP BY 1 HAVING count(DISTINCT i) = 2),
  walk AS (SELECT case_id, i, 0 AS level FROM n UNION ALL
           SELECT e.case_id, e.b, level + 1 FROM walk JOIN e ON e.case_id = walk.case_id AND e.a = walk.i WHERE level < 7 AND e.b > e.a),
  lv AS (SELECT case_id, i, max(level) AS level FROM walk GROUP BY ALL),
  k AS (SELECT lv.case_id, i, bad.case_id IS NOT NULL AS partial,
               CASE WHEN bad.case_id IS NOT NULL AND i >= 6 THEN NULL ELSE level END AS level FROM lv LEFT JOIN bad USING (case_id))
SELECT case_id, 's' || i AS scope_id, row_number() OVER (PARTITION BY case_id ORDER BY coalesce(level, 99),
         CASE WHEN i = 1 THEN 0 WHEN i < 5 THEN 1 ELSE 3 END, i) AS scope_rank, level, partial FROM k""")
def scope_order(t):
    parts = parts_of(t.lineitem)
    read = t.lineitem.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("i"))
    lines = dealt(read.repartition(parts, "case_id").distinct(), "case_id", parts)
    nodes = lines.select(
        "case_id", F.concat(F.lit("s"), "i").alias("scope_id"),
        F.expr("case when i = 1 then 'ROOT' when i < 5 then 'CTE' else 'SUBQUERY' end").alias("scope_kind"),
    )
    steps = F.explode(F.expr("case when i = 7 then array(10, 8, 6) else array(i + 1, i + 3) end"))
    edges = lines.select(
        "case_id", F.concat(F.lit("s"), "i").alias("source_scope_id"),
        steps.alias("next"),
    ).select("case_id", "source_scope_id", F.concat(F.lit("s"), "next").alias("target_scope_id"))
    return durable(E.scope_order(nodes, edges, parts), keep_dealt=True)


_RUNS = """runs AS (SELECT o_orderkey AS case_id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'SUPPORTED' WHEN '2-HIGH' THEN 'supported_with_limits' WHEN '3-MEDIUM' THEN 'KNOWN_GAP' ELSE 'SUPPORTED' END AS status,
    CASE o_orderstatus WHEN 'F' THEN 'NOT_EQUIVALENT' WHEN 'O' THEN 'NO_COUNTEREXAMPLE_FOUND' END AS conclusion,
    CASE WHEN o_totalprice > 450000 THEN 'TIMEOUT' WHEN o_orderstatus = 'F' THEN 'WRONG' WHEN o_orderstatus = 'O' THEN 'CORRECT' END AS judge_status,
    o_totalprice > 50000 AS executed, o_custkey % 7 = 0 AS has_boundary, o_custkey % 11 = 0 AS has_guard FROM orders)"""


def _runs(t):
    return t.orders.select(
        F.col("o_orderkey").alias("case_id"),
        F.expr("""case o_orderpriority when '1-URGENT' then 'SUPPORTED' when '2-HIGH' then 'supported_with_limits'
                  when '3-MEDIUM' then 'KNOWN_GAP' else 'SUPPORTED' end""").alias("status"),
        F.expr("case o_orderstatus when 'F' then 'NOT_EQUIVALENT' when 'O' then 'NO_COUNTEREXAMPLE_FOUND' end").alias("conclusion"),
        F.expr("""case when o_totalprice > 450000 then 'TIMEOUT' when o_orderstatus = 'F' then 'WRONG'
                  when o_orderstatus = 'O' then 'CORRECT' end""").alias("judge_status"),
        (F.col("o_totalprice") > 50000).alias("executed"),
        (F.col("o_custkey") % 7 == 0).alias("has_boundary"), (F.col("o_custkey") % 11 == 0).alias("has_guard"),
    )


_VERDICTS = f"""{_RUNS}, verdicts AS (SELECT *, CASE
    WHEN conclusion = 'NOT_EQUIVALENT' AND upper(status) LIKE 'SUPPORTED%' AND judge_status = 'WRONG' THEN 'INCORRECT'
    WHEN conclusion = 'NO_COUNTEREXAMPLE_FOUND' AND upper(status) LIKE 'SUPPORTED%' AND judge_status = 'CORRECT'
         AND executed AND NOT has_boundary AND NOT has_guard THEN 'CORRECT' ELSE 'UNDECIDED' END AS verdict FROM runs)"""


@query("project_verdict", f"""WITH {_VERDICTS}
SELECT case_id, verdict, CASE WHEN verdict = 'UNDECIDED' THEN 'UNDECIDED' ELSE judge_status END AS final_judge,
  CASE judge_status WHEN 'TIMEOUT' THEN 'ENGINE_GAP' WHEN 'WRONG' THEN 'SUPPORTED' WHEN 'CORRECT' THEN 'ENGINE_GAP' ELSE 'KNOWN_GAP' END AS failure_status,
  CASE judge_status WHEN 'WRONG' THEN 'NOT_EQUIVALENT' ELSE 'UNDECIDED' END AS failure_conclusion,
  coalesce(status = 'SUPPORTED' AND conclusion = 'NOT_EQUIVALENT' AND judge_status = 'WRONG', false) AS teachable
FROM verdicts""")
def project_verdict(t):
    return E.project_verdict(_runs(t)).select(
        "case_id", "verdict", "final_judge", "failure_status", "failure_conclusion", "teachable"
    )


def _effect_tables(t):
    """Suppliers of an order are its obligations; each line is one test of one."""
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("case_id"), F.concat(F.lit("ob"), "l_suppkey").alias("obligation_id"), "l_suppkey",
        F.concat(F.lit("w"), "l_linenumber").alias("world_id"), "l_discount", "l_tax", "l_quantity",
    )
    obligations = lines.select("case_id", "obligation_id", F.concat(F.lit("d"), "l_suppkey").alias("diff_id")).distinct()
    tests = lines.where("l_quantity > 5").select(
        "case_id", "obligation_id", "world_id", (F.col("l_quantity") > 10).alias("attempted"),
        (F.col("l_discount") >= 0.05).alias("distinguished"),
    )
    validations = lines.where("l_tax > 0.01D").select(
        "case_id", "obligation_id", (F.col("l_tax") > 0.04).alias("constraints_satisfied")
    )
    return obligations, tests, validations


_EFFECTS = """eff AS (SELECT l_orderkey AS case_id, 'ob' || l_suppkey AS obligation_id, 'd' || l_suppkey AS diff_id,
    coalesce(bool_or(l_quantity > 10) FILTER (WHERE l_quantity > 5), false) AS activated,
    coalesce(bool_or(l_discount >= 0.05) FILTER (WHERE l_quantity > 5), false) AS distinguished,
    bool_or(l_tax > 0.04) FILTER (WHERE l_tax > 0.01) AS constraints_satisfied,
    min('w' || l_linenumber) FILTER (WHERE l_quantity > 5 AND l_discount >= 0.05) AS world_id
  FROM lineitem GROUP BY ALL), ok AS (SELECT *, distinguished AND coalesce(constraints_satisfied, false) AS causal_attribution_verified FROM eff)"""


@query("obligation_effectiveness", f"WITH {_EFFECTS} SELECT * FROM ok")
def obligation_effectiveness(t):
    return E.obligation_effectiveness(*_effect_tables(t))


@query("case_effectiveness", f"""WITH {_EFFECTS}
SELECT case_id, count(*) AS n_obligations, bool_or(activated) AS any_activated, bool_or(distinguished) AS any_distinguished,
       bool_or(causal_attribution_verified) AS any_obligation_distinguished FROM ok GROUP BY 1""")
def case_effectiveness(t):
    return E.case_effectiveness(E.obligation_effectiveness(*_effect_tables(t)))


def _packages(t):
    rule = F.expr("""case o_orderpriority when '1-URGENT' then 'S2_BOUNDARY' when '2-HIGH' then 'S5_CASE_INCOMPLETE'
                     when '3-MEDIUM' then 'UNCLASSIFIED_SUPPORTED_DIFF' end""")
    return E.project_verdict(_runs(t)).join(
        t.orders.select(F.col("o_orderkey").alias("case_id"), rule.alias("primary_rule"),
                        F.concat(F.lit("row "), "o_custkey").alias("witness")), "case_id"
    ).select("case_id", "verdict", "primary_rule", "witness")


def _hint_sql(level, kind, boundary, case, witness):
    return f"""WITH {_VERDICTS}
SELECT case_id, {level} AS level, '{kind}' AS kind,
  CASE WHEN verdict = 'INCORRECT' AND o_orderpriority = '1-URGENT' THEN '{boundary}'
       WHEN verdict = 'INCORRECT' AND o_orderpriority = '2-HIGH' THEN '{case}'
       WHEN verdict = 'CORRECT' THEN 'No difference was found on the data.'
       WHEN verdict = 'UNDECIDED' THEN 'The evidence does not settle this case.'
       ELSE 'The results differ; no single rule explains it.' END AS message, {witness} AS witness
FROM verdicts JOIN orders ON o_orderkey = case_id"""


@query("hint_location", _hint_sql(
    1, "LOCATION", "The row filter treats its limit value differently.", "A CASE leaves inputs without a result.", "NULL::VARCHAR"))
def hint_location(t):
    return E.hint_slot(_packages(t), 1)


@query("hint_witness", _hint_sql(
    2, "WITNESS", "These rows show the difference.", "These rows show the difference.", "'row ' || o_custkey"))
def hint_witness(t):
    return E.hint_slot(_packages(t), 2)


@query("hint_reflection", _hint_sql(
    3, "REFLECTION", "Does the limit itself belong to the result?", "What happens when no branch applies?", "NULL::VARCHAR"))
def hint_reflection(t):
    return E.hint_slot(_packages(t), 3)
