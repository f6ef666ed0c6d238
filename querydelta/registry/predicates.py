"""Predicate and projection probes on line items, orders and parts.

The tables hold no NULLs; ``nullable`` expressions derive some, the same way
in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from querydelta.operators import predicates as P
from querydelta.registry import query

NULLABLE_DISCOUNT = "CASE WHEN l_linenumber = 4 THEN NULL ELSE l_discount END"
NULLABLE_TAX = "CASE WHEN l_linenumber IN (4, 5) THEN NULL ELSE l_tax END"


def long_sql(row_sql: str, label: str, paths: dict[str, dict[str, str]]) -> str:
    """One SELECT per path over a one-row subquery."""
    parts = []
    for path, values in paths.items():
        columns = ", ".join(f"{sql} AS {alias}" for alias, sql in values.items())
        parts.append(f"SELECT '{path}' AS {label}, {columns} FROM r")
    return f"WITH r AS ({row_sql}) " + " UNION ALL ".join(parts)


def tally_sql(source: str, paths: dict[str, str], divergent: str | None = None) -> str:
    columns, entries = [], {}
    for index, (path, condition) in enumerate(paths.items()):
        columns.append(f"count(*) FILTER (WHERE {condition}) AS n{index}")
        entries[path] = {"n": f"n{index}"}
        if divergent:
            columns.append(f"count(*) FILTER (WHERE ({condition}) AND ({divergent})) AS d{index}")
            entries[path]["n_divergent"] = f"d{index}"
        entries[path]["satisfied"] = f"n{index} > 0"
    return long_sql(f"SELECT {', '.join(columns)} FROM {source}", "path", entries)


def divergent_sql(a: str, b: str) -> str:
    return f"coalesce({a}, false) <> coalesce({b}, false)"


_P = f"({NULLABLE_DISCOUNT}) >= 0.05"


@query("truth_profile", tally_sql("lineitem", {"TRUE": _P, "FALSE": f"NOT ({_P})", "UNKNOWN": f"({_P}) IS NULL"}))
def truth_profile(t):
    return P.truth_profile(t.lineitem, f"({NULLABLE_DISCOUNT}) >= 0.05D")


@query("predicate_divergence", """
SELECT l_orderkey, l_linenumber, l_discount, l_returnflag,
       CASE WHEN l_quantity > 45 AND l_returnflag = 'R' THEN 'baseline_only' ELSE 'candidate_only' END AS direction
FROM lineitem WHERE (l_quantity > 45 AND l_returnflag = 'R') <> (l_quantity > 45 OR l_returnflag = 'R')""")
def predicate_divergence(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_discount", "l_returnflag", "l_quantity")
    return P.predicate_divergence(
        rows, "l_quantity > 45 and l_returnflag = 'R'", "l_quantity > 45 or l_returnflag = 'R'"
    ).drop("l_quantity")


def _counts_sql(source, a, b):
    a, b = f"coalesce({a}, false)", f"coalesce({b}, false)"
    return tally_sql(source, {
        "both": f"{a} AND {b}", "neither": f"NOT {a} AND NOT {b}",
        "baseline_only": f"{a} AND NOT {b}", "candidate_only": f"{b} AND NOT {a}"})


@query("divergence_counts", _counts_sql("lineitem", "l_discount >= 0.05", "l_discount > 0.05"))
def divergence_counts(t):
    return P.divergence_counts(t.lineitem, "l_discount >= 0.05D", "l_discount > 0.05D")


@query("predicate_missing", _counts_sql("lineitem", f"({NULLABLE_DISCOUNT}) < 0.07", "true"))
def predicate_missing(t):
    return P.divergence_counts(t.lineitem, f"({NULLABLE_DISCOUNT}) < 0.07D", None)


@query("expression_comparison", _counts_sql(
    "orders", "2 * o_totalprice + 1000 > 400000", "2 * o_totalprice - 1000 > 400000"))
def expression_comparison(t):
    return P.divergence_counts(
        t.orders, "2 * o_totalprice + 1000 > 400000", "2 * o_totalprice - 1000 > 400000"
    )


@query("between_expansion", _counts_sql(
    "lineitem", "l_quantity BETWEEN 10 AND 20", "l_quantity >= 10 AND l_quantity <= 20"))
def between_expansion(t):
    return P.divergence_counts(
        t.lineitem, "l_quantity between 10 and 20", "l_quantity >= 10 and l_quantity <= 20"
    )


_LEAF = "substr(CASE WHEN {0} THEN 'TRUE' WHEN NOT ({0}) THEN 'FALSE' ELSE 'UNKNOWN' END, 1, 1)"
_L1, _L2 = "l_quantity > 45", f"({NULLABLE_TAX}) >= 0.03"


@query("boolean_truth_table", f"""
WITH g AS (
  SELECT concat_ws('|', {_LEAF.format(_L1)}, {_LEAF.format(_L2)}) AS assignment, count(*) AS n,
         count(*) FILTER (WHERE {divergent_sql(f'({_L1}) AND ({_L2})', f'({_L1}) OR ({_L2})')}) AS n_divergent
  FROM lineitem GROUP BY 1)
SELECT *, (SELECT count(*) FROM g WHERE assignment NOT LIKE '%U%') = 4 AS full_binary_truth_table FROM g""")
def boolean_truth_table(t):
    leaves = ["l_quantity > 45", f"({NULLABLE_TAX}) >= 0.03D"]
    return P.boolean_truth_table(
        t.lineitem, leaves, f"({leaves[0]}) and ({leaves[1]})", f"({leaves[0]}) or ({leaves[1]})"
    )


_PRECEDENCE = ("l_returnflag = 'R'", "l_linestatus = 'O'", "l_quantity > 40")


@query("boolean_precedence", f"""
WITH g AS (
  SELECT concat_ws('|', {', '.join(_LEAF.format(leaf) for leaf in _PRECEDENCE)}) AS assignment, count(*) AS n,
         count(*) FILTER (WHERE ({_PRECEDENCE[0]} OR {_PRECEDENCE[1]} AND {_PRECEDENCE[2]})
                             <> (({_PRECEDENCE[0]} OR {_PRECEDENCE[1]}) AND {_PRECEDENCE[2]})) AS n_divergent
  FROM lineitem GROUP BY 1)
SELECT *, (SELECT count(*) FROM g WHERE assignment NOT LIKE '%U%') = 8 AS full_binary_truth_table FROM g""")
def boolean_precedence(t):
    a, b, c = _PRECEDENCE
    return P.boolean_truth_table(t.lineitem, [a, b, c], f"{a} or {b} and {c}", f"({a} or {b}) and {c}")


def _boundary_sql(source, cell, value, op_a, op_b, moved=None):
    moved = moved or value
    return tally_sql(
        source,
        {"below": f"{cell} < {value}", "at": f"{cell} = {value}", "above": f"{cell} > {value}",
         "null": f"({cell}) IS NULL"},
        divergent_sql(f"({cell}) {op_a} {value}", f"({cell}) {op_b} {moved}"))


@query("boundary_tristate", _boundary_sql("lineitem", "l_discount", "0.05", ">=", ">"))
def boundary_tristate(t):
    return P.boundary_tristate(t.lineitem, "l_discount", 0.05, ">=", ">")


@query("boundary_date", _boundary_sql("lineitem", "l_shipdate", "TIMESTAMP '1998-09-02'", "<=", "<"))
def boundary_date(t):
    bound = F.lit("1998-09-02").cast("timestamp_ntz")
    return P.boundary_tristate(t.lineitem, "l_shipdate", bound, "<=", "<")


@query("boundary_text", _boundary_sql("part", "p_brand", "'Brand#20'", ">=", ">"))
def boundary_text(t):
    return P.boundary_tristate(t.part, "p_brand", "Brand#20", ">=", ">")


@query("boundary_literal_shift", _boundary_sql("lineitem", f"({NULLABLE_DISCOUNT})", "0.05", ">=", ">=", "0.07"))
def boundary_literal_shift(t):
    return P.boundary_tristate(t.lineitem, NULLABLE_DISCOUNT, 0.05, ">=", ">=", 0.07)


_PRIORITY = "CASE WHEN o_orderstatus = 'P' AND o_totalprice > 400000 THEN NULL ELSE o_orderpriority END"


def _in_list_sql(negate_b):
    a = "p IN ('1-URGENT', '2-HIGH')"
    b = "p IN ('1-URGENT', '3-MEDIUM')"
    kept_b = f"NOT ({b})" if negate_b else b
    return f"""
WITH s AS (SELECT {_PRIORITY} AS p FROM orders)
SELECT CASE WHEN p IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN p END AS value,
       CASE WHEN p IS NULL THEN 'null' WHEN {a} AND {b} THEN 'both' WHEN {a} THEN 'baseline_only'
            WHEN {b} THEN 'candidate_only' ELSE 'outside' END AS path,
       count(*) AS n, count(*) FILTER (WHERE {divergent_sql(a, kept_b)}) AS n_divergent
FROM s GROUP BY 1, 2"""


@query("in_list_paths", _in_list_sql(False))
def in_list_paths(t):
    return P.in_list_paths(t.orders, _PRIORITY, ["1-URGENT", "2-HIGH"], ["1-URGENT", "3-MEDIUM"])


@query("in_list_negation", _in_list_sql(True))
def in_list_negation(t):
    return P.in_list_paths(
        t.orders, _PRIORITY, ["1-URGENT", "2-HIGH"], ["1-URGENT", "3-MEDIUM"], negated_candidate=True
    )


def _separation_sql(source, a, b):
    a, b = f"coalesce({a}, false)", f"coalesce({b}, false)"
    return f"""
SELECT 'baseline_only' AS direction, count(*) FILTER (WHERE {a} AND NOT {b}) AS n,
       count(*) FILTER (WHERE {a} AND NOT {b}) > 0 AS satisfied FROM {source}
UNION ALL SELECT 'candidate_only', count(*) FILTER (WHERE {b} AND NOT {a}),
       count(*) FILTER (WHERE {b} AND NOT {a}) > 0 FROM {source}"""


@query("like_separation", _separation_sql("part", "p_name LIKE '%widget%'", "p_name LIKE 'small%'"))
def like_separation(t):
    return P.like_separation(t.part, "p_name", "%widget%", "small%")


@query("like_ignore_case", _separation_sql("part", "p_type ILIKE 'eco%'", "NOT (p_type ILIKE '%O%')"))
def like_ignore_case(t):
    return P.like_separation(t.part, "p_type", "eco%", "%O%", negated_candidate=True, ignore_case=True)


@query("glob_separation", _separation_sql("part", "p_name GLOB '*ring*'", "p_name GLOB 's[a-m]*'"))
def glob_separation(t):
    return P.glob_separation(t.part, "p_name", "*ring*", "s[a-m]*")


@query("regex_separation", _separation_sql(
    "part", "regexp_matches(p_name, '^[rb]')", "regexp_matches(p_name, 'red|bolt$')"))
def regex_separation(t):
    return P.regex_separation(t.part, "p_name", "^[rb]", "red|bolt$")


@query("null_paths", f"""
WITH s AS (SELECT {NULLABLE_DISCOUNT} AS d, l_tax AS x, CASE WHEN l_quantity < 0 THEN l_quantity END AS q FROM lineitem)
SELECT 'discount' AS "column", count(*) - count(d) AS n_null, count(d) AS n_non_null, 'both' AS path_shape FROM s
UNION ALL SELECT 'tax', count(*) - count(x), count(x), 'non_null_only' FROM s
UNION ALL SELECT 'negative_quantity', count(*) - count(q), count(q), 'null_only' FROM s""")
def null_paths(t):
    return P.null_paths(t.lineitem, {
        "discount": NULLABLE_DISCOUNT, "tax": "l_tax",
        "negative_quantity": "case when l_quantity < 0 then l_quantity end",
    })


def _null_safe_sql(a, b, op_a, op_b):
    return tally_sql(
        "lineitem",
        {"both_null": f"({a}) IS NULL AND ({b}) IS NULL", "one_null": f"(({a}) IS NULL) <> (({b}) IS NULL)",
         "equal": f"({a}) = ({b})", "unequal": f"({a}) <> ({b})"},
        divergent_sql(f"({a}) {op_a} ({b})", f"({a}) {op_b} ({b})"))


@query("null_safe_paths", _null_safe_sql(NULLABLE_TAX, NULLABLE_DISCOUNT, "=", "IS NOT DISTINCT FROM"))
def null_safe_paths(t):
    return P.null_safe_paths(t.lineitem, NULLABLE_TAX, NULLABLE_DISCOUNT, "=", "<=>")


@query("null_safe_literal", _null_safe_sql(NULLABLE_DISCOUNT, "0.04", "<>", "IS DISTINCT FROM"))
def null_safe_literal(t):
    return P.null_safe_paths(t.lineitem, NULLABLE_DISCOUNT, "0.04D", "<>", "is distinct from")


_WHENS = ["o_totalprice > 400000", "o_totalprice > 200000", "o_orderpriority = '1-URGENT'"]


@query("case_coverage", f"""
WITH s AS (SELECT {_WHENS[0]} AS a, {_WHENS[1]} AS b, {_WHENS[2]} AS c FROM orders)
SELECT 'when_1' AS branch, count(*) FILTER (WHERE a) AS n_hits, count(*) FILTER (WHERE a) AS n_first,
       0::BIGINT AS n_else_effect, count(*) FILTER (WHERE a) > 0 AS satisfied FROM s
UNION ALL SELECT 'when_2', count(*) FILTER (WHERE b), count(*) FILTER (WHERE b AND NOT a), 0,
       count(*) FILTER (WHERE b AND NOT a) > 0 FROM s
UNION ALL SELECT 'when_3', count(*) FILTER (WHERE c), count(*) FILTER (WHERE c AND NOT a AND NOT b), 0,
       count(*) FILTER (WHERE c AND NOT a AND NOT b) > 0 FROM s
UNION ALL SELECT 'unmatched', count(*) FILTER (WHERE NOT (a OR b OR c)), count(*) FILTER (WHERE NOT (a OR b OR c)),
       count(*) FILTER (WHERE NOT (a OR b OR c)), count(*) FILTER (WHERE NOT (a OR b OR c)) > 0 FROM s""")
def case_coverage(t):
    return P.case_coverage(t.orders, _WHENS, "'small'")


@query("projection_effect", tally_sql(
    f"(SELECT l_extendedprice * (1 - ({NULLABLE_DISCOUNT})) AS a, l_extendedprice AS b FROM lineitem)",
    {"same": "a IS NOT DISTINCT FROM b", "changed": "a <> b",
     "null_introduced": "a IS NOT NULL AND b IS NULL", "null_removed": "a IS NULL AND b IS NOT NULL"}))
def projection_effect(t):
    return P.projection_effect(t.lineitem, f"l_extendedprice * (1 - ({NULLABLE_DISCOUNT}))", "l_extendedprice")


@query("projection_changes", """
SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'large' ELSE 'small' END AS v_baseline,
       CASE WHEN o_totalprice > 250000 THEN 'large' END AS v_candidate
FROM orders WHERE NOT (o_totalprice > 250000)""")
def projection_changes(t):
    return P.projection_changes(
        t.orders, "case when o_totalprice > 250000 then 'large' else 'small' end",
        "case when o_totalprice > 250000 then 'large' end", ["o_orderkey"],
    )


@query("projection_boolean_tristate", f"""
WITH r AS (SELECT ({_P}) AS p FROM lineitem)
SELECT 'TRUE' AS path, count(*) FILTER (WHERE p) AS n, 0::BIGINT AS n_null_bare, 0::BIGINT AS n_null_truth_test FROM r
UNION ALL SELECT 'FALSE', count(*) FILTER (WHERE NOT p), 0, 0 FROM r
UNION ALL SELECT 'UNKNOWN', count(*) FILTER (WHERE p IS NULL), count(*) FILTER (WHERE p IS NULL), 0 FROM r""")
def projection_boolean_tristate(t):
    return P.projection_boolean_tristate(t.lineitem, f"({NULLABLE_DISCOUNT}) >= 0.05D")


@query("projection_discriminators", """
SELECT 'l_discount' AS "column", count(l_discount) AS n_non_null, min(l_discount) < max(l_discount) AS discriminates
FROM lineitem
UNION ALL SELECT 'constant', count(*), false FROM lineitem
UNION ALL SELECT 'l_shipdate', count(l_shipdate), min(l_shipdate) < max(l_shipdate) FROM lineitem""")
def projection_discriminators(t):
    return P.projection_discriminators(
        t.lineitem.withColumn("constant", F.lit("x")), ["l_discount", "constant", "l_shipdate"]
    )
