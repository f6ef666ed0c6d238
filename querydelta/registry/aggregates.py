"""Grouping, HAVING and aggregate probes on line items, orders and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from querydelta.operators import aggregates as A
from querydelta.registry import query
from querydelta.registry.membership import _flags_sql


def _grain_sql(a, b, verdict):
    columns = ", ".join(dict.fromkeys([*a, *b]))
    group = {"a": ", ".join(a) or "()", "b": ", ".join(b) or "()"}

    def side(name, tag):
        return (
            f"SELECT '{name}' AS side, count(*) AS n_groups, count(*) FILTER (WHERE parts > 1) AS n_split, "
            f"coalesce(sum(n) FILTER (WHERE parts > 1), 0)::BIGINT AS n_split_rows, '{verdict}' AS verdict FROM "
            f"(SELECT count(*) AS parts, sum(n) AS n FROM p GROUP BY {group[tag]})"
        )

    return (
        f"WITH p AS (SELECT {columns}, count(*) AS n FROM lineitem GROUP BY ALL) "
        f"{side('baseline', 'a')} UNION ALL {side('candidate', 'b')}"
    )


@query("group_grain_diff", _grain_sql(["l_returnflag"], ["l_returnflag", "l_linestatus"], "candidate_finer"))
def group_grain_diff(t):
    return A.group_grain_diff(t.lineitem, ["l_returnflag"], ["l_returnflag", "l_linestatus"])


@query("group_grain_crossing", _grain_sql(["l_suppkey"], ["l_partkey"], "crossing"))
def group_grain_crossing(t):
    return A.group_grain_diff(t.lineitem, ["l_suppkey"], ["l_partkey"])


@query("group_grain_global", _grain_sql(["l_suppkey"], [], "candidate_coarser"))
def group_grain_global(t):
    return A.group_grain_diff(t.lineitem, ["l_suppkey"], [])


@query("group_size_profile", """
SELECT count(*) AS n_groups, count(*) FILTER (WHERE n = 1) AS n_singleton, count(*) FILTER (WHERE n > 1) AS n_duplicate,
       max(n) AS max_size, sum(n)::BIGINT AS n_rows
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def group_size_profile(t):
    return A.group_size_profile(t.lineitem, ["l_orderkey", "l_linenumber"])


def boundary_sql(groups, bound, op_a, op_b, moved=None):
    """Paths of ``value`` in the subquery ``groups`` against a bound."""
    return f"""
WITH g AS ({groups}),
  p AS (SELECT CASE WHEN value < {bound} THEN 'below' WHEN value = {bound} THEN 'at' WHEN value > {bound} THEN 'above'
                    ELSE 'null' END AS path, count(*) AS n,
               count(*) FILTER (WHERE coalesce(value {op_a} {bound}, false)
                                   <> coalesce(value {op_b} {moved or bound}, false)) AS n_divergent FROM g GROUP BY 1)
SELECT path, coalesce(n, 0) AS n, coalesce(n_divergent, 0) AS n_divergent, coalesce(n, 0) > 0 AS satisfied
FROM (VALUES ('below'), ('at'), ('above'), ('null')) v(path) LEFT JOIN p USING (path)"""


@query("aggregate_boundary", boundary_sql(
    "SELECT o_custkey, count(*) AS value FROM orders GROUP BY 1", "10", ">=", ">"))
def aggregate_boundary(t):
    return A.aggregate_boundary(t.orders, ["o_custkey"], "count(*)", 10, ">=", ">")


@query("aggregate_boundary_domain", boundary_sql(
    """SELECT c_custkey, count(o_orderkey) AS value FROM customer
       LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 450000 GROUP BY 1""", "1", ">=", ">="
    , "0"))
def aggregate_boundary_domain(t):
    return A.aggregate_boundary(
        t.orders.where("o_totalprice > 450000"), ["o_custkey"], "count(*)", 1, ">=", ">=",
        threshold_candidate=0, domain=t.customer.select(F.col("c_custkey").alias("o_custkey")), empty_value=0,
    )


@query("aggregate_sum_boundary", boundary_sql(
    "SELECT l_suppkey, sum(l_quantity::BIGINT) AS value FROM lineitem GROUP BY 1", "15000", ">", ">=", "15500"))
def aggregate_sum_boundary(t):
    rows = t.lineitem.withColumn("q", F.col("l_quantity").cast("bigint"))
    return A.aggregate_boundary(rows, ["l_suppkey"], "sum(q)", 15000, ">", ">=", threshold_candidate=15500)


@query("aggregate_admission", """
SELECT o_custkey, count(*) AS value, 'baseline_only' AS direction FROM orders GROUP BY 1 HAVING count(*) = 10""")
def aggregate_admission(t):
    return A.aggregate_admission(t.orders, ["o_custkey"], "count(*)", "value >= 10", "value > 10")


@query("joined_aggregate_boundary", """
WITH g AS (SELECT o_custkey, count(*) AS value, count(DISTINCT o_orderkey) AS seen,
                  (SELECT count(*) FROM orders x WHERE x.o_custkey = o.o_custkey) AS base
           FROM orders o JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
  p AS (SELECT CASE WHEN value < 40 THEN 'below' WHEN value = 40 THEN 'at' ELSE 'above' END AS path, count(*) AS n,
               count(*) FILTER (WHERE (value >= 40) <> (value > 40)) AS n_divergent,
               count(*) FILTER (WHERE sign(value - 40) <> sign(base - 40)) AS n_crossed FROM g GROUP BY 1)
SELECT path, coalesce(n, 0) AS n, coalesce(n_divergent, 0) AS n_divergent, coalesce(n_crossed, 0) AS n_crossed,
       coalesce(n, 0) > 0 AS satisfied
FROM (VALUES ('below'), ('at'), ('above'), ('null')) v(path) LEFT JOIN p USING (path)""")
def joined_aggregate_boundary(t):
    return A.joined_aggregate_boundary(
        t.orders, t.lineitem, [("o_orderkey", "l_orderkey")], ["o_custkey"], 40, ">=", ">"
    )


@query("filtered_aggregate_boundary", """
WITH g AS (SELECT l_suppkey, sum(l_quantity::BIGINT) FILTER (WHERE l_shipdate <= TIMESTAMP '1998-09-02')::BIGINT AS v_baseline,
                  sum(l_quantity::BIGINT) FILTER (WHERE l_shipdate < TIMESTAMP '1998-10-02')::BIGINT AS v_candidate
           FROM lineitem GROUP BY 1)
SELECT *, CASE WHEN coalesce(v_baseline > 8000, false) THEN 'baseline_only' ELSE 'candidate_only' END AS direction
FROM g WHERE coalesce(v_baseline > 8000, false) <> coalesce(v_candidate > 8000, false)""")
def filtered_aggregate_boundary(t):
    rows = t.lineitem.withColumn("q", F.col("l_quantity").cast("bigint"))
    return A.filtered_aggregate_boundary(
        rows, ["l_suppkey"], "sum(q)", "value > 8000",
        "l_shipdate <= timestamp_ntz '1998-09-02'", "l_shipdate < timestamp_ntz '1998-10-02'",
    )


@query("aggregate_function_separation", """
SELECT l_suppkey, max(l_quantity) AS v_baseline, max(l_quantity) FILTER (WHERE l_returnflag = 'R') AS v_candidate
FROM lineitem GROUP BY 1
HAVING max(l_quantity) IS DISTINCT FROM max(l_quantity) FILTER (WHERE l_returnflag = 'R')""")
def aggregate_function_separation(t):
    return A.aggregate_function_separation(
        t.lineitem, ["l_suppkey"], "max(l_quantity)", "max(l_quantity) filter (where l_returnflag = 'R')"
    )


@query("aggregate_sum_or_max", """
SELECT l_orderkey, sum(l_quantity::BIGINT)::BIGINT AS v_baseline, max(l_quantity::BIGINT) AS v_candidate
FROM lineitem GROUP BY 1 HAVING sum(l_quantity::BIGINT) <> max(l_quantity::BIGINT)""")
def aggregate_sum_or_max(t):
    rows = t.lineitem.withColumn("q", F.col("l_quantity").cast("bigint"))
    return A.aggregate_function_separation(rows, ["l_orderkey"], "sum(q)", "max(q)")


@query("aggregate_order_reversals", """
WITH g AS (SELECT l_suppkey, sum(l_quantity::BIGINT) AS a, count(*) AS b FROM lineitem GROUP BY 1),
  d AS (SELECT a, min(b) AS low, max(b) AS high FROM g GROUP BY 1),
  o AS (SELECT max(high) OVER (ORDER BY a) AS reached, lead(low) OVER (ORDER BY a) AS following FROM d)
SELECT count(following) AS n_neighbours, count(*) FILTER (WHERE reached > following) AS n_reversed,
       count(*) FILTER (WHERE reached > following) > 0 AS satisfied FROM o""")
def aggregate_order_reversals(t):
    rows = t.lineitem.withColumn("q", F.col("l_quantity").cast("bigint"))
    return A.aggregate_order_reversals(rows, ["l_suppkey"], "sum(q)", "count(*)")


@query("count_null_sensitivity", """
WITH s AS (SELECT l_orderkey, CASE WHEN l_linenumber = 4 THEN NULL ELSE l_discount END AS d FROM lineitem)
SELECT l_orderkey, count(d) AS v_baseline, count(*) AS v_candidate, count(d) > 0 AS both_paths
FROM s GROUP BY 1 HAVING count(d) <> count(*)""")
def count_null_sensitivity(t):
    return A.count_null_sensitivity(
        t.lineitem, ["l_orderkey"], "case when l_linenumber = 4 then null else l_discount end"
    )


@query("count_distinct_sensitivity", """
SELECT l_suppkey, count(DISTINCT l_partkey) AS v_baseline, count(l_partkey) AS v_candidate,
       sum(DISTINCT l_partkey)::BIGINT AS sum_distinct, sum(l_partkey)::BIGINT AS sum_all
FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) <> count(l_partkey)""")
def count_distinct_sensitivity(t):
    return A.count_distinct_sensitivity(t.lineitem, ["l_suppkey"], "l_partkey")


@query("aggregate_filter_paths", """
SELECT l_suppkey, count(*) FILTER (WHERE l_discount > 0.05) AS v_baseline, count(*) FILTER (WHERE l_discount >= 0.05) AS v_candidate,
       count(*) FILTER (WHERE l_discount > 0.05) AS n_both, 0::BIGINT AS n_baseline_only,
       count(*) FILTER (WHERE l_discount = 0.05) AS n_candidate_only FROM lineitem GROUP BY 1""")
def aggregate_filter_paths(t):
    return A.aggregate_filter_paths(
        t.lineitem, ["l_suppkey"], "count(*)", "l_discount > 0.05D", "l_discount >= 0.05D"
    )


@query("filter_placement", """
WITH a AS (SELECT o_custkey, count(*) AS v FROM orders WHERE o_totalprice > 400000 GROUP BY 1),
     b AS (SELECT o_custkey, count(*) AS v FROM orders GROUP BY 1 HAVING count(*) > 9)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.v AS v_baseline, b.v AS v_candidate,
       CASE WHEN b.v IS NULL THEN 'baseline_only' WHEN a.v IS NULL THEN 'candidate_only' ELSE 'value_changed' END AS direction
FROM a FULL JOIN b ON a.o_custkey = b.o_custkey WHERE a.v IS DISTINCT FROM b.v""")
def filter_placement(t):
    return A.filter_placement(t.orders, ["o_custkey"], "count(*)", "o_totalprice > 400000", "v_candidate > 9")


@query("mixed_type_extremes", """
WITH s AS (SELECT p_brand, CASE WHEN p_size < 40 THEN p_size::VARCHAR ELSE p_type END AS x FROM part),
  k AS (SELECT p_brand, x, TRY_CAST(x AS DOUBLE) AS v FROM s)
SELECT p_brand, min(x) AS min_text,
       coalesce(arg_min(x, (v, x)) FILTER (WHERE v IS NOT NULL), min(x) FILTER (WHERE v IS NULL)) AS min_typed,
       max(x) AS max_text,
       coalesce(max(x) FILTER (WHERE v IS NULL), arg_max(x, (v, x)) FILTER (WHERE v IS NOT NULL)) AS max_typed
FROM k GROUP BY 1 HAVING min_text <> min_typed OR max_text <> max_typed""")
def mixed_type_extremes(t):
    rows = t.part.select(
        "p_brand", F.expr("case when p_size < 40 then cast(p_size as string) else p_type end").alias("x")
    )
    return A.mixed_type_extremes(rows, ["p_brand"], "x")


@query("having_ratio_boundary", boundary_sql(
    """SELECT l_orderkey, 100.0::DOUBLE * count(*) FILTER (WHERE l_returnflag = 'R')
         / nullif(count(CASE WHEN l_linenumber = 4 THEN NULL ELSE l_discount END), 0) AS value
       FROM lineitem GROUP BY 1""", "50.0::DOUBLE", ">=", ">"))
def having_ratio_boundary(t):
    return A.having_ratio_boundary(
        t.lineitem, ["l_orderkey"], "l_returnflag = 'R'",
        "case when l_linenumber = 4 then null else l_discount end", 100.0, 50.0, ">=", ">"
    )


@query("having_membership_divergence", _flags_sql("""
  SELECT c_custkey AS key, c_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 12) AS a,
         c_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 12) AS b FROM customer"""))
def having_membership_divergence(t):
    return A.having_membership_divergence(
        t.customer, "c_custkey", t.orders, "o_custkey", "count(*) >= 12", "count(*) > 12"
    )
