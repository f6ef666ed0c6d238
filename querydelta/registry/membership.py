"""Subquery and membership probes on customers, orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from querydelta.operators import membership as M
from querydelta.registry import query
from querydelta.registry.joins import _KEYED, _OPEN, _SEGMENT, _open_orders, _segment


def _path(name, condition):
    return (
        f"SELECT '{name}' AS path, count(k) FILTER (WHERE {condition}) AS n_values, "
        f"coalesce(sum(n_l) FILTER (WHERE {condition}), 0)::BIGINT AS n_outer_rows, "
        f"coalesce(sum(n_r) FILTER (WHERE {condition}), 0)::BIGINT AS n_inner_rows, "
        f"coalesce(sum(n_l + n_r) FILTER (WHERE {condition}), 0) > 0 AS satisfied FROM j"
    )


@query("membership_paths", f"WITH {_KEYED} " + " UNION ALL ".join([
    _path("overlap", "n_l > 0 AND n_r > 0"), _path("outer_only", "n_r = 0 AND k IS NOT NULL"),
    _path("inner_only", "n_l = 0 AND k IS NOT NULL"), _path("outer_null", "k IS NULL AND n_l > 0"),
    _path("inner_null", "k IS NULL AND n_r > 0")]))
def membership_paths(t):
    return M.membership_paths(_segment(t), _open_orders(t), "c_custkey", "o_custkey")


def _antijoin_sql(inner):
    return f"""
WITH c AS (SELECT c_custkey, c_custkey NOT IN (SELECT o_custkey FROM {inner}) AS not_in,
                  NOT EXISTS (SELECT 1 FROM {inner} o WHERE o.o_custkey = c.c_custkey) AS not_exists FROM {_SEGMENT} c)
SELECT 'both' AS path, count(*) FILTER (WHERE coalesce(not_in, false) AND not_exists) AS n FROM c
UNION ALL SELECT 'not_exists_only_inner_null',
  count(*) FILTER (WHERE NOT coalesce(not_in, false) AND not_exists AND c_custkey IS NOT NULL) FROM c
UNION ALL SELECT 'not_exists_only_outer_null',
  count(*) FILTER (WHERE NOT coalesce(not_in, false) AND not_exists AND c_custkey IS NULL) FROM c"""


@query("null_antijoin_divergence", _antijoin_sql(_OPEN))
def null_antijoin_divergence(t):
    return M.null_antijoin_divergence(_segment(t), _open_orders(t), "c_custkey", "o_custkey")


@query("null_antijoin_outer_only", _antijoin_sql(f"(SELECT * FROM {_OPEN} WHERE o_custkey IS NOT NULL)"))
def null_antijoin_outer_only(t):
    return M.null_antijoin_divergence(
        _segment(t), _open_orders(t).where("o_custkey is not null"), "c_custkey", "o_custkey"
    )


@query("null_antijoin_rows", f"""
SELECT * FROM {_SEGMENT} c WHERE NOT EXISTS (SELECT 1 FROM {_OPEN} o WHERE o.o_custkey = c.c_custkey)
  AND (c.c_custkey NOT IN (SELECT o_custkey FROM {_OPEN})) IS NOT TRUE""")
def null_antijoin_rows(t):
    return M.null_antijoin_rows(_segment(t), _open_orders(t), "c_custkey", "o_custkey")


def _flags_sql(source):
    return f"""
WITH f AS ({source}),
  d AS (SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'baseline_only' WHEN b THEN 'candidate_only'
                    ELSE 'neither' END AS direction, count(DISTINCT key) AS n_keys, count(*) AS n_rows FROM f GROUP BY 1)
SELECT p.direction, coalesce(n_keys, 0) AS n_keys, coalesce(n_rows, 0) AS n_rows, coalesce(n_rows, 0) > 0 AS satisfied
FROM (VALUES ('both'), ('baseline_only'), ('candidate_only'), ('neither')) p(direction) LEFT JOIN d USING (direction)"""


@query("membership_key_drift", _flags_sql("""
  SELECT (l_partkey, l_suppkey) AS key, l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) AS a,
         l_partkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) AS b FROM lineitem"""))
def membership_key_drift(t):
    rich = t.supplier.where("s_acctbal > 5000")
    return M.membership_key_drift(
        t.lineitem, (rich, [("l_suppkey", "s_suppkey")]), (rich, [("l_partkey", "s_suppkey")])
    )


@query("correlation_key_drift", _flags_sql("""
  SELECT (c_custkey, c_nationkey) AS key,
         EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS a,
         EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_nationkey AND o_orderstatus = 'F') AS b FROM customer"""))
def correlation_key_drift(t):
    finished = t.orders.where("o_orderstatus = 'F'")
    return M.membership_key_drift(
        t.customer, (finished, [("c_custkey", "o_custkey")]), (finished, [("c_nationkey", "o_custkey")])
    )


@query("in_vs_exists_divergence", f"""
WITH c AS (SELECT * FROM {_SEGMENT}), o AS (SELECT * FROM {_OPEN}),
  n AS (SELECT (SELECT count(*) FROM c WHERE c_custkey IN (SELECT o_custkey FROM o)) AS m,
               (SELECT count(*) FROM c WHERE c_custkey IN (SELECT o_custkey FROM o WHERE o_totalprice > 400000)) AS f,
               (SELECT count(*) FROM c) AS e, (SELECT count(*) FROM c JOIN o ON c_custkey = o_custkey) AS j)
SELECT 'in' AS version, m::DECIMAL(38,0) AS n_rows, 0::DECIMAL(38,0) AS delta_to_in FROM n
UNION ALL SELECT 'in_filtered', f::DECIMAL(38,0), (f - m)::DECIMAL(38,0) FROM n
UNION ALL SELECT 'exists_uncorrelated', e::DECIMAL(38,0), (e - m)::DECIMAL(38,0) FROM n
UNION ALL SELECT 'inner_join', j::DECIMAL(38,0), (j - m)::DECIMAL(38,0) FROM n""")
def in_vs_exists_divergence(t):
    return M.in_vs_exists_divergence(
        _segment(t), _open_orders(t), "c_custkey", "o_custkey", "o_totalprice > 400000"
    )


@query("scalar_subquery_cardinality", """
WITH i AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_quantity) AS d FROM lineitem GROUP BY 1),
  p AS (SELECT CASE WHEN n IS NULL THEN 'zero' WHEN n = 1 THEN 'one' WHEN d = 1 THEN 'many_same_value'
                    ELSE 'many_values' END AS path, count(*) AS n FROM orders LEFT JOIN i ON o_orderkey = l_orderkey GROUP BY 1)
SELECT path, coalesce(n, 0) AS n_keys, coalesce(n, 0) AS n_rows, coalesce(n, 0) > 0 AS satisfied
FROM (VALUES ('zero'), ('one'), ('many_same_value'), ('many_values')) v(path) LEFT JOIN p USING (path)""")
def scalar_subquery_cardinality(t):
    return M.scalar_subquery_cardinality(t.orders, t.lineitem, [("o_orderkey", "l_orderkey")], "l_quantity")


def _aggregate_sql(bound, moved, op_a="<", op_b="<="):
    return f"""
WITH s AS (SELECT x, {bound} AS a, {moved} AS b FROM (
    SELECT (o_totalprice * 100)::BIGINT AS x, o_custkey, o_orderpriority, o_orderstatus FROM orders)),
  p AS (SELECT CASE WHEN x < a THEN 'below' WHEN x = a THEN 'at' WHEN x > a THEN 'above' ELSE 'unknown' END AS path,
               count(*) AS n, count(*) FILTER (WHERE (x {op_a} a) <> (x {op_b} b)) AS n_divergent FROM s GROUP BY 1)
SELECT path, coalesce(n, 0) AS n, coalesce(n_divergent, 0) AS n_divergent, coalesce(n, 0) > 0 AS satisfied
FROM (VALUES ('below'), ('at'), ('above'), ('unknown')) v(path) LEFT JOIN p USING (path)"""


def _cents(t):
    return t.orders.select(
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("x"),
        "o_custkey", "o_orderpriority", "o_orderstatus",
    )


@query("scalar_aggregate_boundary", _aggregate_sql("max(x) OVER ()", "max(x) OVER ()"))
def scalar_aggregate_boundary(t):
    return M.scalar_aggregate_boundary(_cents(t), "x", "max(x)", "<", "<=")


@query("correlated_aggregate_boundary", _aggregate_sql(
    "max(x) OVER (PARTITION BY o_custkey)", "max(x) OVER (PARTITION BY o_custkey)"))
def correlated_aggregate_boundary(t):
    return M.scalar_aggregate_boundary(_cents(t), "x", "max(x)", "<", "<=", ["o_custkey"])


@query("correlated_aggregate_key_drift", _aggregate_sql(
    "sum(x) OVER (PARTITION BY o_custkey) // count(*) OVER (PARTITION BY o_custkey)",
    "sum(x) OVER (PARTITION BY o_orderpriority) // count(*) OVER (PARTITION BY o_orderpriority)", ">", ">"))
def correlated_aggregate_key_drift(t):
    return M.scalar_aggregate_boundary(
        _cents(t), "x", "sum(x) div count(*)", ">", ">", ["o_custkey"], ["o_orderpriority"]
    )
