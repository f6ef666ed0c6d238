"""ORDER BY and LIMIT probes on parts, orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from querydelta.operators import ordering as O
from querydelta.registry import query


def _separation_sql(source, prefix, cell):
    return f"""
WITH g AS (SELECT count(*) AS n, coalesce(min({cell}) < max({cell}), false) AS s FROM {source} GROUP BY {prefix})
SELECT count(*) AS n_prefixes, count(*) FILTER (WHERE n > 1) AS n_ties, count(*) FILTER (WHERE s) AS n_separated,
       coalesce(sum(n) FILTER (WHERE s), 0)::BIGINT AS n_separated_rows, count(*) FILTER (WHERE s) > 0 AS satisfied FROM g"""


@query("order_separation", _separation_sql("part", "p_size", "p_retailprice"))
def order_separation(t):
    return O.order_separation(t.part, ["p_size"], "p_retailprice")


@query("order_direction", _separation_sql("orders", "()", "o_totalprice"))
def order_direction(t):
    return O.order_separation(t.orders, [], "o_totalprice")


@query("order_null_path", """
SELECT count(*) - count(nullif(p_size, 10)) AS n_null, count(nullif(p_size, 10)) AS n_non_null,
       count(nullif(p_size, 10)) BETWEEN 1 AND count(*) - 1 AS satisfied FROM part""")
def order_null_path(t):
    return O.order_null_path(t.part, "nullif(p_size, 10)")


def _slices_sql(a, b, keys):
    same = " AND ".join(f"a.{key} = b.{key}" for key in keys)
    columns = ", ".join(f"coalesce(a.{key}, b.{key}) AS {key}" for key in keys)
    return f"""
WITH a AS ({a}), b AS ({b})
SELECT {columns}, coalesce(a.pos, b.pos) AS pos,
       CASE WHEN b.pos IS NULL THEN 'baseline_only' ELSE 'candidate_only' END AS direction
FROM a FULL JOIN b ON {same} WHERE a.pos IS NULL OR b.pos IS NULL"""


@query("topn_membership_diff", _slices_sql(
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders QUALIFY pos <= 50",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS pos FROM orders QUALIFY pos <= 50",
    ["o_orderkey"]))
def topn_membership_diff(t):
    return O.topn_membership_diff(
        t.orders, ["o_orderkey"], ["o_totalprice desc", "o_orderkey"], ["o_orderdate desc", "o_orderkey"], 50, 50
    )


_MILLION = """SELECT o_orderkey, row_number() OVER (ORDER BY {order}, o_orderkey) - {offset} AS pos
  FROM orders QUALIFY pos BETWEEN 1 AND 1000000"""


# A slice that no single task should hold.
@query("topn_million", _slices_sql(
    _MILLION.format(order="o_totalprice DESC", offset=3000), _MILLION.format(order="o_orderdate DESC, o_totalprice", offset=9000),
    ["o_orderkey"]))
def topn_million(t):
    return O.topn_membership_diff(
        t.orders, ["o_orderkey"], ["o_totalprice desc", "o_orderkey"], ["o_orderdate desc", "o_totalprice", "o_orderkey"],
        1_000_000, 1_000_000, 3000, 9000,
    )


@query("topn_cutoff_ties_deep", """
WITH o AS (SELECT l_shipdate, count(*) AS n, sum(count(*)) OVER (ORDER BY l_shipdate DESC) AS upto FROM lineitem GROUP BY 1)
SELECT coalesce(max(n), 0) AS n_tied, coalesce(max(25000 - upto + n), 0)::BIGINT AS n_slots, coalesce(bool_and(upto = 25000), true) AS deterministic
FROM o WHERE upto >= 25000 AND upto - n < 25000""")
def topn_cutoff_ties_deep(t):
    return O.topn_cutoff_ties(t.lineitem, ["l_shipdate desc"], 25_000)


@query("topn_offset_change", _slices_sql(
    """SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS pos FROM orders
       QUALIFY pos BETWEEN 1 AND 20""",
    """SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 5 AS pos FROM orders
       QUALIFY pos BETWEEN 1 AND 25""", ["o_orderkey"]))
def topn_offset_change(t):
    order = ["o_totalprice desc", "o_orderkey"]
    return O.topn_membership_diff(t.orders, ["o_orderkey"], order, order, 20, 25, 1, 5)


def _ties_sql(n):
    return f"""
WITH c AS (SELECT p_size AS cut FROM part ORDER BY p_size DESC LIMIT 1 OFFSET {n - 1}),
  s AS (SELECT count(*) FILTER (WHERE p_size = cut) AS n_tied, {n} - count(*) FILTER (WHERE p_size > cut) AS n_slots
        FROM part, c)
SELECT n_tied, n_slots, n_tied <= n_slots AS deterministic FROM s"""


@query("topn_cutoff_ties", _ties_sql(100))
def topn_cutoff_ties(t):
    return O.topn_cutoff_ties(t.part, ["p_size desc"], 100)


@query("topn_without_order", """
SELECT count(*) AS n_tied, least(count(*), 3) AS n_slots, count(*) <= 3 AS deterministic FROM supplier""")
def topn_without_order(t):
    return O.topn_cutoff_ties(t.supplier, [], 3)


@query("limit_reachability", """
SELECT count(*) AS n_rows, least(120, count(*) - 10)::BIGINT AS returned_baseline,
       least(2000, count(*) - 10)::BIGINT AS returned_candidate, 131::BIGINT AS required_rows, count(*) >= 131 AS visible
FROM customer""")
def limit_reachability(t):
    return O.limit_reachability(t.customer, 120, 2000, 10, 10)


@query("grouped_order_divergence", _slices_sql(
    """SELECT l_suppkey, row_number() OVER (ORDER BY sum(l_quantity::BIGINT) DESC, l_suppkey) AS pos
       FROM lineitem GROUP BY 1 QUALIFY pos <= 5""",
    """SELECT l_suppkey, row_number() OVER (ORDER BY count(*) DESC, l_suppkey) AS pos
       FROM lineitem GROUP BY 1 QUALIFY pos <= 5""", ["l_suppkey"]))
def grouped_order_divergence(t):
    rows = t.lineitem.withColumn("q", F.col("l_quantity").cast("bigint"))
    return O.grouped_order_divergence(rows, ["l_suppkey"], "sum(q)", "count(*)", 5)
