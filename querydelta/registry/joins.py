"""Join probes on orders, line items, customers, suppliers and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from querydelta.operators import joins as J
from querydelta.registry import query

# Customers outside one market segment, some without a key: both sides of the
# join to orders then have dangling and NULL keys.
_SEGMENT = """(SELECT CASE WHEN c_acctbal < 0 THEN NULL ELSE c_custkey END AS c_custkey, c_nationkey, c_acctbal
               FROM customer WHERE c_mktsegment <> 'BUILDING')"""
_OPEN = """(SELECT CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_custkey END AS o_custkey, o_orderkey,
                   o_orderstatus, o_totalprice
            FROM orders WHERE o_totalprice > 150000)"""
_ON = [("c_custkey", "o_custkey")]


def _segment(t):
    return t.customer.where("c_mktsegment <> 'BUILDING'").select(
        F.expr("case when c_acctbal < 0 then null else c_custkey end").alias("c_custkey"),
        "c_nationkey", "c_acctbal",
    )


def _open_orders(t):
    return t.orders.where("o_totalprice > 150000").select(
        F.expr("case when o_orderpriority = '5-LOW' then null else o_custkey end").alias("o_custkey"),
        "o_orderkey", "o_orderstatus", "o_totalprice",
    )


_KEYED = f"""
  l AS (SELECT c_custkey AS k, count(*) AS n_l FROM {_SEGMENT} GROUP BY 1),
  r AS (SELECT o_custkey AS k, count(*) AS n_r FROM {_OPEN} GROUP BY 1),
  j AS (SELECT coalesce(l.k, r.k) AS k, coalesce(n_l, 0) AS n_l, coalesce(n_r, 0) AS n_r
        FROM l FULL JOIN r ON l.k = r.k)"""


def _path(name, condition):
    return (
        f"SELECT '{name}' AS path, count(*) AS n_keys, coalesce(sum(n_l), 0)::BIGINT AS n_left_rows, "
        f"coalesce(sum(n_r), 0)::BIGINT AS n_right_rows, count(*) > 0 AS satisfied FROM j WHERE {condition}"
    )


@query("join_path_profile", f"WITH {_KEYED} " + " UNION ALL ".join([
    _path("matched", "n_l > 0 AND n_r > 0"), _path("dangling_left", "n_r = 0 AND k IS NOT NULL"),
    _path("dangling_right", "n_l = 0 AND k IS NOT NULL"), _path("null_left", "k IS NULL AND n_l > 0"),
    _path("null_right", "k IS NULL AND n_r > 0")]))
def join_path_profile(t):
    return J.join_path_profile(_segment(t), _open_orders(t), _ON)


@query("canonical_join_key", """
SELECT 'numeric' AS kind, c_custkey::VARCHAR AS "key", 3::BIGINT AS n FROM customer
UNION ALL
SELECT 'text', c_mktsegment, count(*) FROM customer GROUP BY 2""")
def canonical_join_key(t):
    spelled = [
        F.col("c_custkey").cast("string"),
        F.concat(F.lit(" 00"), F.col("c_custkey").cast("string")),
        F.concat(F.col("c_custkey").cast("string"), F.lit(".0")),
        F.col("c_mktsegment"),
    ]
    rows = t.customer.select(F.explode(F.array(*spelled)).alias("code"))
    return J.canonical_join_key(rows, "code")


@query("canonical_join_key_numbers", """
SELECT 'numeric' AS kind, CASE WHEN l_quantity = floor(l_quantity) THEN l_quantity::BIGINT::VARCHAR
       ELSE l_quantity::VARCHAR END AS "key", count(*) AS n FROM lineitem GROUP BY ALL""")
def canonical_join_key_numbers(t):
    return J.canonical_join_key(t.lineitem, "l_quantity")


@query("join_condition_divergence", """
WITH l AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL),
  c AS (SELECT sum(n) FILTER (WHERE l_suppkey = s_suppkey AND l_partkey = s_suppkey) AS x,
               sum(n) FILTER (WHERE l_suppkey = s_suppkey AND l_partkey <> s_suppkey) AS y,
               sum(n) FILTER (WHERE l_suppkey <> s_suppkey AND l_partkey = s_suppkey) AS z
        FROM l, supplier WHERE l_suppkey = s_suppkey OR l_partkey = s_suppkey)
SELECT 'both' AS direction, coalesce(x, 0)::DECIMAL(38,0) AS n_pairs, coalesce(x, 0) > 0 AS satisfied FROM c
UNION ALL SELECT 'baseline_only', coalesce(y, 0)::DECIMAL(38,0), coalesce(y, 0) > 0 FROM c
UNION ALL SELECT 'candidate_only', coalesce(z, 0)::DECIMAL(38,0), coalesce(z, 0) > 0 FROM c""")
def join_condition_divergence(t):
    return J.join_condition_divergence(
        t.lineitem, t.supplier, [("l_suppkey", "s_suppkey")], [("l_partkey", "s_suppkey")]
    )


@query("join_conjunct_dropped", """
WITH p AS (SELECT count(*) AS x FROM customer JOIN supplier ON c_nationkey = s_nationkey
            AND floor(c_acctbal / 1000) = floor(s_acctbal / 1000)),
  q AS (SELECT count(*) AS y FROM customer JOIN supplier ON c_nationkey = s_nationkey)
SELECT 'both' AS direction, x::DECIMAL(38,0) AS n_pairs, x > 0 AS satisfied FROM p
UNION ALL SELECT 'baseline_only', 0::DECIMAL(38,0), false
UNION ALL SELECT 'candidate_only', (y - x)::DECIMAL(38,0), y - x > 0 FROM p, q""")
def join_conjunct_dropped(t):
    band = ("floor(c_acctbal / 1000)", "floor(s_acctbal / 1000)")
    return J.join_condition_divergence(
        t.customer, t.supplier, [("c_nationkey", "s_nationkey"), band], [("c_nationkey", "s_nationkey")]
    )


def _type_sql(a, b):
    def shown(how, part):
        product = "(SELECT sum(n_l) * sum(n_r) FROM j)"
        matched = "(SELECT sum(n_l * n_r) FROM j)"
        return {
            "matched": matched,
            "unmatched_left": "(SELECT sum(n_l) FROM j WHERE n_r = 0)" if how in ("left", "full") else "0",
            "unmatched_right": "(SELECT sum(n_r) FROM j WHERE n_l = 0)" if how in ("right", "full") else "0",
            "unconstrained_pairs": f"{product} - {matched}" if how == "cross" else "0",
        }[part]

    parts = []
    for part in ("matched", "unmatched_left", "unmatched_right", "unconstrained_pairs"):
        x, y = shown(a, part), shown(b, part)
        parts.append(
            f"SELECT '{part}' AS path, ({x})::DECIMAL(38,0) AS n_baseline, ({y})::DECIMAL(38,0) AS n_candidate, "
            f"(({y}) - ({x}))::DECIMAL(38,0) AS delta"
        )
    return f"WITH {_KEYED} " + " UNION ALL ".join(parts)


@query("join_type_effect", _type_sql("left", "inner"))
def join_type_effect(t):
    return J.join_type_effect(_segment(t), _open_orders(t), _ON, "left", "inner")


@query("join_type_full_cross", _type_sql("full", "cross"))
def join_type_full_cross(t):
    return J.join_type_effect(_segment(t), _open_orders(t), _ON, "full", "cross")


def _placement_sql(p):
    return f"""
WITH c AS (SELECT * FROM {_SEGMENT}), o AS (SELECT * FROM {_OPEN}),
  a AS (SELECT c.c_custkey, c_acctbal, o_orderkey, count(*) AS n FROM c LEFT JOIN o
        ON c.c_custkey = o.o_custkey AND ({p}) GROUP BY ALL),
  b AS (SELECT c.c_custkey, c_acctbal, o_orderkey, count(*) AS n FROM c LEFT JOIN o
        ON c.c_custkey = o.o_custkey WHERE ({p}) GROUP BY ALL),
  d AS (SELECT coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL JOIN b
        ON a.c_custkey IS NOT DISTINCT FROM b.c_custkey AND a.c_acctbal = b.c_acctbal
       AND a.o_orderkey IS NOT DISTINCT FROM b.o_orderkey)
SELECT 'both' AS direction, sum(least(x, y))::DECIMAL(38,0) AS n FROM d
UNION ALL SELECT 'baseline_only', sum(greatest(x - y, 0))::DECIMAL(38,0) FROM d
UNION ALL SELECT 'candidate_only', sum(greatest(y - x, 0))::DECIMAL(38,0) FROM d"""


@query("outer_predicate_placement", _placement_sql("o_orderstatus = 'F'"))
def outer_predicate_placement(t):
    return J.outer_predicate_placement(_segment(t), _open_orders(t), _ON, "o_orderstatus = 'F'")


@query("outer_null_predicate_placement", _placement_sql("o_orderstatus = 'F' OR o_orderkey IS NULL"))
def outer_null_predicate_placement(t):
    return J.outer_predicate_placement(
        _segment(t), _open_orders(t), _ON, "o_orderstatus = 'F' or o_orderkey is null"
    )


# Every customer and order; half of the customers and of the orders have no partner, some orders no key.
_HALVED = "nullif(o_custkey * 2, 20)"
_SIDES = {"left": "c_mktsegment = 'BUILDING' or c_custkey is null", "right": "o_orderstatus = 'F'"}


def _placed_sql(how, side):
    join = f"SELECT * FROM c {how.upper()} JOIN o ON c_custkey = k"
    return f"""WITH c AS (SELECT c_custkey, c_mktsegment FROM customer),
  o AS (SELECT o_orderkey, o_orderstatus, {_HALVED} AS k FROM orders),
  a AS ({join} AND ({_SIDES[side]})), b AS ({join} WHERE ({_SIDES[side]}))
SELECT 'both' AS direction, count(*)::DECIMAL(38,0) AS n FROM (FROM a INTERSECT ALL FROM b)
UNION ALL SELECT 'baseline_only', count(*) FROM (FROM a EXCEPT ALL FROM b)
UNION ALL SELECT 'candidate_only', count(*) FROM (FROM b EXCEPT ALL FROM a)"""


def _placement(how, side):
    @query(f"outer_placement_{how}_{side}", _placed_sql(how, side))
    def placement(t):
        orders = t.orders.select("o_orderkey", "o_orderstatus", F.expr(_HALVED).alias("k"))
        return J.outer_predicate_placement(t.customer, orders, [("c_custkey", "k")], _SIDES[side], how, side)

    return placement


for _how in ("left", "right", "full"):
    for _side in ("left", "right"):
        _placement(_how, _side)


@query("join_presence_effect", f"""WITH {_KEYED},
  m AS (SELECT n_l, CASE WHEN k IS NULL THEN 0 ELSE n_r END AS m FROM j)
SELECT 'filtered_out' AS path, sum(n_l)::BIGINT AS n_base_rows, 0::DECIMAL(38,0) AS n_joined_rows, sum(n_l) > 0 AS satisfied
FROM m WHERE m = 0
UNION ALL SELECT 'kept_once', sum(n_l)::BIGINT, sum(n_l)::DECIMAL(38,0), sum(n_l) > 0 FROM m WHERE m = 1
UNION ALL SELECT 'multiplied', sum(n_l)::BIGINT, sum(n_l * m)::DECIMAL(38,0), sum(n_l) > 0 FROM m WHERE m > 1""")
def join_presence_effect(t):
    return J.join_presence_effect(_segment(t), _open_orders(t), _ON)


@query("cross_join_blowup", """
WITH c AS (SELECT (SELECT count(*) FROM customer) AS a, (SELECT count(*) FROM supplier) AS b,
                  (SELECT count(*) FROM customer JOIN supplier ON c_nationkey = s_nationkey) AS m)
SELECT a AS n_left, b AS n_right, (a * b)::DECIMAL(38,0) AS product, m::DECIMAL(38,0) AS joined,
       round((a * b)::DOUBLE / m, 4) AS ratio FROM c""")
def cross_join_blowup(t):
    return J.cross_join_blowup(t.customer, t.supplier, [("c_nationkey", "s_nationkey")])


@query("measured_cardinality", """
WITH l AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1),
     r AS (SELECT c_custkey AS k, count(*) AS n FROM customer GROUP BY 1)
SELECT (SELECT max(n) FROM l) AS max_left, (SELECT max(n) FROM r) AS max_right,
       (SELECT count(*) FROM l JOIN r USING (k)) AS shared_keys, 'MANY_TO_ONE' AS cardinality, false AS may_fan_out""")
def measured_cardinality(t):
    return J.measured_cardinality(t.orders, t.customer, [("o_custkey", "c_custkey")])


@query("measured_cardinality_many", """
WITH l AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1),
     r AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT (SELECT max(n) FROM l) AS max_left, (SELECT max(n) FROM r) AS max_right,
       (SELECT count(*) FROM l JOIN r USING (k)) AS shared_keys, 'MANY_TO_MANY' AS cardinality, true AS may_fan_out""")
def measured_cardinality_many(t):
    return J.measured_cardinality(t.lineitem, t.lineitem, [("l_partkey", "l_suppkey")])


@query("fanout_inflation", """
WITH m AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
  b AS (SELECT o_orderstatus, (o_totalprice * 100)::BIGINT AS cents, coalesce(n, 0) AS n
        FROM orders LEFT JOIN m ON o_orderkey = l_orderkey)
SELECT o_orderstatus, sum(cents)::BIGINT AS base_sum, (sum(cents * n) FILTER (WHERE n > 0))::BIGINT AS joined_sum,
       count(*) AS base_count, sum(n)::BIGINT AS joined_count, count(*) FILTER (WHERE n > 0) AS joined_entities,
       round((sum(cents * n) FILTER (WHERE n > 0))::DOUBLE / sum(cents)::DOUBLE, 6) AS inflation
FROM b GROUP BY 1""")
def fanout_inflation(t):
    return J.fanout_inflation(
        t.orders, t.lineitem, [("o_orderkey", "l_orderkey")],
        "cast(round(o_totalprice * 100) as bigint)", ["o_orderstatus"],
    )


@query("self_join_offset", """
WITH k AS (SELECT o_orderkey AS k, count(*) AS n FROM orders GROUP BY 1),
  total AS (SELECT sum(n) * sum(n) AS pairs FROM k),
  same AS (SELECT sum(a.n * b.n) AS pairs FROM k a JOIN k b ON b.k = a.k + 1),
  later AS (SELECT sum(a.n * coalesce(b.n, 0)) AS pairs
            FROM (SELECT k, n FROM k) a
            ASOF LEFT JOIN (SELECT k, sum(n) OVER (ORDER BY k DESC) AS n FROM k) b ON a.k + 1 < b.k)
SELECT 'below' AS path, (t.pairs - s.pairs - l.pairs)::DECIMAL(38,0) AS n_pairs, 'neither' AS direction
FROM total t, same s, later l
UNION ALL SELECT 'at', pairs::DECIMAL(38,0), 'candidate_only' FROM same
UNION ALL SELECT 'above', pairs::DECIMAL(38,0), 'both' FROM later""")
def self_join_offset(t):
    return J.self_join_range(t.orders, "o_orderkey", 1, ">", ">=")


@query("self_join_range", """
WITH p AS (SELECT CASE WHEN date_trunc('day', b.ts) < date_trunc('day', a.ts) + INTERVAL 1 DAY THEN 'below'
                       WHEN date_trunc('day', b.ts) = date_trunc('day', a.ts) + INTERVAL 1 DAY THEN 'at' ELSE 'above' END AS path
           FROM events a JOIN events b ON a.user_id = b.user_id)
SELECT path, count(*)::DECIMAL(38,0) AS n_pairs,
       CASE path WHEN 'below' THEN 'both' WHEN 'at' THEN 'candidate_only' ELSE 'neither' END AS direction
FROM p GROUP BY 1""")
def self_join_range(t):
    days = t.events.select("user_id", F.to_date("ts").alias("day"))
    return J.self_join_range(days, "day", F.expr("interval 1 day"), "<", "<=", ["user_id"])
