"""Result comparison on orders, customers and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from querydelta.operators import compare as C
from querydelta.registry import query

_BY_PRIORITY = """
  a AS (SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice >= 100000 GROUP BY 1),
  b AS (SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice >= 150000 GROUP BY 1)"""


def _orders_from(t, price):
    return (
        t.orders.where(F.col("o_totalprice") >= price)
        .groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    )


def _status_pairs(t, price):
    return t.orders.where(F.col("o_totalprice") >= price).select(
        "o_custkey", "o_orderstatus", "o_orderpriority"
    )


_PAIR_BAG = """
  a AS (SELECT o_custkey, o_orderstatus, o_orderpriority, count(*) AS ca FROM orders
        WHERE o_totalprice >= 100000 GROUP BY ALL),
  b AS (SELECT o_custkey, o_orderstatus, o_orderpriority, count(*) AS cb FROM orders
        WHERE o_totalprice >= 150000 GROUP BY ALL),
  j AS (SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey,
               coalesce(a.o_orderstatus, b.o_orderstatus) AS o_orderstatus,
               coalesce(a.o_orderpriority, b.o_orderpriority) AS o_orderpriority,
               coalesce(ca, 0) AS ca, coalesce(cb, 0) AS cb
        FROM a FULL JOIN b ON a.o_custkey = b.o_custkey AND a.o_orderstatus = b.o_orderstatus
                          AND a.o_orderpriority = b.o_orderpriority)"""


@query("bag_diff", f"""WITH {_PAIR_BAG}
SELECT o_custkey, o_orderstatus, o_orderpriority,
       greatest(ca - cb, 0)::BIGINT AS only_baseline, greatest(cb - ca, 0)::BIGINT AS only_candidate
FROM j WHERE ca <> cb""")
def bag_diff(t):
    return C.bag_diff(_status_pairs(t, 100000), _status_pairs(t, 150000))


@query("bag_diff_grouped", f"""WITH {_BY_PRIORITY}
SELECT o_orderpriority, n, 1::BIGINT AS only_baseline, 0::BIGINT AS only_candidate
FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL
SELECT o_orderpriority, n, 0::BIGINT, 1::BIGINT FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def bag_diff_grouped(t):
    return C.bag_diff(_orders_from(t, 100000), _orders_from(t, 150000))


@query("set_diff", f"""WITH {_PAIR_BAG}
SELECT o_custkey, o_orderstatus, o_orderpriority,
       CASE WHEN cb = 0 THEN 'baseline_only' ELSE 'candidate_only' END AS direction
FROM j WHERE (ca = 0) <> (cb = 0)""")
def set_diff(t):
    return C.set_diff(_status_pairs(t, 100000), _status_pairs(t, 150000))


@query("same_values", f"""WITH {_PAIR_BAG}
SELECT count(*) FILTER (WHERE (ca = 0) <> (cb = 0)) = 0 AS same_projected_values,
       sum(greatest(ca - 1, 0))::BIGINT AS dup_baseline, sum(greatest(cb - 1, 0))::BIGINT AS dup_candidate
FROM j""")
def same_values(t):
    return C.same_values(_status_pairs(t, 100000), _status_pairs(t, 150000))


@query("ordered_diff", """WITH
  a AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders),
  b AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS pos
        FROM orders WHERE o_orderstatus <> 'P')
SELECT coalesce(a.pos, b.pos) AS pos, a.o_orderkey AS baseline_o_orderkey, a.o_totalprice AS baseline_o_totalprice,
       b.o_orderkey AS candidate_o_orderkey, b.o_totalprice AS candidate_o_totalprice
FROM a FULL JOIN b ON a.pos = b.pos
WHERE a.o_orderkey IS DISTINCT FROM b.o_orderkey OR a.o_totalprice IS DISTINCT FROM b.o_totalprice""")
def ordered_diff(t):
    return C.ordered_diff(
        t.orders, t.orders.where("o_orderstatus <> 'P'"),
        ["o_totalprice desc", "o_orderkey"], ["o_orderdate desc", "o_orderkey"],
        ["o_orderkey", "o_totalprice"],
    )


@query("shape_diff", """
SELECT 'c_custkey' AS "column", 'same' AS verdict, 'bigint' AS baseline_type, 'bigint' AS candidate_type,
       count(c_custkey) AS n_baseline, count(c_custkey) AS n_candidate FROM customer
UNION ALL SELECT 'c_name', 'same', 'string', 'string', count(c_name), count(c_name) FROM customer
UNION ALL SELECT 'c_nationkey', 'type_changed', 'int', 'bigint', count(c_nationkey), count(c_nationkey) FROM customer
UNION ALL SELECT 'c_acctbal', 'same', 'double', 'double', count(c_acctbal),
                 count(CASE WHEN c_acctbal >= 0 THEN c_acctbal END) FROM customer
UNION ALL SELECT 'c_mktsegment', 'column_dropped', 'string', NULL, count(c_mktsegment), NULL FROM customer
UNION ALL SELECT '*', 'star_mismatch', NULL, NULL, NULL, NULL""")
def shape_diff(t):
    candidate = t.customer.select(
        "c_custkey", "c_name", F.col("c_nationkey").cast("bigint").alias("c_nationkey"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"),
    )
    return C.shape_diff(t.customer, candidate)


@query("normalize_cells", """
SELECT CASE WHEN l_quantity = floor(l_quantity) THEN l_quantity::BIGINT::VARCHAR ELSE l_quantity::VARCHAR END AS l_quantity,
       CASE WHEN l_discount = floor(l_discount) THEN l_discount::BIGINT::VARCHAR ELSE l_discount::VARCHAR END AS l_discount,
       CASE WHEN l_extendedprice = floor(l_extendedprice) THEN l_extendedprice::BIGINT::VARCHAR
            ELSE l_extendedprice::VARCHAR END AS l_extendedprice,
       l_returnflag AS flag_bytes, l_orderkey::VARCHAR AS l_orderkey
FROM lineitem""")
def normalize_cells(t):
    return C.normalize_cells(
        t.lineitem.select(
            "l_quantity", "l_discount", "l_extendedprice",
            F.encode("l_returnflag", "UTF-8").alias("flag_bytes"), "l_orderkey",
        )
    )


@query("result_summary", f"""WITH {_PAIR_BAG}
SELECT sum(ca)::BIGINT AS n_baseline, sum(cb)::BIGINT AS n_candidate,
       sum(greatest(ca - 1, 0))::BIGINT AS dup_baseline, sum(greatest(cb - 1, 0))::BIGINT AS dup_candidate,
       sum(greatest(ca - cb, 0))::BIGINT AS n_only_baseline, sum(greatest(cb - ca, 0))::BIGINT AS n_only_candidate,
       sum(ca) = sum(cb) AS row_count_match, true AS column_names_match, sum(abs(ca - cb)) = 0 AS is_equivalent
FROM j""")
def result_summary(t):
    return C.result_summary(_status_pairs(t, 100000), _status_pairs(t, 150000))


@query("duplicate_rows", """
SELECT l_orderkey, l_linenumber, count(*) AS copies, count(*) - 1 AS excess
FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_rows(t):
    return C.duplicate_rows(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("cartesian_suspect", """
SELECT (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey) AS n_baseline,
       ((SELECT count(*) FROM customer) * (SELECT count(*) FROM nation))::DECIMAL(38,0) AS n_candidate,
       (SELECT count(*) FROM customer) * (SELECT count(*) FROM nation)
         > greatest(2 * (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey),
                    3 + (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey)) AS suspected""")
def cartesian_suspect(t):
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return C.cartesian_suspect(joined, [t.customer, t.nation])


@query("table_digest", """
WITH s AS (SELECT l_returnflag, sha256(concat(
    length(l_orderkey::VARCHAR), ':', l_orderkey, length(l_linenumber::VARCHAR), ':', l_linenumber,
    length(l_returnflag), ':', l_returnflag)) AS h FROM lineitem)
SELECT l_returnflag, sum(('0x' || substr(h, 1, 15))::BIGINT)::DECIMAL(38,0) AS digest, count(*) AS n
FROM s GROUP BY 1""")
def table_digest(t):
    return C.table_digest(t.lineitem, ["l_orderkey", "l_linenumber", "l_returnflag"], by=["l_returnflag"])


_REVENUE = "sum((l_extendedprice * 100)::BIGINT)::BIGINT AS revenue"


@query("repair_check", f"""WITH
  v AS (SELECT 'base' AS v, l_returnflag, {_REVENUE} FROM lineitem WHERE l_discount >= 0.05 GROUP BY 2
        UNION ALL SELECT 'cand', l_returnflag, {_REVENUE} FROM lineitem WHERE l_discount > 0.05 GROUP BY 2
        UNION ALL SELECT 'operator', l_returnflag, {_REVENUE} FROM lineitem WHERE l_discount >= 0.05 GROUP BY 2
        UNION ALL SELECT 'literal', l_returnflag, {_REVENUE} FROM lineitem WHERE l_discount > 0.04 AND l_quantity > 1 GROUP BY 2),
  d AS (SELECT x.v, y.v AS w, count(*) FILTER (WHERE x.revenue <> y.revenue) * 2 AS n
        FROM v x JOIN v y ON x.l_returnflag = y.l_returnflag GROUP BY 1, 2)
SELECT w AS repair, (SELECT n FROM d WHERE v = 'base' AND w = 'cand') AS n_before, n AS n_after,
       (SELECT n FROM d WHERE v = 'base' AND w = 'cand') > 0 AND n = 0 AS fixed_by_replacement
FROM d WHERE v = 'base' AND w IN ('operator', 'literal')""")
def repair_check(t):
    def revenue(where):
        cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
        return t.lineitem.where(where).groupBy("l_returnflag").agg(F.sum(cents).alias("revenue"))

    return C.repair_check(
        revenue("l_discount >= 0.05D"), revenue("l_discount > 0.05D"),
        {"operator": revenue("l_discount >= 0.05D"), "literal": revenue("l_discount > 0.04D and l_quantity > 1")},
    )
