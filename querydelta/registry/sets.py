"""DISTINCT and set-operation probes on line items and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from querydelta.operators import sets as S
from querydelta.registry import query


@query("distinct_effect", """
WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_distinct, (sum(n) - count(*))::BIGINT AS n_excess,
       count(*) FILTER (WHERE n > 1) AS n_duplicate_tuples, sum(n) > count(*) AS satisfied FROM g""")
def distinct_effect(t):
    return S.distinct_effect(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("nested_distinct_effect", """
SELECT l_suppkey, count(DISTINCT l_orderkey) AS v_baseline, count(*) AS v_candidate
FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) <> count(*)""")
def nested_distinct_effect(t):
    return S.nested_distinct_effect(t.lineitem, ["l_orderkey", "l_suppkey"], ["l_suppkey"])


@query("nested_distinct_sum", """
WITH d AS (SELECT DISTINCT l_suppkey, l_partkey, l_quantity::BIGINT AS q FROM lineitem),
  a AS (SELECT l_suppkey, sum(q)::BIGINT AS v FROM d GROUP BY 1),
  b AS (SELECT l_suppkey, sum(l_quantity::BIGINT)::BIGINT AS v FROM lineitem GROUP BY 1)
SELECT l_suppkey, a.v AS v_baseline, b.v AS v_candidate FROM a JOIN b USING (l_suppkey) WHERE a.v <> b.v""")
def nested_distinct_sum(t):
    rows = t.lineitem.select("l_suppkey", "l_partkey", F.col("l_quantity").cast("bigint").alias("q"))
    return S.nested_distinct_effect(rows, ["l_suppkey", "l_partkey", "q"], ["l_suppkey"], "q")


# Suppliers and return flags of small parts against those of large parts, whose supplier keys are moved so that each side has its own.
_SIDES = """
  l AS (SELECT l_suppkey, l_returnflag, l_tax FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 25),
  r AS (SELECT l_suppkey + 3 AS l_suppkey, l_returnflag, l_tax FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 25)"""


def _sides(t):
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    moved = (F.col("l_suppkey") + 3).alias("l_suppkey")
    return (
        lines.where("p_size <= 25").select("l_suppkey", "l_returnflag", "l_tax"),
        lines.where("p_size > 25").select(moved, "l_returnflag", "l_tax"),
    )


_COPIES = f"""{_SIDES},
  c AS (SELECT sum(x) AS nl, sum(y) AS nr, l_suppkey, l_returnflag, l_tax FROM
        (SELECT *, 1 AS x, 0 AS y FROM l UNION ALL SELECT *, 0, 1 FROM r) GROUP BY ALL)"""


def _path(name, condition):
    return (
        f"SELECT '{name}' AS path, count(*) AS n, coalesce(sum(nl), 0)::BIGINT AS n_left, "
        f"coalesce(sum(nr), 0)::BIGINT AS n_right, count(*) > 0 AS satisfied FROM c WHERE {condition}"
    )


@query("set_paths", f"WITH {_COPIES} " + " UNION ALL ".join([
    _path("overlap", "nl > 0 AND nr > 0"), _path("left_only", "nr = 0"), _path("right_only", "nl = 0")]))
def set_paths(t):
    return S.set_paths(*_sides(t))


_CHANGES = [
    ("UNION", "UNION ALL"), ("UNION", "INTERSECT"), ("INTERSECT", "INTERSECT ALL"),
    ("EXCEPT", "EXCEPT ALL"), ("EXCEPT", "UNION"), ("INTERSECT ALL", "EXCEPT ALL"),
]


def _effect_sql():
    parts = []
    for a, b in _CHANGES:
        parts.append(f"""
SELECT '{a}' AS op_baseline, '{b}' AS op_candidate,
       (SELECT count(*) FROM (SELECT * FROM l {a} SELECT * FROM r)) AS n_baseline,
       (SELECT count(*) FROM (SELECT * FROM l {b} SELECT * FROM r)) AS n_candidate,
       (SELECT count(*) FROM ((SELECT * FROM l {a} SELECT * FROM r) EXCEPT ALL (SELECT * FROM l {b} SELECT * FROM r)))
         AS n_only_baseline,
       (SELECT count(*) FROM ((SELECT * FROM l {b} SELECT * FROM r) EXCEPT ALL (SELECT * FROM l {a} SELECT * FROM r)))
         AS n_only_candidate""")
    return f"WITH {_SIDES} " + " UNION ALL ".join(parts)


@query("set_op_effect", _effect_sql())
def set_op_effect(t):
    return S.set_op_effect(*_sides(t), _CHANGES)


@query("set_op_changes", f"""WITH {_COPIES}
SELECT l_suppkey, l_returnflag, l_tax, least(nl, nr)::BIGINT AS copies_baseline,
       greatest(nl - nr, 0)::BIGINT AS copies_candidate FROM c WHERE least(nl, nr) <> greatest(nl - nr, 0)""")
def set_op_changes(t):
    return S.set_op_changes(*_sides(t), "INTERSECT ALL", "EXCEPT ALL")
