"""Window probes on events, partitioned by user."""

from __future__ import annotations

from pyspark.sql import functions as F

from querydelta.operators import windows as W
from querydelta.registry import query

_E = """e AS (SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS day, round(value * 100)::BIGINT AS cents FROM events)"""


def _events(t):
    return t.events.select(
        "event_id", "user_id", "event_type", F.to_date("ts").alias("day"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
    )


def _values_sql(a, b):
    return f"""WITH {_E}, v AS (SELECT event_id, {a} AS v_baseline, {b} AS v_candidate FROM e)
SELECT * FROM v WHERE v_baseline IS DISTINCT FROM v_candidate"""


@query("window_path_profile", f"""WITH {_E},
  p AS (SELECT user_id, day, count(*) AS n FROM e GROUP BY ALL),
  q AS (SELECT user_id, sum(n) AS rows, count(*) AS vals, count(*) FILTER (WHERE n > 1) AS ties FROM p GROUP BY 1)
SELECT count(*) AS n_partitions, sum(rows)::BIGINT AS n_rows, sum(ties)::BIGINT AS n_tied_peer_groups,
       count(*) FILTER (WHERE vals > 1) AS n_ordered_partitions, 0::BIGINT AS n_null_order_rows FROM q""")
def window_path_profile(t):
    return W.window_path_profile(_events(t), ["user_id"], ["day"])


_PEERS = "OVER (PARTITION BY user_id ORDER BY day)"
_TOTAL = "OVER (PARTITION BY user_id ORDER BY day, event_id)"


@query("rank_function_divergence", _values_sql(f"rank() {_PEERS}", f"dense_rank() {_PEERS}"))
def rank_function_divergence(t):
    return W.rank_function_divergence(_events(t), ["user_id"], ["day"], "rank", "dense_rank", ["event_id"])


@query("rank_row_number", _values_sql(f"row_number() {_TOTAL}", f"rank() {_PEERS}"))
def rank_row_number(t):
    return W.rank_function_divergence(_events(t), ["user_id"], ["day"], "row_number", "rank", ["event_id"])


@query("rank_fractions", _values_sql(f"percent_rank() {_PEERS}", f"cume_dist() {_PEERS}"))
def rank_fractions(t):
    return W.rank_function_divergence(
        _events(t), ["user_id"], ["day"], "percent_rank", "cume_dist", ["event_id"]
    )


@query("rank_ntile", _values_sql(f"ntile(4) {_TOTAL}", f"row_number() {_TOTAL}"))
def rank_ntile(t):
    return W.rank_function_divergence(_events(t), ["user_id"], ["day"], "ntile", "row_number", ["event_id"])


@query("window_spec_divergence", _values_sql(
    "rank() OVER (PARTITION BY user_id ORDER BY cents DESC)",
    "rank() OVER (PARTITION BY user_id, event_type ORDER BY cents DESC)"))
def window_spec_divergence(t):
    return W.window_spec_divergence(
        _events(t), "rank", (["user_id"], ["cents desc"]), (["user_id", "event_type"], ["cents desc"]), ["event_id"]
    )


@query("window_direction", _values_sql(
    "row_number() OVER (PARTITION BY user_id ORDER BY day, event_id)",
    "row_number() OVER (PARTITION BY user_id ORDER BY day DESC, event_id)"))
def window_direction(t):
    return W.window_spec_divergence(
        _events(t), "row_number", (["user_id"], ["day"]), (["user_id"], ["day desc"]), ["event_id"]
    )


_N = "CASE WHEN event_type = 'error' THEN NULL ELSE cents END"


@query("window_null_placement", f"""WITH {_E}, s AS (SELECT event_id, user_id, {_N} AS c FROM e),
  v AS (SELECT event_id, rank() OVER (PARTITION BY user_id ORDER BY c NULLS FIRST) AS v_baseline,
               rank() OVER (PARTITION BY user_id ORDER BY c NULLS LAST) AS v_candidate FROM s)
SELECT * FROM v WHERE v_baseline <> v_candidate""")
def window_null_placement(t):
    rows = _events(t).withColumn("c", F.expr(_N))
    return W.window_spec_divergence(
        rows, "rank", (["user_id"], ["c nulls first"]), (["user_id"], ["c nulls last"]), ["event_id"]
    )


@query("window_aggregate_partition", _values_sql(
    "(sum(cents) OVER (PARTITION BY user_id))::BIGINT", "(sum(cents) OVER (PARTITION BY user_id, event_type))::BIGINT"))
def window_aggregate_partition(t):
    return W.window_spec_divergence(
        _events(t), "sum(cents)", (["user_id"], []), (["user_id", "event_type"], []), ["event_id"]
    )


_ROWS = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_RANGE = "RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


@query("frame_divergence", _values_sql(
    f"(sum(cents) OVER (PARTITION BY user_id ORDER BY day, event_id {_ROWS}))::BIGINT",
    f"(sum(cents) OVER (PARTITION BY user_id ORDER BY day {_RANGE}))::BIGINT"))
def frame_divergence(t):
    return W.frame_divergence(_events(t), "sum", "cents", ["user_id"], ["day"], "rows", "range", ["event_id"])


@query("frame_whole_partition", _values_sql(
    f"max(cents) OVER (PARTITION BY user_id ORDER BY day, event_id {_ROWS})",
    "max(cents) OVER (PARTITION BY user_id)"))
def frame_whole_partition(t):
    return W.frame_divergence(_events(t), "max", "cents", ["user_id"], ["day"], "rows", "whole", ["event_id"])


@query("frame_sliding", _values_sql(
    "(sum(cents) OVER (PARTITION BY user_id ORDER BY day, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))::BIGINT",
    "(sum(cents) OVER (PARTITION BY user_id ORDER BY day, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))::BIGINT"))
def frame_sliding(t):
    return W.frame_divergence(_events(t), "sum", "cents", ["user_id"], ["day"], (-2, 0), (-1, 1), ["event_id"])


# Doubles in a total order: both frames end at the row, so nothing may differ.
@query("frame_doubles_total_order", f"""WITH v AS (SELECT o_orderkey,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey {_ROWS}) AS DOUBLE) AS v_baseline,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey {_RANGE}) AS DOUBLE) AS v_candidate
  FROM orders)
SELECT * FROM v WHERE v_baseline <> v_candidate""")
def frame_doubles_total_order(t):
    return W.frame_divergence(t.orders, "sum", "o_totalprice", ["o_orderstatus"], ["o_orderkey"], "rows", "range", ["o_orderkey"])


@query("frame_doubles", f"""WITH l AS (SELECT *, CAST(o_totalprice AS DECIMAL(18, 2)) AS price FROM orders), v AS (SELECT o_orderkey,
  CAST(sum(price) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey {_ROWS}) AS DOUBLE) AS v_baseline,
  CAST(sum(price) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate {_RANGE}) AS DOUBLE) AS v_candidate FROM l)
SELECT * FROM v WHERE v_baseline <> v_candidate""")
def frame_doubles(t):
    return W.frame_divergence(t.orders, "sum", "o_totalprice", ["o_orderpriority"], ["o_orderdate"], "rows", "range", ["o_orderkey"])


def _wide_sql(function):
    frame = "OVER (PARTITION BY event_type ORDER BY day, event_id ROWS BETWEEN"
    value = f"{function}(cents)" if function != "sum" else "sum(cents)"
    return _values_sql(
        f"({value} {frame} 1500 PRECEDING AND 20 FOLLOWING))::BIGINT", f"({value} {frame} 2 PRECEDING AND CURRENT ROW))::BIGINT"
    )


def _wide(function):
    @query(f"frame_wide_{function}", _wide_sql(function))
    def frame_wide(t):
        return W.frame_divergence(_events(t), function, "cents", ["event_type"], ["day"], (-1500, 20), (-2, 0), ["event_id"])

    return frame_wide


for _function in ("sum", "min", "max", "count"):
    _wide(_function)


@query("first_last_descending", f"""WITH {_E}, s AS (SELECT event_id, user_id, event_type, day, {{n}} AS c FROM e), v AS (
  SELECT event_id, event_type AS v_baseline,
         last_value(event_type) OVER (PARTITION BY user_id ORDER BY c DESC NULLS FIRST, day, event_id DESC
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v_candidate,
         first_value(event_type) OVER (PARTITION BY user_id ORDER BY c DESC NULLS FIRST, day, event_id DESC) AS v_first FROM s)
SELECT * FROM v WHERE v_baseline <> v_candidate""".replace("{n}", _N))
def first_last_descending(t):
    rows = _events(t).withColumn("c", F.expr(_N))
    order = ["c desc nulls first", "day", "event_id desc"]
    return W.first_last_divergence(rows, "event_type", ["user_id"], order, ["event_id"])


def _edge_sql(function, frame):
    order = f"OVER (PARTITION BY user_id ORDER BY {{}}, event_id {frame})"
    return f"""WITH {_E}, s AS (SELECT user_id, event_id, day, event_type, {_N} AS c FROM e), v AS (
  SELECT user_id, {function}(c) {order.format('event_type DESC, day')} AS v_baseline,
         {function}(c) {order.format('c NULLS LAST, day DESC')} AS v_candidate FROM s)
SELECT user_id, count(*) AS n_rows, any_value(v_baseline) AS v_baseline, any_value(v_candidate) AS v_candidate
FROM v GROUP BY user_id HAVING any_value(v_baseline) IS DISTINCT FROM any_value(v_candidate)"""


_WHOLE = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"


@query("first_value_order", _edge_sql("first_value", _WHOLE))
def first_value_order(t):
    rows = _events(t).withColumn("c", F.expr(_N))
    return W.edge_value_divergence(rows, "c", ["user_id"], ["event_type desc", "day"], ["c nulls last", "day desc"], ["event_id"])


@query("last_value_order", _edge_sql("last_value", _WHOLE))
def last_value_order(t):
    rows = _events(t).withColumn("c", F.expr(_N))
    return W.edge_value_divergence(
        rows, "c", ["user_id"], ["event_type desc", "day"], ["c nulls last", "day desc"], ["event_id"], "last"
    )


@query("first_last_divergence", f"""WITH {_E}, v AS (
  SELECT event_id, cents AS v_baseline,
         last_value(cents) OVER (PARTITION BY user_id ORDER BY day, event_id
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v_candidate,
         first_value(cents) OVER (PARTITION BY user_id ORDER BY day, event_id) AS v_first FROM e)
SELECT * FROM v WHERE v_baseline <> v_candidate""")
def first_last_divergence(t):
    return W.first_last_divergence(_events(t), "cents", ["user_id"], ["day"], ["event_id"])


def _lag_sql(a, b, op_a, op_b):
    return f"""WITH {_E}, l AS (SELECT cents, {a} AS x, {b} AS y FROM e),
  p AS (SELECT CASE WHEN x IS NULL THEN 'null_lag' WHEN cents < x THEN 'below_lag' WHEN cents = x THEN 'equal_to_lag'
                    ELSE 'above_lag' END AS path, count(*) AS n,
               count(*) FILTER (WHERE coalesce(cents {op_a} x, false) <> coalesce(cents {op_b} y, false)) AS n_divergent
        FROM l GROUP BY 1)
SELECT path, coalesce(n, 0) AS n, coalesce(n_divergent, 0) AS n_divergent, coalesce(n, 0) > 0 AS satisfied
FROM (VALUES ('null_lag'), ('below_lag'), ('equal_to_lag'), ('above_lag')) v(path) LEFT JOIN p USING (path)"""


@query("lag_lead_paths", _lag_sql(f"lag(cents, 1) {_TOTAL}", f"lag(cents, 2) {_TOTAL}", ">", ">"))
def lag_lead_paths(t):
    return W.lag_lead_paths(_events(t), "cents", ["user_id"], ["day"], ["event_id"], 1, 2, ">", ">")


@query("lag_to_lead", _lag_sql(f"lag(cents, 1) {_TOTAL}", f"lead(cents, 1) {_TOTAL}", ">", ">="))
def lag_to_lead(t):
    return W.lag_lead_paths(_events(t), "cents", ["user_id"], ["day"], ["event_id"], 1, -1, ">", ">=")


def _filter_sql(rank, a, b):
    return f"""WITH {_E}, r AS (SELECT user_id, event_id, {rank} AS rank FROM e)
SELECT *, CASE WHEN {a} THEN 'baseline_only' ELSE 'candidate_only' END AS direction FROM r WHERE ({a}) <> ({b})"""


@query("window_filter_boundary", _filter_sql(
    "row_number() OVER (PARTITION BY user_id ORDER BY cents DESC, event_id)", "rank <= 3", "rank < 3"))
def window_filter_boundary(t):
    return W.window_filter_boundary(
        _events(t), ["user_id"], ["cents desc"], "row_number", 3, "<=", 3, "<", ["event_id"]
    )


@query("window_filter_rank", _filter_sql(
    "rank() OVER (PARTITION BY user_id ORDER BY day)", "rank = 1", "rank <= 2"))
def window_filter_rank(t):
    return W.window_filter_boundary(
        _events(t), ["user_id"], ["day"], "rank", 1, "=", 2, "<=", ["event_id"]
    )


@query("partition_sizes", """
WITH s AS (SELECT count(*) AS n FROM events GROUP BY user_id)
SELECT 'fewer' AS path, count(*) FILTER (WHERE n < 66) AS n, count(*) FILTER (WHERE n < 66) > 0 AS satisfied FROM s
UNION ALL SELECT 'exactly', count(*) FILTER (WHERE n = 66), count(*) FILTER (WHERE n = 66) > 0 FROM s
UNION ALL SELECT 'more', count(*) FILTER (WHERE n > 66), count(*) FILTER (WHERE n > 66) > 0 FROM s""")
def partition_sizes(t):
    return W.partition_sizes(t.events, ["user_id"], 66)
