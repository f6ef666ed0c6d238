"""Leak audits and evaluation roll-ups on conversations, documents, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from querydelta.operators import audit as A
from querydelta.registry import query

_SPACE = r"regexp_replace({0}, '\s+', ' ', 'g')"
_NORM = "lower(trim(" + _SPACE + "))"


def _norm(column):
    return _NORM.format(column)


# As the library compares: without the semicolons at the end, white space collapsed, lower case.
_SECRET = r"lower(trim(regexp_replace(regexp_replace({0}, '[\s;]+$', ''), '\s+', ' ', 'g')))"


# A turn is a payload, its conversation the case; the whole first turn is the secret.
def _payloads(t):
    quoted = F.to_json(F.struct(F.col("text").alias("message"), F.expr(
        "case when role = 'user' then named_struct('answer_sql', 'x', 'kept', array(1, 2)) end"
    ).alias("nested"), F.expr("case when role = 'assistant' then 'seen' end").alias("witness"), "turn"))
    return t.conversations.select(
        F.concat_ws("-", "conv_id", "turn").alias("payload_id"), F.col("conv_id").alias("case_id"),
        (F.col("turn") % 3 + 1).cast("int").alias("level"), quoted.alias("payload"),
        (F.col("role") == "assistant").alias("has_witness"),
    )


def _case_secrets(t):
    """The first turn of a conversation, with blanks before and a semicolon after it."""
    return t.conversations.where("turn = 0").select(
        F.col("conv_id").alias("case_id"), F.concat(F.lit("  "), "text", F.lit(";")).alias("secret")
    )


_TURNS = f"""sec AS (SELECT DISTINCT conv_id, {_SECRET.format("text")} AS s FROM conversations WHERE turn = 0),
  leaking AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations JOIN sec USING (conv_id)
              WHERE length(s) >= 8 AND contains({_SECRET.format("text")}, s))"""


@query("redact_payload", f"""
WITH {_TURNS}, x AS (SELECT *, EXISTS (FROM leaking l WHERE (l.conv_id, l.turn, l.role, l.text)
                       IS NOT DISTINCT FROM (c.conv_id, c.turn, c.role, c.text)) AS leak FROM conversations c)
SELECT concat_ws('-', conv_id, turn) AS payload_id, CASE WHEN leak THEN '[redacted reference content]' ELSE text END AS message,
       leak AS leaked, false AS has_answer, role = 'user' AS has_nested FROM x""")
def redact_payload(t):
    shown = A.redact_payload(_payloads(t).drop("level", "has_witness"), _case_secrets(t))
    body = F.from_json("payload", "message string, nested struct<answer_sql:string,kept:array<int>>")
    return shown.select("payload_id", body.alias("b")).select(
        "payload_id", "b.message", (F.col("b.message") == A.REDACTED).alias("leaked"),
        F.col("b.nested.answer_sql").isNotNull().alias("has_answer"), F.col("b.nested").isNotNull().alias("has_nested"),
    )


@query("audit_leaks", f"""
WITH {_TURNS}, p AS (SELECT concat_ws('-', conv_id, turn) AS payload_id, conv_id AS case_id, (turn % 3 + 1)::INT AS level, role
                     FROM conversations)
SELECT payload_id, case_id, level, 'forbidden_keys:answer_sql' AS issue FROM p WHERE role = 'user'
UNION ALL SELECT payload_id, case_id, level, 'witness_slot' FROM p WHERE (role = 'assistant') <> (role = 'assistant' AND level = 2)
UNION ALL SELECT DISTINCT concat_ws('-', conv_id, turn), conv_id, (turn % 3 + 1)::INT, 'full_reference' FROM leaking""")
def audit_leaks(t):
    return A.audit_leaks(_payloads(t), _case_secrets(t))


@query("corpus_leaks", f"""
WITH d AS (SELECT doc_id, {_norm("text")} AS t FROM documents), b AS (SELECT item_id, {_norm("text")} AS p FROM benchmark)
SELECT doc_id, item_id FROM d JOIN b ON contains(t, p)""")
def corpus_leaks(t):
    return A.corpus_leaks(t.documents, t.benchmark)


# Short passages: the first two words, and single long words, of benchmark items.
@query("corpus_leaks_short", f"""
WITH d AS (SELECT doc_id, {_norm("text")} AS t FROM documents),
  b AS (SELECT item_id, array_to_string(list_slice(string_split({_norm("text")}, ' '), 3, 2 + item_id % 4 + 1), ' ') AS p FROM benchmark)
SELECT doc_id, item_id FROM d JOIN b ON contains(t, p) WHERE length(p) >= 8""")
def corpus_leaks_short(t):
    words = F.split(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))), " ")
    short = t.benchmark.select(
        "item_id", F.array_join(F.slice(words, F.lit(3), (F.col("item_id") % 4 + 1).cast("int")), " ").alias("text")
    )
    return A.corpus_leaks(t.documents, short)


@query("dedupe_cases", f"""
SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY {_norm("text")}, lower(lang)""")
def dedupe_cases(t):
    return A.dedupe_cases(t.documents, "doc_id", ["text", "lang"])


@query("declared_counts", """
WITH a AS (SELECT lang, count(*) AS actual FROM documents GROUP BY 1),
  b AS (SELECT lang, count(DISTINCT text) AS declared FROM documents GROUP BY 1)
SELECT lang, declared, actual FROM a JOIN b USING (lang) WHERE declared <> actual""")
def declared_counts(t):
    declared = t.documents.select("lang", F.sha2("text", 256).alias("h")).distinct().groupBy("lang").agg(
        F.count(F.lit(1)).alias("declared")
    )
    return A.declared_counts(t.documents, declared, "lang")


_RESULTS = """res AS (SELECT o_orderkey AS id, o_orderpriority AS suite,
    CASE o_orderstatus WHEN 'F' THEN 'SUPPORTED' WHEN 'O' THEN 'KNOWN_GAP' ELSE 'SUPPORTED' END AS status,
    CASE o_orderstatus WHEN 'F' THEN 'NOT_EQUIVALENT' ELSE 'UNDECIDED' END AS conclusion,
    CASE o_orderstatus WHEN 'F' THEN 'INCORRECT' ELSE 'UNDECIDED' END AS verdict,
    CASE WHEN o_custkey % 5 < 2 THEN 'S2_BOUNDARY' WHEN o_custkey % 5 = 2 THEN 'S5_CASE_INCOMPLETE' END AS primary_rule,
    CASE WHEN o_custkey % 5 = 0 THEN 'CAUSAL_VERIFIED' WHEN o_custkey % 5 = 1 THEN 'REPAIR_VERIFIED' WHEN o_custkey % 5 = 2 THEN 'OUTPUT_ONLY' END AS primary_grade,
    (o_custkey % 3)::INT AS repair_fixed, o_totalprice < 400000 AS hint_safe, o_orderstatus <> 'P' AS executed,
    o_totalprice > 20000 AS replay_ok, o_custkey % 7 <> 0 AS has_evidence, o_custkey % 40 AS table_rows,
    o_custkey % 2 = 0 AS distinguished, o_totalprice > 100000 AS passed,
    CASE WHEN o_custkey % 7 <> 0 THEN 'PAIR_DISTINGUISHED' END AS availability FROM orders)"""


def _results(t):
    return t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("suite"),
        F.expr("case o_orderstatus when 'F' then 'SUPPORTED' when 'O' then 'KNOWN_GAP' else 'SUPPORTED' end").alias("status"),
        F.expr("case o_orderstatus when 'F' then 'NOT_EQUIVALENT' else 'UNDECIDED' end").alias("conclusion"),
        F.expr("case o_orderstatus when 'F' then 'INCORRECT' else 'UNDECIDED' end").alias("verdict"),
        F.expr("case when o_custkey % 5 < 2 then 'S2_BOUNDARY' when o_custkey % 5 = 2 then 'S5_CASE_INCOMPLETE' end").alias("primary_rule"),
        F.expr("""case o_custkey % 5 when 0 then 'CAUSAL_VERIFIED' when 1 then 'REPAIR_VERIFIED' when 2 then 'OUTPUT_ONLY' end""")
        .alias("primary_grade"),
        (F.col("o_custkey") % 3).cast("int").alias("repair_fixed"), (F.col("o_totalprice") < 400000).alias("hint_safe"),
        (F.col("o_orderstatus") != "P").alias("executed"), (F.col("o_totalprice") > 20000).alias("replay_ok"),
        (F.col("o_custkey") % 7 != 0).alias("has_evidence"), (F.col("o_custkey") % 40).alias("table_rows"),
        (F.col("o_custkey") % 2 == 0).alias("distinguished"), (F.col("o_totalprice") > 100000).alias("passed"),
        F.expr("case when o_custkey % 7 <> 0 then 'PAIR_DISTINGUISHED' end").alias("availability"),
    )


def _failure(condition, text):
    return f"SELECT id, {text} AS failure FROM j WHERE {condition}"


@query("check_expectations", f"""WITH {_RESULTS},
  j AS (SELECT res.*, CASE WHEN o_orderpriority = '1-URGENT' THEN 'SUPPORTED' END AS e_status,
          CASE WHEN o_orderpriority = '2-HIGH' THEN 'INCORRECT' END AS e_verdict, o_orderpriority = '3-MEDIUM' AS allowed,
          CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'UNDECIDED' END AS forbid,
          CASE WHEN o_totalprice < 100000 THEN true WHEN o_totalprice < 150000 THEN false END AS need_primary,
          CASE WHEN o_totalprice > 300000 THEN 'S2_BOUNDARY' END AS e_rule,
          o_orderpriority = '5-LOW' AS strict FROM res JOIN orders ON id = o_orderkey)
{' UNION ALL '.join([
    _failure("e_status <> status", "'status:expected=' || e_status || ':actual=' || status"),
    _failure("e_verdict <> verdict", "'verdict:expected=' || e_verdict || ':actual=' || verdict"),
    _failure("allowed AND conclusion <> 'NOT_EQUIVALENT'", "'allowed_conclusions:actual=' || conclusion"),
    _failure("forbid = conclusion", "'forbidden_conclusion:' || forbid"),
    _failure("need_primary AND primary_rule IS NULL", "'primary_missing'"),
    _failure("NOT need_primary AND primary_rule IS NOT NULL", "'unexpected_primary:' || primary_rule"),
    _failure("e_rule IS DISTINCT FROM primary_rule AND e_rule IS NOT NULL",
             "'primary_rule:expected=' || e_rule || ':actual=' || coalesce(primary_rule, 'None')"),
    _failure("strict AND coalesce(primary_grade, '') NOT IN ('CAUSAL_VERIFIED', 'REPAIR_VERIFIED')",
             "'primary_grade:minimum=REPAIR_VERIFIED:actual=' || coalesce(primary_grade, 'None')"),
    _failure("strict AND NOT has_evidence", "'evidence_missing'"),
    _failure("strict AND repair_fixed <= 0", "'repair_not_verified'"),
    _failure("strict AND NOT hint_safe", "'hint_audit_failed'"),
    _failure("executed AND NOT replay_ok", "'independent_replay_failed'"),
    _failure("executed AND table_rows > 32", "'table_row_limit_exceeded:' || table_rows"),
])}""")
def check_expectations(t):
    priority, price = F.col("o_orderpriority"), F.col("o_totalprice")
    strict = F.when(priority == "5-LOW", F.lit(True))
    expectations = t.orders.select(
        F.col("o_orderkey").alias("id"), F.when(priority == "1-URGENT", "SUPPORTED").alias("status"),
        F.when(priority == "2-HIGH", "INCORRECT").alias("verdict"),
        F.when(priority == "3-MEDIUM", F.array(F.lit("NOT_EQUIVALENT"))).alias("allowed_conclusions"),
        F.when(priority == "4-NOT SPECIFIED", "UNDECIDED").alias("forbid_conclusion"),
        F.when(price < 100000, True).when(price < 150000, False).alias("require_primary"),
        F.when(price > 300000, "S2_BOUNDARY").alias("primary_rule"),
        F.when(strict, "REPAIR_VERIFIED").alias("minimum_primary_grade"), strict.alias("require_evidence"),
        strict.alias("require_repair"), strict.alias("require_safe_hints"),
    )
    return A.check_expectations(_results(t), expectations, max_table_rows=32)


@query("check_expectations_sets", f"""WITH {_RESULTS},
  cand AS (SELECT DISTINCT l_orderkey AS id, CASE l_returnflag WHEN 'R' THEN 'S2_BOUNDARY' WHEN 'A' THEN 'S1_CARTESIAN_PRODUCT'
      ELSE 'S5_CASE_INCOMPLETE' END AS rule_id FROM lineitem),
  j AS (SELECT res.*, o_orderpriority = '1-URGENT' AS set_status, o_orderpriority = '2-HIGH' AS set_verdict,
      CASE WHEN o_custkey % 2 = 0 THEN 'S2_BOUNDARY' WHEN o_custkey % 3 = 0 THEN 'S5_CASE_INCOMPLETE' END AS e_candidate,
      o_orderpriority = '5-LOW' AS witnessed, o_totalprice > 50000 AS has_database FROM res JOIN orders ON id = o_orderkey)
{' UNION ALL '.join([
    _failure("set_status AND status <> 'SUPPORTED'", "'allowed_statuses:actual=' || status"),
    _failure("set_verdict AND verdict <> 'INCORRECT'", "'allowed_verdicts:actual=' || verdict"),
    _failure("e_candidate IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cand WHERE cand.id = j.id AND rule_id = e_candidate)",
             "'candidate_rule_missing:' || e_candidate"),
    _failure("witnessed AND NOT has_database", "'witness_database_missing'"),
    _failure("witnessed AND NOT distinguished", "'witness_not_distinguished'"),
    _failure("executed AND NOT replay_ok", "'independent_replay_failed'"),
])}""")
def check_expectations_sets(t):
    priority, customer = F.col("o_orderpriority"), F.col("o_custkey")
    flag = F.col("l_returnflag")
    candidates = t.lineitem.select(
        F.col("l_orderkey").alias("id"),
        F.when(flag == "R", "S2_BOUNDARY").when(flag == "A", "S1_CARTESIAN_PRODUCT").otherwise("S5_CASE_INCOMPLETE").alias("rule_id"),
    )
    expectations = t.orders.select(
        F.col("o_orderkey").alias("id"), F.when(priority == "1-URGENT", F.array(F.lit("SUPPORTED"))).alias("allowed_statuses"),
        F.when(priority == "2-HIGH", F.array(F.lit("INCORRECT"))).alias("allowed_verdicts"),
        F.when(customer % 2 == 0, "S2_BOUNDARY").when(customer % 3 == 0, "S5_CASE_INCOMPLETE").alias("candidate_rule"),
        F.when(priority == "5-LOW", F.lit(True)).alias("require_witness"),
    )
    database = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") > 50000).alias("has_database"))
    return A.check_expectations(_results(t).join(database, "id"), expectations, candidates=candidates)


# A case is a user; the replay misses errors above a value and has another view value.
@query("replay_agreement", """
WITH a AS (SELECT user_id, event_type, round(value * 100)::BIGINT AS cents FROM events),
  b AS (SELECT user_id, event_type, CASE WHEN event_type = 'view' AND cents > 20000 THEN cents + 1 ELSE cents END AS cents
        FROM a WHERE NOT (event_type = 'error' AND cents > 18000)),
  u AS (SELECT user_id, event_type, cents, sum(x) AS x, sum(y) AS y FROM
        (SELECT *, 1 AS x, 0 AS y FROM a UNION ALL SELECT *, 0, 1 FROM b) GROUP BY ALL)
SELECT user_id, sum(x)::BIGINT AS n_recorded, sum(y)::BIGINT AS n_replayed, sum(abs(x - y))::BIGINT AS n_different,
       user_id % 10 <> 3 AS same_error_state, user_id % 10 <> 3 AND sum(abs(x - y)) = 0 AS agrees FROM u GROUP BY 1""")
def replay_agreement(t):
    recorded = t.events.select("user_id", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    replayed = recorded.where("not (event_type = 'error' and cents > 18000)").withColumn(
        "cents", F.expr("case when event_type = 'view' and cents > 20000 then cents + 1 else cents end")
    )
    errors = t.events.select(
        "user_id", (F.col("user_id") % 10 == 3).alias("recorded_error"), F.lit(False).alias("replayed_error")
    ).distinct()
    return A.replay_agreement(recorded, replayed, "user_id", errors)


# The two repeats of a user are its events before and after noon.
_RUNS = """runs AS (SELECT CASE WHEN hour(ts) < 12 THEN 1 ELSE 2 END AS repeat, user_id AS id,
    CASE WHEN count(*) FILTER (WHERE event_type = 'purchase') > 6 THEN 'many' ELSE 'few' END AS digest FROM events GROUP BY ALL)"""


@query("run_determinism", f"""WITH {_RUNS.replace('GROUP BY ALL', 'GROUP BY 1, 2')}
SELECT b.repeat, b.id, a.digest AS expected, b.digest AS actual FROM runs a JOIN runs b USING (id)
WHERE a.repeat = 1 AND b.repeat = 2 AND a.digest <> b.digest""")
def run_determinism(t):
    runs = t.events.groupBy(
        F.when(F.hour("ts") < 12, 1).otherwise(2).alias("repeat"), F.col("user_id").alias("id")
    ).agg(F.when(F.count_if(F.col("event_type") == "purchase") > 6, "many").otherwise("few").alias("digest"))
    return A.run_determinism(runs)


def _metric(name, condition, key="'all'", where="true"):
    return f"SELECT '{name}' AS metric, {key} AS name, count(*) FILTER (WHERE {condition}) AS value FROM res WHERE {where} GROUP BY ALL"


@query("suite_report", f"WITH {_RESULTS} " + " UNION ALL ".join([
    _metric("cases", "true"), _metric("passed", "passed"), _metric("failed", "NOT passed"),
    _metric("repair_verified_cases", "repair_fixed > 0"), _metric("hint_safe_cases", "hint_safe"),
    _metric("distinguished_cases", "distinguished"), _metric("replay_cases", "executed"),
    _metric("replay_passed", "executed AND replay_ok"), _metric("suite_total", "true", "suite"),
    _metric("suite_passed", "passed", "suite"), _metric("status", "true", "status"),
    _metric("conclusion", "true", "conclusion"), _metric("verdict", "true", "verdict"),
    _metric("primary_rule", "true", "primary_rule", "primary_rule IS NOT NULL"),
    _metric("witness_availability", "true", "coalesce(availability, 'NONE')"),
    "SELECT 'max_table_rows', 'all', max(table_rows) FROM res"]))
def suite_report(t):
    return A.suite_report(_results(t))
