"""Composed reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from querydelta.plans.change_report import discount_change_report
from querydelta.plans.diagnosis import diagnose, findings
from querydelta.registry import evidence as R
from querydelta.registry import query

_CENTS = "sum((l_extendedprice * 100)::BIGINT)::BIGINT"


@query("discount_change_report", f"""
WITH a AS (SELECT l_returnflag AS g, {_CENTS} AS v FROM lineitem WHERE l_discount >= 0.05 GROUP BY 1),
  b AS (SELECT l_returnflag AS g, {_CENTS} AS v FROM lineitem WHERE l_discount > 0.05 GROUP BY 1),
  c AS (SELECT count(*) FILTER (WHERE l_discount < 0.05) AS lo, count(*) FILTER (WHERE l_discount = 0.05) AS mid,
               count(*) FILTER (WHERE l_discount > 0.05) AS hi FROM lineitem),
  w AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rank FROM lineitem
        WHERE l_discount = 0.05 QUALIFY rank <= 6),
  d AS (SELECT count(*) AS n FROM a JOIN b USING (g) WHERE a.v <> b.v)
SELECT 'boundary' AS section, 'below' AS item, '0 change' AS detail, lo AS n FROM c
UNION ALL SELECT 'boundary', 'at', mid || ' change', mid FROM c
UNION ALL SELECT 'boundary', 'above', '0 change', hi FROM c
UNION ALL SELECT 'boundary', 'null', '0 change', 0 FROM c
UNION ALL SELECT 'divergence', 'both', '', hi FROM c
UNION ALL SELECT 'divergence', 'neither', '', lo FROM c
UNION ALL SELECT 'divergence', 'baseline_only', '', mid FROM c
UNION ALL SELECT 'divergence', 'candidate_only', '', 0 FROM c
UNION ALL SELECT 'result', g, v::VARCHAR, 1 FROM a WHERE (g, v) NOT IN (SELECT (g, v) FROM b)
UNION ALL SELECT 'result', g, v::VARCHAR, -1 FROM b WHERE (g, v) NOT IN (SELECT (g, v) FROM a)
UNION ALL SELECT 'repair', 'operator', 'true', 2 * n FROM d
UNION ALL SELECT 'rule', 'S2_BOUNDARY', 'primary REPAIR_VERIFIED', 1
UNION ALL SELECT 'witness', concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey), 'baseline_only', rank FROM w""")
def change_report(t):
    return discount_change_report(t)


@query("diagnosis_hints", f"""WITH {R._RANKED}, {R._VERDICTS},
  p AS (SELECT case_id, rule_id FROM ranked WHERE role = 'primary')
SELECT verdict, coalesce(rule_id, 'none') AS rule, count(*) AS n_cases
FROM verdicts LEFT JOIN p USING (case_id) GROUP BY ALL""")
def diagnosis_hints(t):
    lines, parts = R._dealt_lines(t)
    run = diagnose(
        R._described(R._keyed(lines)), R._effects(lines), R._mutations(lines), R._distinguished(t), R._nullable(t),
        R._deps(lines), R._cases(t), R._scope_ranks(t), parts,
    )
    primary = run.ranked.where("role = 'primary'").select("case_id", "rule_id")
    hints = findings(run, R._runs(t), 1)
    verdicts = R.E.project_verdict(R._runs(t)).select("case_id", "verdict")
    return (
        hints.join(primary, "case_id", "left").join(verdicts, "case_id")
        .groupBy("verdict", F.coalesce("rule_id", F.lit("none")).alias("rule"))
        .agg(F.count(F.lit(1)).alias("n_cases"))
    )
