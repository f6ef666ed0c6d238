"""One changed predicate, from the rows it touches to the rule it breaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querydelta.operators import compare as C
from querydelta.operators import datagen as D
from querydelta.operators import evidence as E
from querydelta.operators import predicates as P
from querydelta.sources.tables import Tables

_NAMES = {">": "GT", ">=": "GTE", "<": "LT", "<=": "LTE", "=": "EQ", "<>": "NEQ"}


def _section(name: str, rows: DataFrame, item: str, detail: str, n: str) -> DataFrame:
    return rows.select(
        F.lit(name).alias("section"), F.expr(item).cast("string").alias("item"),
        F.expr(detail).cast("string").alias("detail"), F.expr(n).cast("bigint").alias("n"),
    )


def boundary_change_report(
    df: DataFrame, column: str, literal: str, op_baseline: str, op_candidate: str,
    groups: Sequence[str], measure: str, keys: Sequence[str],
) -> DataFrame:
    """What changes when ``column op literal`` changes its operator, as one long table.

    ``measure`` is an aggregate over integers or decimals; ``literal`` is SQL
    text; ``keys`` identify the witness rows. Sections: ``boundary``,
    ``divergence``, ``result``, ``repair``, ``rule`` and ``witness``.
    """
    baseline, candidate = f"{column} {op_baseline} {literal}", f"{column} {op_candidate} {literal}"

    def result(where: str) -> DataFrame:
        return df.where(where).groupBy(*groups).agg(F.expr(measure).alias("value"))

    boundary = P.boundary_tristate(df, column, F.expr(literal), op_baseline, op_candidate)
    divergence = P.divergence_counts(df, baseline, candidate)
    changed = C.bag_diff(result(baseline), result(candidate))
    repair = C.repair_check(result(baseline), result(candidate), {"operator": result(baseline)})
    rows = P.predicate_divergence(df.select(*dict.fromkeys([*keys, column])), baseline, candidate)
    witness = D.witness_sample(rows, "direction", list(keys))

    # the diff record of this change, with the effect just measured as evidence
    record = divergence.groupBy().agg(
        (F.sum(F.when(F.col("path").endswith("_only"), F.col("n"))) > 0).alias("distinguished")
    ).select(
        F.lit("change").alias("case_id"), F.lit("d1").alias("diff_id"), F.lit("o1").alias("obligation_id"),
        F.lit("root").alias("scope_id"), F.lit("ROOT").alias("scope_kind"), F.lit("WHERE").alias("clause"),
        F.lit("comparison_operator_changed").alias("diff_type"), F.lit("").alias("target_table"),
        F.lit(column).alias("target_column"), F.lit(_NAMES[op_baseline]).alias("baseline_op"),
        F.lit(_NAMES[op_candidate]).alias("candidate_op"), F.lit(baseline).alias("baseline_sql"),
        F.lit(candidate).alias("candidate_sql"), F.lit(0.8).alias("severity"), "distinguished",
    )
    effects = record.select(
        "case_id", "diff_id", "distinguished", F.lit(True).alias("constraints_satisfied"),
        F.lit(False).alias("causal_attribution_verified"),
    )
    mutations = repair.select(
        F.lit("change").alias("case_id"), F.lit("m1").alias("mutation_test_id"),
        F.array(F.lit("d1")).alias("diff_ids"), F.array(F.lit("WHERE")).alias("mutation_scope"),
        F.array().cast("array<string>").alias("dependent_changes"), F.lit("exact").alias("binding_quality"),
        F.lit(True).alias("replacement_exec_ok"), "fixed_by_replacement",
    )
    diffs = record.drop("distinguished")
    graded = E.evidence_grade(
        E.logical_stage(diffs), effects, mutations, record.where("distinguished").select("case_id")
    )
    no_nullable = diffs.select(F.col("target_table").alias("table_name"), F.lit("").alias("column_name")).limit(0)
    ranked = E.rank_candidates(E.build_candidates(E.classify_rule(graded, no_nullable)))

    parts = [
        _section("boundary", boundary, "path", "concat(n_divergent, ' change')", "n"),
        _section("divergence", divergence, "path", "''", "n"),
        _section("result", changed, f"concat_ws('|', {', '.join(groups)})", "cast(value as string)",
                 "only_baseline - only_candidate"),
        _section("repair", repair, "repair", "cast(fixed_by_replacement as string)", "n_before - n_after"),
        _section("rule", ranked, "rule_id", "concat_ws(' ', role, evidence_grade)", "n_diffs"),
        _section("witness", witness, f"concat_ws('|', {', '.join(keys)})", "direction", "rank"),
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionAll(part)
    return report


def discount_change_report(t: Tables) -> DataFrame:
    """The revenue query with ``l_discount > 0.05`` in place of ``>= 0.05``."""
    return boundary_change_report(
        t.lineitem, "l_discount", "0.05D", ">=", ">", ["l_returnflag"],
        "sum(cast(round(l_extendedprice * 100) as bigint))",
        ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
    )
