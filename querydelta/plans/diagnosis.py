"""Difference records in, ranked findings and hints out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querydelta.operators import evidence as E
from querydelta.session import dealt, durable


@dataclass(frozen=True)
class Diagnosis:
    """The tables of one run, each written once."""

    diffs: DataFrame
    candidates: DataFrame
    members: DataFrame
    edges: DataFrame
    ranked: DataFrame


def diagnose(
    diffs: DataFrame, effects: DataFrame, mutations: DataFrame, distinguished_cases: DataFrame,
    nullable_columns: DataFrame, deps: DataFrame, signals: DataFrame | None = None,
    scope_ranks: DataFrame | None = None, parts: int | None = None,
) -> Diagnosis:
    """Grade, classify, group, link and rank the diffs of many cases.

    ``signals`` are the case-level facts of ``signal_diffs``. Every step that is
    read more than once is written to the scratch folder first. With ``parts``, diffs, effects, mutations and
    deps are tables dealt by case_id into so many parts (see ``dealt``) and all steps stay in them, so no rows move, but
    each case is handled by one task; otherwise the steps deal by all keys of a join.
    """
    def kept(df: DataFrame) -> DataFrame:
        return durable(df) if parts is None else dealt(df, "case_id", parts)

    graded = E.evidence_grade(E.logical_stage(diffs), effects, mutations, distinguished_cases)
    if parts is None:
        classified = E.classify_rule(graded, nullable_columns)
    else:
        classified = kept(
            E.classify_rule(kept(graded), nullable_columns, parts).select(*E.CANDIDATE_COLUMNS, "obligation_id")
        )
    usable = kept(E.drop_redundant_summaries(classified))
    if signals is not None:
        usable = kept(E.with_signals(usable, signals))
    candidates = E.build_candidates(usable)
    if signals is not None:
        unscoped = E.unscoped_candidates(usable, signals)
        candidates = candidates.unionByName(unscoped if parts is None else unscoped.repartition(parts, "case_id"))
    candidates = kept(candidates)
    members = kept(E.candidate_members(usable, candidates))
    edges = kept(E.causal_edges(candidates, members, deps, parts))
    ranked = kept(E.rank_candidates(candidates, scope_ranks, edges, dealt_by_case=parts is not None))
    return Diagnosis(usable, candidates, members, edges, ranked)


def findings(diagnosis: Diagnosis, runs: DataFrame, level: int, witnesses: DataFrame | None = None) -> DataFrame:
    """One hint per case at the given level.

    ``runs`` as for ``project_verdict``; ``witnesses``: case_id, witness (text).
    """
    primary = diagnosis.ranked.where("role = 'primary'").select("case_id", F.col("rule_id").alias("primary_rule"))
    packages = E.project_verdict(runs).select("case_id", "verdict").join(primary, "case_id", "left")
    if witnesses is None:
        packages = packages.withColumn("witness", F.lit(None).cast("string"))
    else:
        packages = packages.join(witnesses.select("case_id", "witness"), "case_id", "left")
    return E.hint_slot(packages, level)
