"""DISTINCT and set operations, from copies counted per tuple."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querydelta.functions.logic import as_column, long_form, with_flag
from querydelta.operators.compare import copies_per_row

SET_OPERATORS = ("UNION", "UNION ALL", "INTERSECT", "INTERSECT ALL", "EXCEPT", "EXCEPT ALL")


def distinct_effect(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows with and without DISTINCT and the duplicates it removes."""
    copies = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return copies.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_excess"),
        F.count_if(F.col("n") > 1).alias("n_duplicate_tuples"),
    ).withColumn("satisfied", F.col("n_excess") > 0)


def nested_distinct_effect(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str], measure: Column | str | None = None
) -> DataFrame:
    """Does an inner DISTINCT over ``columns`` change the outer COUNT or SUM per ``keys``?

    Copies are counted per tuple once; the raw aggregate weighs each tuple by
    its copies.
    """
    tuples = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies__"))
    value = F.lit(1).cast("bigint") if measure is None else as_column(measure)
    groups = tuples.groupBy(*keys).agg(
        F.sum(value).alias("v_baseline"), F.sum(value * F.col("copies__")).alias("v_candidate")
    )
    return groups.where("not (v_baseline <=> v_candidate)")


def set_paths(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct tuples on both sides, left only and right only."""
    counted = copies_per_row({"n_l__": left, "n_r__": right})
    n_l, n_r = F.col("n_l__"), F.col("n_r__")
    paths = {"overlap": (n_l > 0) & (n_r > 0), "left_only": n_r == 0, "right_only": n_l == 0}
    aggregates, entries = [], {}
    for index, (path, condition) in enumerate(paths.items()):
        aggregates += [
            F.count_if(condition).alias(f"t{index}"),
            F.coalesce(F.sum(F.when(condition, n_l)), F.lit(0)).alias(f"l{index}"),
            F.coalesce(F.sum(F.when(condition, n_r)), F.lit(0)).alias(f"r{index}"),
        ]
        entries[path] = {
            "n": F.col(f"t{index}"), "n_left": F.col(f"l{index}"), "n_right": F.col(f"r{index}")
        }
    return with_flag(long_form(counted.agg(*aggregates), "path", entries))


def result_copies(operator: str) -> Column:
    """Copies of a tuple in a set operation, from its copies on either side."""
    n_l, n_r = F.col("n_l__"), F.col("n_r__")
    closed_form = {
        "UNION": F.lit(1),
        "UNION ALL": n_l + n_r,
        "INTERSECT": F.when((n_l > 0) & (n_r > 0), 1).otherwise(0),
        "INTERSECT ALL": F.least(n_l, n_r),
        "EXCEPT": F.when((n_l > 0) & (n_r == 0), 1).otherwise(0),
        "EXCEPT ALL": F.greatest(n_l - n_r, F.lit(0)),
    }
    return closed_form[operator].cast("bigint")


def set_op_effect(
    left: DataFrame, right: DataFrame, changes: Sequence[tuple[str, str]]
) -> DataFrame:
    """Rows that change when one set operator replaces another, for every listed change.

    One shuffle serves all six operators.
    """
    counted = copies_per_row({"n_l__": left, "n_r__": right})
    aggregates, structs = [], []
    for index, (baseline, candidate) in enumerate(changes):
        a, b = result_copies(baseline), result_copies(candidate)
        sums = {
            "n_baseline": a, "n_candidate": b,
            "n_only_baseline": F.greatest(a - b, F.lit(0)), "n_only_candidate": F.greatest(b - a, F.lit(0)),
        }
        aggregates += [
            F.coalesce(F.sum(value), F.lit(0)).alias(f"{name}{index}") for name, value in sums.items()
        ]
        structs.append(
            F.struct(
                F.lit(baseline).alias("op_baseline"), F.lit(candidate).alias("op_candidate"),
                *[F.col(f"{name}{index}").alias(name) for name in sums],
            )
        )
    return counted.agg(*aggregates).select(F.explode(F.array(*structs)).alias("entry")).select("entry.*")


def set_op_changes(left: DataFrame, right: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """The tuples whose number of copies differs between two set operators."""
    counted = copies_per_row({"n_l__": left, "n_r__": right})
    return counted.select(
        *left.columns, result_copies(baseline).alias("copies_baseline"),
        result_copies(candidate).alias("copies_candidate"),
    ).where("copies_baseline <> copies_candidate")
