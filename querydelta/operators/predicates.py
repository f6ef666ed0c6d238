"""What a changed predicate or projection does to the rows of one table.

Every operator here is one scan with conditional counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querydelta.functions.logic import (
    as_column, compare, direction, keep, long_form, tally, truth_label, with_flag,
)
from querydelta.functions.text import glob_regex

Predicate = Column | str | None


def truth_profile(df: DataFrame, predicate: Column | str) -> DataFrame:
    """Rows for which the predicate is TRUE, FALSE or UNKNOWN."""
    label = truth_label(predicate)
    return with_flag(tally(df, {path: label == path for path in ("TRUE", "FALSE", "UNKNOWN")}))


def predicate_divergence(df: DataFrame, baseline: Predicate, candidate: Predicate) -> DataFrame:
    """The rows kept by exactly one version; ``None`` stands for an absent predicate."""
    return df.withColumn("direction", direction(keep(baseline), keep(candidate))).where(
        "direction is not null"
    )


def divergence_counts(df: DataFrame, baseline: Predicate, candidate: Predicate) -> DataFrame:
    """Rows kept by both, by neither, and by one version only."""
    a, b = keep(baseline), keep(candidate)
    return with_flag(
        tally(df, {"both": a & b, "neither": ~a & ~b, "baseline_only": a & ~b, "candidate_only": b & ~a})
    )


def boolean_truth_table(
    df: DataFrame, leaves: Sequence[Column | str], baseline: Predicate, candidate: Predicate
) -> DataFrame:
    """Observed assignments of the leaf predicates and the divergent rows of each.

    ``full_binary_truth_table`` tells whether every TRUE/FALSE assignment occurs.
    """
    labels = [F.substring(truth_label(leaf), 1, 1) for leaf in leaves]
    divergent = keep(baseline) != keep(candidate)
    table = df.groupBy(F.concat_ws("|", *labels).alias("assignment")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(divergent).alias("n_divergent")
    )
    everything = Window.partitionBy(F.lit(1))  # at most 3^leaves rows
    binary = F.sum(F.when(~F.col("assignment").contains("U"), 1).otherwise(0)).over(everything)
    return table.withColumn("full_binary_truth_table", binary == 2 ** len(leaves))


def boundary_tristate(
    df: DataFrame, column: Column | str, value, op_baseline: str, op_candidate: str,
    value_candidate=None,
) -> DataFrame:
    """Rows below, at and above a literal, and how many change sides.

    ``value`` may be a number, text, date or expression; ``value_candidate``
    is the literal of the candidate when the literal itself moved.
    """
    cell = as_column(column)
    bound = value if isinstance(value, Column) else F.lit(value)
    moved = bound if value_candidate is None else value_candidate
    divergent = keep(compare(cell, op_baseline, bound)) != keep(compare(cell, op_candidate, moved))
    paths = {
        "below": keep(cell < bound), "at": keep(cell == bound),
        "above": keep(cell > bound), "null": cell.isNull(),
    }
    return with_flag(tally(df, paths, divergent))


def in_list_paths(
    df: DataFrame, column: Column | str, baseline: Sequence, candidate: Sequence,
    negated_baseline: bool = False, negated_candidate: bool = False,
) -> DataFrame:
    """Rows per listed value and membership path; values outside both lists are one row."""
    cell = as_column(column)
    in_a, in_b = cell.isin(*baseline), cell.isin(*candidate)
    listed = cell.isin(*dict.fromkeys([*baseline, *candidate]))
    path = (
        F.when(cell.isNull(), "null").when(in_a & in_b, "both")
        .when(in_a, "baseline_only").when(in_b, "candidate_only").otherwise("outside")
    )
    kept_a = keep(~in_a if negated_baseline else in_a)
    kept_b = keep(~in_b if negated_candidate else in_b)
    return (
        df.select(
            F.when(listed, cell.cast("string")).alias("value"), path.alias("path"),
            (kept_a != kept_b).alias("divergent__"),
        )
        .groupBy("value", "path")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("divergent__")).alias("n_divergent"))
    )


def _separation(df: DataFrame, baseline: Column, candidate: Column) -> DataFrame:
    return divergence_counts(df, baseline, candidate).where("path in ('baseline_only', 'candidate_only')") \
        .withColumnRenamed("path", "direction")


def like_separation(
    df: DataFrame, column: str, baseline: str, candidate: str,
    escape_baseline: str = "\\", escape_candidate: str = "\\",
    negated_baseline: bool = False, negated_candidate: bool = False,
    ignore_case: bool = False,
) -> DataFrame:
    """Rows matched by only one LIKE pattern; NULL matches neither."""
    match = F.ilike if ignore_case else F.like
    a = match(F.col(column), F.lit(baseline), F.lit(escape_baseline))
    b = match(F.col(column), F.lit(candidate), F.lit(escape_candidate))
    return _separation(df, ~a if negated_baseline else a, ~b if negated_candidate else b)


def glob_separation(df: DataFrame, column: str, baseline: str, candidate: str) -> DataFrame:
    """Rows matched by only one case-sensitive shell pattern."""
    cell = F.col(column)
    return _separation(df, cell.rlike(glob_regex(baseline)), cell.rlike(glob_regex(candidate)))


def regex_separation(df: DataFrame, column: str, baseline: str, candidate: str) -> DataFrame:
    """Rows in which only one regex is found."""
    return _separation(df, F.col(column).rlike(baseline), F.col(column).rlike(candidate))


def null_paths(df: DataFrame, columns: Mapping[str, Column | str] | Sequence[str]) -> DataFrame:
    """NULL and non-NULL rows per column and the resulting path shape."""
    if not isinstance(columns, Mapping):
        columns = {name: name for name in columns}
    cells = {name: as_column(expression) for name, expression in columns.items()}
    counted = df.agg(
        *[F.count_if(cell.isNull()).alias(f"null{i}") for i, cell in enumerate(cells.values())],
        *[F.count(cell).alias(f"full{i}") for i, cell in enumerate(cells.values())],
    )
    entries = {
        name: {"n_null": F.col(f"null{i}"), "n_non_null": F.col(f"full{i}")}
        for i, name in enumerate(cells)
    }
    shape = (
        F.when((F.col("n_null") > 0) & (F.col("n_non_null") > 0), "both")
        .when(F.col("n_null") > 0, "null_only")
        .when(F.col("n_non_null") > 0, "non_null_only")
        .otherwise("empty")
    )
    return long_form(counted, "column", entries).withColumn("path_shape", shape)


def null_safe_paths(
    df: DataFrame, left: Column | str, right: Column | str, op_baseline: str, op_candidate: str
) -> DataFrame:
    """Same-row paths of ``left`` against a column or literal, and where ``=`` and ``<=>`` part."""
    a = as_column(left)
    b = as_column(right)
    divergent = keep(compare(a, op_baseline, b)) != keep(compare(a, op_candidate, b))
    return with_flag(
        tally(
            df,
            {
                "both_null": a.isNull() & b.isNull(),
                "one_null": a.isNull() != b.isNull(),
                "equal": keep(a == b),
                "unequal": keep(a != b),
            },
            divergent,
        )
    )


def case_coverage(
    df: DataFrame, whens: Sequence[Column | str], otherwise: Column | str | None = None
) -> DataFrame:
    """Per CASE branch: rows for which it holds and rows it is first to catch.

    The ``unmatched`` row also counts the rows whose value would be lost with
    the ELSE branch (``n_else_effect``).
    """
    hits = [keep(when) for when in whens]
    aggregates, entries = [], {}
    earlier = F.lit(False)
    for index, hit in enumerate(hits):
        aggregates += [
            F.count_if(hit).alias(f"h{index}"), F.count_if(hit & ~earlier).alias(f"f{index}")
        ]
        entries[f"when_{index + 1}"] = {
            "n_hits": F.col(f"h{index}"), "n_first": F.col(f"f{index}"),
            "n_else_effect": F.lit(0).cast("bigint"),
        }
        earlier = earlier | hit
    lost = F.lit(False) if otherwise is None else as_column(otherwise).isNotNull()
    aggregates += [F.count_if(~earlier).alias("u"), F.count_if(~earlier & lost).alias("e")]
    entries["unmatched"] = {
        "n_hits": F.col("u"), "n_first": F.col("u"), "n_else_effect": F.col("e")
    }
    return with_flag(long_form(df.agg(*aggregates), "branch", entries), "n_first")


def projection_effect(df: DataFrame, baseline: Column | str, candidate: Column | str) -> DataFrame:
    """Rows whose projected value stays, changes, becomes NULL or stops being NULL."""
    a, b = as_column(baseline), as_column(candidate)
    same = a.eqNullSafe(b)
    return with_flag(
        tally(
            df,
            {
                "same": same,
                "changed": ~same & a.isNotNull() & b.isNotNull(),
                "null_introduced": a.isNotNull() & b.isNull(),
                "null_removed": a.isNull() & b.isNotNull(),
            },
        )
    )


def projection_changes(
    df: DataFrame, baseline: Column | str, candidate: Column | str, keys: Sequence[str]
) -> DataFrame:
    """The rows behind ``projection_effect``: keys with both values."""
    return df.select(
        *keys, as_column(baseline).alias("v_baseline"), as_column(candidate).alias("v_candidate")
    ).where("not (v_baseline <=> v_candidate)")


def projection_boolean_tristate(df: DataFrame, predicate: Column | str) -> DataFrame:
    """``p`` projected bare against ``p IS TRUE``: the NULLs only the bare form shows."""
    return truth_profile(df, predicate).select(
        "path", "n",
        F.when(F.col("path") == "UNKNOWN", F.col("n")).otherwise(F.lit(0)).alias("n_null_bare"),
        F.lit(0).cast("bigint").alias("n_null_truth_test"),
    )


def projection_discriminators(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns that can tell two projections apart: at least two distinct non-NULL values."""
    counted = df.agg(
        *[F.count(F.col(name)).alias(f"n{i}") for i, name in enumerate(columns)],
        *[(F.min(name) < F.max(name)).alias(f"d{i}") for i, name in enumerate(columns)],
    )
    return long_form(
        counted, "column",
        {
            name: {
                "n_non_null": F.col(f"n{i}"),
                "discriminates": F.coalesce(F.col(f"d{i}"), F.lit(False)),
            }
            for i, name in enumerate(columns)
        },
    )
