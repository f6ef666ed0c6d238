"""IN, EXISTS, NOT IN and scalar subqueries, from counted keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querydelta.functions.logic import as_column, compare, keep, long_form, tally, with_flag
from querydelta.operators.joins import WIDE, key_pairs
from querydelta.operators.positions import null_safe_lookup

Pairs = Sequence[tuple[str, str]]


def _sum(expression: Column) -> Column:
    return F.coalesce(F.sum(expression), F.lit(0)).cast("bigint")


def membership_paths(outer: DataFrame, inner: DataFrame, outer_key: str, inner_key: str) -> DataFrame:
    """Values shared, values on one side only and NULLs, with the rows behind them."""
    pairs = key_pairs(outer, inner, [(outer_key, inner_key)])
    n_o, n_i, null = F.col("n_l"), F.col("n_r"), F.col("has_null")
    paths = {
        "overlap": (n_o > 0) & (n_i > 0),
        "outer_only": (n_i == 0) & ~null,
        "inner_only": (n_o == 0) & ~null,
        "outer_null": null & (n_o > 0),
        "inner_null": null & (n_i > 0),
    }
    aggregates, entries = [], {}
    for index, (path, condition) in enumerate(paths.items()):
        aggregates += [
            F.count_if(condition & ~null).alias(f"v{index}"),
            _sum(F.when(condition, n_o)).alias(f"o{index}"),
            _sum(F.when(condition, n_i)).alias(f"i{index}"),
        ]
        entries[path] = {
            "n_values": F.col(f"v{index}"), "n_outer_rows": F.col(f"o{index}"),
            "n_inner_rows": F.col(f"i{index}"),
        }
    return long_form(pairs.agg(*aggregates), "path", entries).withColumn(
        "satisfied", F.col("n_outer_rows") + F.col("n_inner_rows") > 0
    )


def null_antijoin_divergence(
    outer: DataFrame, inner: DataFrame, outer_key: str, inner_key: str
) -> DataFrame:
    """Rows NOT EXISTS returns and NOT IN does not, by the NULL that is to blame.

    One NULL in the inner column empties NOT IN; a NULL outer key is UNKNOWN
    there unless the inner side has no rows at all.
    """
    pairs = key_pairs(outer, inner, [(outer_key, inner_key)])
    row = pairs.agg(
        _sum(F.when((F.col("n_r") == 0) & ~F.col("has_null"), F.col("n_l"))).alias("dangling"),
        _sum(F.when(F.col("has_null"), F.col("n_l"))).alias("null_outer"),
        _sum(F.when(F.col("has_null"), F.col("n_r"))).alias("null_inner"),
        _sum(F.col("n_r")).alias("inner_rows"),
    )
    none = F.lit(0).cast("bigint")
    empty, poisoned = F.col("inner_rows") == 0, F.col("null_inner") > 0
    return long_form(
        row, "path",
        {
            "both": {
                "n": F.when(empty, F.col("dangling") + F.col("null_outer"))
                .when(poisoned, none).otherwise(F.col("dangling"))
            },
            "not_exists_only_inner_null": {"n": F.when(poisoned, F.col("dangling")).otherwise(none)},
            "not_exists_only_outer_null": {"n": F.when(empty, none).otherwise(F.col("null_outer"))},
        },
    )


def null_antijoin_rows(
    outer: DataFrame, inner: DataFrame, outer_key: str, inner_key: str
) -> DataFrame:
    """The outer rows behind ``null_antijoin_divergence``.

    An ordinary anti join and a one-row NULL flag; a null-aware anti join would
    send the whole inner side to every executor.
    """
    key = as_column(outer_key)
    values = inner.select(as_column(inner_key).alias("inner__"))
    facts = values.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("inner__").isNull()).alias("nulls")
    )
    unmatched = outer.join(values.where("inner__ is not null").distinct(), key == F.col("inner__"), "left_anti")
    return unmatched.where(
        (facts.select(F.col("nulls") > 0).scalar())
        | (key.isNull() & facts.select(F.col("rows") > 0).scalar())
    )


def membership_key_drift(
    outer: DataFrame, baseline: tuple[DataFrame, Pairs], candidate: tuple[DataFrame, Pairs]
) -> DataFrame:
    """Outer rows admitted under only one of two membership (or correlation) keys.

    Each version is ``(inner, [(outer expression, inner expression), ...])``.
    The outer side is counted per key tuple before it meets the inner keys.
    """
    named = {}
    for tag, (_, on) in (("a", baseline), ("b", candidate)):
        for index, (expression, _) in enumerate(on):
            named[f"{tag}{index}"] = as_column(expression)
    counted = outer.groupBy(*[column.alias(name) for name, column in named.items()]).agg(
        F.count(F.lit(1)).alias("n")
    )
    for tag, (inner, on) in (("a", baseline), ("b", candidate)):
        keys = inner.select(
            *[as_column(expression).alias(f"{tag}i{index}") for index, (_, expression) in enumerate(on)]
        ).distinct().withColumn(f"{tag}_in", F.lit(True))
        same = None
        for index in range(len(on)):
            part = F.col(f"{tag}{index}") == F.col(f"{tag}i{index}")
            same = part if same is None else same & part
        counted = counted.join(keys, same, "left")
    in_a, in_b = F.coalesce("a_in", F.lit(False)), F.coalesce("b_in", F.lit(False))
    paths = {
        "both": in_a & in_b, "baseline_only": in_a & ~in_b,
        "candidate_only": ~in_a & in_b, "neither": ~in_a & ~in_b,
    }
    aggregates, entries = [], {}
    for index, (path, condition) in enumerate(paths.items()):
        aggregates += [
            F.count_if(condition).alias(f"k{index}"), _sum(F.when(condition, F.col("n"))).alias(f"n{index}")
        ]
        entries[path] = {"n_keys": F.col(f"k{index}"), "n_rows": F.col(f"n{index}")}
    return with_flag(long_form(counted.agg(*aggregates), "direction", entries), "n_rows")


def in_vs_exists_divergence(
    outer: DataFrame, inner: DataFrame, outer_key: str, inner_key: str,
    predicate: Column | str | None = None,
) -> DataFrame:
    """Outer rows returned by IN, filtered IN, uncorrelated EXISTS and an inner join."""
    pairs = key_pairs(
        outer, inner, [(outer_key, inner_key)],
        right_extra=[F.count_if(keep(predicate)).alias("passing")],
    )
    passing = F.coalesce("passing", F.lit(0))
    member, filtered = F.col("n_r") > 0, passing > 0
    row = pairs.agg(
        _sum(F.when(member, F.col("n_l"))).alias("in"),
        _sum(F.when(filtered, F.col("n_l"))).alias("filtered"),
        _sum(F.col("n_l")).alias("outer"),
        _sum(passing).alias("inner"),
        F.coalesce(
            F.sum((F.col("n_l").cast("decimal(20,0)") * F.col("n_r").cast("decimal(18,0)")).cast(WIDE)),
            F.lit(0),
        ).cast(WIDE).alias("join"),
    )
    exists = F.when(F.col("inner") > 0, F.col("outer")).otherwise(F.lit(0))
    return long_form(
        row, "version",
        {
            "in": {"n_rows": F.col("in").cast(WIDE)},
            "in_filtered": {"n_rows": F.col("filtered").cast(WIDE)},
            "exists_uncorrelated": {"n_rows": exists.cast(WIDE)},
            "inner_join": {"n_rows": F.col("join")},
        },
    ).withColumn("delta_to_in", (F.col("n_rows") - row.select("in").scalar()).cast(WIDE))


def scalar_subquery_cardinality(
    outer: DataFrame, inner: DataFrame, on: Pairs, value: str
) -> DataFrame:
    """Outer rows whose correlated scalar subquery yields no row, one, or several.

    ``many_values`` is where ``=`` and ``IN`` differ; a NULL among the values
    counts as a value of its own.
    """
    cell = as_column(value)
    pairs = key_pairs(
        outer, inner, on,
        right_extra=[
            ((F.min(cell) < F.max(cell)) | ((F.count(cell) > 0) & (F.count(cell) < F.count(F.lit(1)))))
            .alias("differs")
        ],
    ).where("n_l > 0")
    n_r, differs = F.col("n_r"), F.coalesce("differs", F.lit(False))
    paths = {
        "zero": n_r == 0, "one": n_r == 1,
        "many_same_value": (n_r > 1) & ~differs, "many_values": (n_r > 1) & differs,
    }
    aggregates, entries = [], {}
    for index, (path, condition) in enumerate(paths.items()):
        aggregates += [
            F.count_if(condition).alias(f"k{index}"),
            _sum(F.when(condition, F.col("n_l"))).alias(f"n{index}"),
        ]
        entries[path] = {"n_keys": F.col(f"k{index}"), "n_rows": F.col(f"n{index}")}
    return with_flag(long_form(pairs.agg(*aggregates), "path", entries), "n_rows")


def scalar_aggregate_boundary(
    df: DataFrame, column: Column | str, aggregate: str, op_baseline: str, op_candidate: str,
    correlate: Sequence[str] = (), correlate_candidate: Sequence[str] | None = None,
) -> DataFrame:
    """Rows below, at and above an aggregate of the table or of their own group.

    ``n_divergent`` counts the rows that change with the comparison or with the
    correlation key (``correlate_candidate``).
    """
    cell = as_column(column)

    def bounded(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
        facts = df.groupBy(*keys).agg(F.expr(aggregate).alias(name))
        return null_safe_lookup(rows, facts, list(keys))

    rows = bounded(df, correlate, "bound__")
    other = "bound__"
    if correlate_candidate is not None:
        other = "bound_candidate__"
        rows = bounded(rows, correlate_candidate, other)
    a = keep(compare(cell, op_baseline, F.col("bound__")))
    b = keep(compare(cell, op_candidate, F.col(other)))
    paths = {
        "below": keep(cell < F.col("bound__")), "at": keep(cell == F.col("bound__")),
        "above": keep(cell > F.col("bound__")),
        "unknown": cell.isNull() | F.col("bound__").isNull(),
    }
    return with_flag(tally(rows, paths, a != b))
