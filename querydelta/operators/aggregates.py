"""Grouping, HAVING and aggregate changes.

Aggregates are given as SQL text (``"sum(x)"``); all of them combine before the
shuffle, so a hot group reaches its reducer as one row per input partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querydelta.functions.logic import (
    as_column, compare, direction, keep, long_form, tally, with_flag,
)
from querydelta.operators.joins import Pairs, fanout_inflation
from querydelta.operators.positions import running


def group_grain_diff(df: DataFrame, baseline: Sequence[str], candidate: Sequence[str]) -> DataFrame:
    """Groups of each grain that the other grain splits, and how the grains relate.

    Works for GROUP BY and PARTITION BY lists; an empty list is one global group.
    """
    columns = list(dict.fromkeys([*baseline, *candidate]))
    pairs = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))

    def side(keys: Sequence[str], name: str) -> DataFrame:
        groups = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"))
        return groups.agg(
            F.count(F.lit(1)).alias("n_groups"),
            F.count_if(F.col("parts") > 1).alias("n_split"),
            F.coalesce(F.sum(F.when(F.col("parts") > 1, F.col("n"))), F.lit(0)).alias("n_split_rows"),
        ).select(F.lit(name).alias("side"), "*")

    both = side(baseline, "baseline").unionAll(side(candidate, "candidate"))
    row = both.agg(
        *[
            F.max(F.when(F.col("side") == name, F.col(column))).alias(f"{name}_{column}")
            for name in ("baseline", "candidate")
            for column in ("n_groups", "n_split", "n_split_rows")
        ]
    )
    a, b = F.col("baseline_n_split") > 0, F.col("candidate_n_split") > 0
    verdict = (
        F.when(a & b, "crossing").when(a, "candidate_finer").when(b, "candidate_coarser").otherwise("same")
    )
    return long_form(
        row, "side",
        {
            name: {
                **{column: F.col(f"{name}_{column}") for column in ("n_groups", "n_split", "n_split_rows")},
                "verdict": verdict,
            }
            for name in ("baseline", "candidate")
        },
    )


def group_size_profile(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: groups, groups of one row, groups with duplicates, largest group."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.count_if(F.col("n") == 1).alias("n_singleton"),
        F.count_if(F.col("n") > 1).alias("n_duplicate"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_size"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
    )


def _boundary(groups: DataFrame, value: Column, threshold, op_baseline: str, op_candidate: str,
              threshold_candidate=None) -> DataFrame:
    bound = F.lit(threshold)
    moved = bound if threshold_candidate is None else F.lit(threshold_candidate)
    divergent = keep(compare(value, op_baseline, bound)) != keep(compare(value, op_candidate, moved))
    paths = {
        "below": keep(value < bound), "at": keep(value == bound), "above": keep(value > bound),
        "null": value.isNull(),
    }
    return with_flag(tally(groups, paths, divergent))


def aggregate_boundary(
    df: DataFrame, keys: Sequence[str], aggregate: str, threshold, op_baseline: str, op_candidate: str,
    threshold_candidate=None, domain: DataFrame | None = None, empty_value=None,
) -> DataFrame:
    """Groups below, at and above a HAVING threshold and those only one version admits.

    ``domain`` lists all keys: keys without rows take part with ``empty_value``
    (0 for COUNT, NULL for the other aggregates).
    """
    groups = df.groupBy(*keys).agg(F.expr(aggregate).alias("value"))
    value = F.col("value")
    if domain is not None:
        present = groups.withColumn("present", F.lit(True))
        groups = domain.select(*keys).distinct().join(present, list(keys), "left")
        value = F.when(F.col("present"), value).otherwise(F.lit(empty_value))
    return _boundary(groups, value, threshold, op_baseline, op_candidate, threshold_candidate)


def aggregate_admission(
    df: DataFrame, keys: Sequence[str], aggregate: str, having_baseline: str, having_candidate: str
) -> DataFrame:
    """The groups admitted by only one HAVING; both conditions read ``value``."""
    groups = df.groupBy(*keys).agg(F.expr(aggregate).alias("value"))
    return groups.withColumn(
        "direction", direction(keep(having_baseline), keep(having_candidate))
    ).where("direction is not null")


def joined_aggregate_boundary(
    base: DataFrame, joined: DataFrame, on: Pairs, keys: Sequence[str], threshold,
    op_baseline: str, op_candidate: str, measure: str | None = None,
) -> DataFrame:
    """``aggregate_boundary`` on COUNT (or SUM of ``measure``) after an inner join.

    ``n_crossed`` counts the groups whose side of the threshold differs before
    the join: boundaries that only the multiplied rows reach.
    """
    groups = fanout_inflation(base, joined, on, measure or "1", keys).where("joined_count > 0")
    after = F.col("joined_count" if measure is None else "joined_sum")
    before = F.col("base_count" if measure is None else "base_sum")
    bound = F.lit(threshold)
    sides = {
        "below": keep(after < bound), "at": keep(after == bound), "above": keep(after > bound),
        "null": after.isNull(),
    }
    before_sides = {
        "below": keep(before < bound), "at": keep(before == bound), "above": keep(before > bound),
        "null": before.isNull(),
    }
    divergent = keep(compare(after, op_baseline, bound)) != keep(compare(after, op_candidate, bound))
    aggregates, entries = [], {}
    for index, path in enumerate(sides):
        aggregates += [
            F.count_if(sides[path]).alias(f"n{index}"),
            F.count_if(sides[path] & divergent).alias(f"d{index}"),
            F.count_if(sides[path] & ~before_sides[path]).alias(f"c{index}"),
        ]
        entries[path] = {
            "n": F.col(f"n{index}"), "n_divergent": F.col(f"d{index}"), "n_crossed": F.col(f"c{index}")
        }
    return with_flag(long_form(groups.agg(*aggregates), "path", entries))


def filtered(aggregate: str, predicate: Column | str | None) -> Column:
    """An aggregate over the rows that pass ``predicate`` (SQL text)."""
    return F.expr(aggregate if predicate is None else f"{aggregate} FILTER (WHERE {predicate})")


def filtered_aggregate_boundary(
    df: DataFrame, keys: Sequence[str], aggregate: str, having: str,
    predicate_baseline: str | None, predicate_candidate: str | None,
) -> DataFrame:
    """Groups whose HAVING outcome flips when the row filter moves.

    ``having`` reads ``value``; a group without a passing row does not exist.
    """
    groups = df.groupBy(*keys).agg(
        filtered(aggregate, predicate_baseline).alias("v_baseline"),
        filtered(aggregate, predicate_candidate).alias("v_candidate"),
        F.count_if(keep(predicate_baseline)).alias("rows_a"),
        F.count_if(keep(predicate_candidate)).alias("rows_b"),
    )
    judged = (
        groups.withColumn("value", F.col("v_baseline"))
        .withColumn("in_a", keep(having) & (F.col("rows_a") > 0))
        .withColumn("value", F.col("v_candidate"))
        .withColumn("in_b", keep(having) & (F.col("rows_b") > 0))
    )
    verdict = direction(F.col("in_a"), F.col("in_b")).alias("direction")
    return judged.select(*keys, "v_baseline", "v_candidate", verdict).where("direction is not null")


def aggregate_function_separation(
    df: DataFrame, keys: Sequence[str], baseline: str, candidate: str
) -> DataFrame:
    """Groups for which two aggregates (function, argument or DISTINCT) differ."""
    groups = df.groupBy(*keys).agg(
        F.expr(baseline).alias("v_baseline"), F.expr(candidate).alias("v_candidate")
    )
    return groups.where("not (v_baseline <=> v_candidate)")


def aggregate_order_reversals(
    df: DataFrame, keys: Sequence[str], baseline: str, candidate: str
) -> DataFrame:
    """Does ordering the groups by the other aggregate change their order?

    Counts neighbours (by the baseline) that the candidate orders the other way
    round; some pair of groups is reversed exactly if some neighbours are.
    """
    groups = df.groupBy(*keys).agg(
        F.expr(baseline).alias("v_a"), F.expr(candidate).alias("v_b")
    ).where("v_a is not null and v_b is not null")
    distinct = groups.groupBy("v_a").agg(F.min("v_b").alias("low"), F.max("v_b").alias("high"))
    placed = running(distinct, [], ["v_a"], {"reached": ("max", F.col("high"))})
    after = placed.select((F.col("pos") - 1).alias("pos"), "low")
    before = placed.select("pos", "reached")
    return before.join(after, "pos").agg(
        F.count(F.lit(1)).alias("n_neighbours"),
        F.count_if(F.col("reached") > F.col("low")).alias("n_reversed"),
    ).withColumn("satisfied", F.col("n_reversed") > 0)


def count_null_sensitivity(df: DataFrame, keys: Sequence[str], column: Column | str) -> DataFrame:
    """COUNT(column) against COUNT(*) per group, where they differ."""
    cell = as_column(column)
    groups = df.groupBy(*keys).agg(
        F.count(cell).alias("v_baseline"), F.count(F.lit(1)).alias("v_candidate")
    )
    return groups.where("v_baseline <> v_candidate").withColumn("both_paths", F.col("v_baseline") > 0)


def count_distinct_sensitivity(df: DataFrame, keys: Sequence[str], column: Column | str) -> DataFrame:
    """COUNT and SUM with and without DISTINCT per group, where COUNT differs.

    Values are counted per (group, value) first: a very frequent value is one
    row from then on.
    """
    values = df.groupBy(*keys, as_column(column).alias("value__")).agg(F.count(F.lit(1)).alias("n__"))
    numeric = dict(values.dtypes)["value__"] not in {"string", "date", "timestamp", "timestamp_ntz", "boolean"}
    sums = []
    if numeric:
        sums = [
            F.sum("value__").alias("sum_distinct"), F.sum(F.col("value__") * F.col("n__")).alias("sum_all")
        ]
    groups = values.groupBy(*keys).agg(
        F.count("value__").alias("v_baseline"),
        F.coalesce(F.sum(F.when(F.col("value__").isNotNull(), F.col("n__"))), F.lit(0)).alias("v_candidate"),
        *sums,
    )
    return groups.where("v_baseline <> v_candidate")


def aggregate_filter_paths(
    df: DataFrame, keys: Sequence[str], aggregate: str, baseline: str | None, candidate: str | None
) -> DataFrame:
    """Per group: the aggregate under either FILTER and the rows only one includes."""
    a, b = keep(baseline), keep(candidate)
    return df.groupBy(*keys).agg(
        filtered(aggregate, baseline).alias("v_baseline"),
        filtered(aggregate, candidate).alias("v_candidate"),
        F.count_if(a & b).alias("n_both"),
        F.count_if(a & ~b).alias("n_baseline_only"),
        F.count_if(b & ~a).alias("n_candidate_only"),
    )


def filter_placement(
    df: DataFrame, keys: Sequence[str], aggregate: str, where: str, having: str
) -> DataFrame:
    """``WHERE where GROUP BY keys`` against ``GROUP BY keys HAVING having``.

    ``having`` reads the keys and ``v_candidate``. Both results come out of one
    aggregation; rows are the groups that only one version returns or that
    carry another value.
    """
    groups = df.groupBy(*keys).agg(
        filtered(aggregate, where).alias("v_baseline"), F.expr(aggregate).alias("v_candidate"),
        F.count_if(keep(where)).alias("rows_a"),
    )
    in_a, in_b = F.col("rows_a") > 0, keep(having)
    verdict = F.coalesce(
        direction(in_a, in_b),
        F.when(in_a & in_b & ~F.col("v_baseline").eqNullSafe(F.col("v_candidate")), "value_changed"),
    )
    return groups.select(
        *keys, F.when(in_a, F.col("v_baseline")).alias("v_baseline"),
        F.when(in_b, F.col("v_candidate")).alias("v_candidate"), verdict.alias("direction"),
    ).where("direction is not null")


def mixed_type_extremes(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """MIN and MAX of a text column: numbers before text against plain text order."""
    cell = F.col(column)
    number = F.when(cell.rlike(r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"), cell.try_cast("double"))
    typed = F.when(
        cell.isNotNull(),
        F.struct(F.when(number.isNotNull(), 0).otherwise(1).alias("kind"), number.alias("number"), cell.alias("text")),
    )
    groups = df.groupBy(*keys).agg(
        F.min(cell).alias("min_text"), F.min(typed)["text"].alias("min_typed"),
        F.max(cell).alias("max_text"), F.max(typed)["text"].alias("max_typed"),
    )
    return groups.where("not (min_text <=> min_typed and max_text <=> max_typed)")


def having_ratio_boundary(
    df: DataFrame, keys: Sequence[str], condition: str, measure: str, scale: float, threshold: float,
    op_baseline: str, op_candidate: str,
) -> DataFrame:
    """Groups by ``scale * rows passing condition / COUNT(measure)`` against a threshold."""
    groups = df.groupBy(*keys).agg(
        F.count_if(keep(condition)).alias("hits"), F.count(as_column(measure)).alias("total")
    )
    ratio = F.lit(float(scale)) * F.col("hits") / F.nullif(F.col("total"), F.lit(0))
    return _boundary(groups, ratio, float(threshold), op_baseline, op_candidate)


def having_membership_divergence(
    outer: DataFrame, outer_key: str, inner: DataFrame, inner_key: str,
    having_baseline: str, having_candidate: str,
) -> DataFrame:
    """Outer rows kept by ``key IN (SELECT ... GROUP BY key HAVING ...)`` in one version only."""
    flags = (
        inner.groupBy(as_column(inner_key).alias("inner__"))
        .agg(F.expr(having_baseline).alias("a__"), F.expr(having_candidate).alias("b__"))
        .where("inner__ is not null")
    )
    counted = outer.groupBy(as_column(outer_key).alias("outer__")).agg(F.count(F.lit(1)).alias("n__"))
    joined = counted.join(flags, F.col("outer__") == F.col("inner__"), "left")
    a, b = keep(F.col("a__")), keep(F.col("b__"))
    paths = {"both": a & b, "baseline_only": a & ~b, "candidate_only": b & ~a, "neither": ~a & ~b}
    aggregates, entries = [], {}
    for index, (path, condition) in enumerate(paths.items()):
        aggregates += [
            F.count_if(condition).alias(f"k{index}"),
            F.coalesce(F.sum(F.when(condition, F.col("n__"))), F.lit(0)).alias(f"n{index}"),
        ]
        entries[path] = {"n_keys": F.col(f"k{index}"), "n_rows": F.col(f"n{index}")}
    return with_flag(long_form(joined.agg(*aggregates), "direction", entries), "n_rows")
