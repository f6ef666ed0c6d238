"""ORDER BY, LIMIT and OFFSET changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querydelta.functions.logic import as_column
from querydelta.functions.sorting import SortKey, names
from querydelta.operators.positions import running
from querydelta.operators.selection import inside, locate, with_place
from querydelta.session import chunk_rows, durable

Keys = Sequence[str | SortKey]


def order_separation(df: DataFrame, prefix: Sequence[str], discriminator: Column | str) -> DataFrame:
    """One row: ties on ``prefix`` that a further sort key would order.

    A tie group counts as separated when it holds two distinct non-NULL values.
    """
    cell = as_column(discriminator)
    groups = df.groupBy(*prefix).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.min(cell) < F.max(cell), F.lit(False)).alias("separated")
    )
    return groups.agg(
        F.count(F.lit(1)).alias("n_prefixes"),
        F.count_if(F.col("n") > 1).alias("n_ties"),
        F.count_if(F.col("separated")).alias("n_separated"),
        F.coalesce(F.sum(F.when(F.col("separated"), F.col("n"))), F.lit(0)).alias("n_separated_rows"),
    ).withColumn("satisfied", F.col("n_separated") > 0)


def order_null_path(df: DataFrame, key: Column | str) -> DataFrame:
    """One row: can NULLS FIRST and NULLS LAST be told apart on this key?"""
    cell = as_column(key)
    return df.agg(
        F.count_if(cell.isNull()).alias("n_null"), F.count(cell).alias("n_non_null")
    ).withColumn("satisfied", (F.col("n_null") > 0) & (F.col("n_non_null") > 0))


def _slice(df: DataFrame, keys: Sequence[str], order: Keys, n: int, offset: int) -> DataFrame:
    """Rows ``offset .. offset + n`` of the total order, with their place in the slice."""
    columns, enough = list(dict.fromkeys([*keys, *names(order)])), chunk_rows(df.sparkSession)
    placed = durable(with_place(df.select(*columns), order))
    total = placed.count()
    if offset >= total or n < 1:
        return placed.limit(0).select(*keys, F.lit(0).cast("bigint").alias("pos"))
    first = locate(placed, offset + 1, enough, total)
    last = locate(placed, min(offset + n, total), enough, total)
    rows = inside(placed, first, last)
    place_in_slice = F.col("place__") + first.before - offset
    ranked = running(rows.drop("at__"), [], order, position="place__").withColumn("pos", place_in_slice)
    return ranked.where(F.col("pos").between(1, n)).select(*keys, "pos")


def topn_membership_diff(
    df: DataFrame, keys: Sequence[str], baseline: Keys, candidate: Keys,
    n_baseline: int, n_candidate: int, offset_baseline: int = 0, offset_candidate: int = 0,
    candidate_df: DataFrame | None = None,
) -> DataFrame:
    """Rows inside one LIMIT/OFFSET slice only, with their place in that slice.

    Both orders must be total; ``keys`` identify a row.
    """
    left = _slice(df, keys, baseline, n_baseline, offset_baseline)
    right = _slice(candidate_df or df, keys, candidate, n_candidate, offset_candidate)
    tagged = left.select(*keys, F.col("pos").alias("a"), F.lit(None).cast("bigint").alias("b")).unionAll(
        right.select(*keys, F.lit(None).cast("bigint").alias("a"), F.col("pos").alias("b"))
    )
    both = tagged.groupBy(*keys).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return both.where("a is null or b is null").select(
        *keys, F.coalesce("a", "b").alias("pos"),
        F.when(F.col("b").isNull(), "baseline_only").otherwise("candidate_only").alias("direction"),
    )


def topn_cutoff_ties(df: DataFrame, order: Keys, n: int) -> DataFrame:
    """One row: is ``ORDER BY order LIMIT n`` deterministic?

    ``n_tied`` rows share the sort key of the n-th row, ``n_slots`` of them fit.
    Without sort keys every row ties.
    """
    keys = list(dict.fromkeys(names(order)))
    if not keys:
        return df.agg(F.count(F.lit(1)).alias("n_tied")).select(
            "n_tied", F.least(F.col("n_tied"), F.lit(n).cast("bigint")).alias("n_slots")
        ).withColumn("deterministic", F.col("n_tied") <= F.col("n_slots"))
    placed = durable(with_place(df.select(*keys), order).select("at__"))
    total = placed.count()
    if n < 1 or n > total:
        return placed.limit(0).agg(F.count(F.lit(1)).alias("n_tied"), F.count(F.lit(1)).alias("n_slots")).withColumn(
            "deterministic", F.lit(True)
        )
    found = locate(placed, n, chunk_rows(df.sparkSession), total)
    groups = inside(placed, found).groupBy("at__").agg(F.count(F.lit(1)).alias("n_tied"))
    upto = running(groups, [], ["at__"], {"upto": ("sum", F.col("n_tied"))})
    left = F.lit(n - found.before)
    return upto.where((F.col("upto") >= left) & (F.col("upto") - F.col("n_tied") < left)).select(
        "n_tied", (left - F.col("upto") + F.col("n_tied")).alias("n_slots")
    ).withColumn("deterministic", F.col("n_tied") <= F.col("n_slots"))


def limit_reachability(
    df: DataFrame, n_baseline: int, n_candidate: int, offset_baseline: int = 0, offset_candidate: int = 0
) -> DataFrame:
    """One row: how many rows each slice returns and whether the change can be seen.

    ``required_rows`` is the smallest input on which the two slices differ.
    """
    if offset_baseline == offset_candidate:
        required = None if n_baseline == n_candidate else offset_baseline + min(n_baseline, n_candidate) + 1
    else:
        required = min(offset_baseline, offset_candidate) + 1
    rows = F.col("n_rows")

    def returned(n: int, offset: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(n), rows - offset)).cast("bigint")

    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        returned(n_baseline, offset_baseline).alias("returned_baseline"),
        returned(n_candidate, offset_candidate).alias("returned_candidate"),
        F.lit(required).cast("bigint").alias("required_rows"),
        (rows >= F.lit(required)).alias("visible") if required is not None else F.lit(False).alias("visible"),
    )


def grouped_order_divergence(
    df: DataFrame, keys: Sequence[str], baseline: str, candidate: str, n: int,
    descending_baseline: bool = True, descending_candidate: bool = True,
) -> DataFrame:
    """Top-n groups when the ordering aggregate or its direction changes; keys break ties."""
    groups = df.groupBy(*keys).agg(F.expr(baseline).alias("v_a__"), F.expr(candidate).alias("v_b__"))
    return topn_membership_diff(
        groups, keys,
        [SortKey("v_a__", descending_baseline, descending_baseline), *keys],
        [SortKey("v_b__", descending_candidate, descending_candidate), *keys], n, n,
    )
