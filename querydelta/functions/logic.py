"""Three-valued logic, comparisons and tallies as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASELINE_ONLY = "baseline_only"
CANDIDATE_ONLY = "candidate_only"

_COMPARISONS = {
    "=": lambda left, right: left == right,
    "<>": lambda left, right: left != right,
    "<": lambda left, right: left < right,
    "<=": lambda left, right: left <= right,
    ">": lambda left, right: left > right,
    ">=": lambda left, right: left >= right,
    "<=>": lambda left, right: left.eqNullSafe(right),
    "is distinct from": lambda left, right: ~left.eqNullSafe(right),
}


def as_column(value: Column | str) -> Column:
    """A predicate or expression given as a column or as SQL text."""
    return value if isinstance(value, Column) else F.expr(value)


def keep(predicate: Column | str | None) -> Column:
    """Whether a row passes: TRUE only; an absent predicate keeps every row."""
    if predicate is None:
        return F.lit(True)
    return F.coalesce(as_column(predicate), F.lit(False))


def truth_label(predicate: Column | str) -> Column:
    value = as_column(predicate)
    return F.when(value, "TRUE").when(~value, "FALSE").otherwise("UNKNOWN")


def compare(left: Column, op: str, right) -> Column:
    return _COMPARISONS[op](left, right if isinstance(right, Column) else F.lit(right))


def direction(kept_baseline: Column, kept_candidate: Column) -> Column:
    """Which version alone keeps the row; NULL when both agree."""
    return F.when(kept_baseline & ~kept_candidate, BASELINE_ONLY).when(
        kept_candidate & ~kept_baseline, CANDIDATE_ONLY
    )


def long_form(row: DataFrame, label: str, entries: Mapping[str, Mapping[str, Column]],
              by: Sequence[str] = ()) -> DataFrame:
    """Turn each input row into one output row per entry: a label and its values."""
    structs = [
        F.struct(F.lit(name).alias(label), *[column.alias(alias) for alias, column in values.items()])
        for name, values in entries.items()
    ]
    return row.select(*by, F.explode(F.array(*structs)).alias("entry")).select(*by, "entry.*")


def tally(df: DataFrame, paths: Mapping[str, Column], divergent: Column | None = None) -> DataFrame:
    """Rows per named path in one aggregate; every path is listed, also with no rows.

    ``divergent`` adds how many rows of the path the two versions treat differently.
    """
    aggregates = []
    entries = {}
    for index, (name, condition) in enumerate(paths.items()):
        aggregates.append(F.count_if(condition).alias(f"n{index}"))
        values = {"n": F.col(f"n{index}")}
        if divergent is not None:
            aggregates.append(F.count_if(condition & divergent).alias(f"d{index}"))
            values["n_divergent"] = F.col(f"d{index}")
        entries[name] = values
    return long_form(df.agg(*aggregates), "path", entries)


def with_flag(df: DataFrame, count: str = "n") -> DataFrame:
    return df.withColumn("satisfied", F.col(count) > 0)
