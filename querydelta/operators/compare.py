"""Compare two results as bags, sets or sequences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querydelta.functions import keys as K
from querydelta.functions.logic import BASELINE_ONLY, CANDIDATE_ONLY, long_form
from querydelta.functions.sorting import SortKey, names
from querydelta.operators.positions import running


def _aligned(baseline: DataFrame, other: DataFrame) -> DataFrame:
    """``other`` with the column names of ``baseline``: results compare by position."""
    if len(baseline.columns) != len(other.columns):
        raise ValueError(
            f"results have {len(baseline.columns)} and {len(other.columns)} columns; see shape_diff"
        )
    return other.toDF(*baseline.columns)


def copies_per_row(versions: Mapping[str, DataFrame]) -> DataFrame:
    """Distinct rows with the number of copies in each named version (one shuffle).

    The copies are summed before the shuffle, so a row with very many copies
    travels once per input partition.
    """
    first = next(iter(versions.values()))
    tagged = None
    for name, df in versions.items():
        marked = _aligned(first, df).select(
            "*", *[F.lit(1 if other == name else 0).cast("bigint").alias(other) for other in versions]
        )
        tagged = marked if tagged is None else tagged.unionAll(marked)
    return tagged.groupBy(*first.columns).agg(*[F.sum(name).alias(name) for name in versions])


def row_counts(frames: Mapping[str, DataFrame]) -> DataFrame:
    """One row holding the row count of each named frame."""
    tagged = None
    for name, df in frames.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("frame"), "n")
        tagged = one if tagged is None else tagged.unionAll(one)
    return tagged.agg(*[F.max(F.when(F.col("frame") == name, F.col("n"))).alias(name) for name in frames])


def bag_diff(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Rows with a different number of copies, and the surplus on either side."""
    counted = copies_per_row({"n_a__": baseline, "n_b__": candidate})
    surplus = F.col("n_a__") - F.col("n_b__")
    return counted.where("n_a__ <> n_b__").select(
        *baseline.columns,
        F.greatest(surplus, F.lit(0)).alias("only_baseline"),
        F.greatest(-surplus, F.lit(0)).alias("only_candidate"),
    )


def set_diff(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Distinct rows that occur on one side only."""
    counted = copies_per_row({"n_a__": baseline, "n_b__": candidate})
    side = F.when(F.col("n_b__") == 0, BASELINE_ONLY).when(F.col("n_a__") == 0, CANDIDATE_ONLY)
    return counted.select(*baseline.columns, side.alias("direction")).where("direction is not null")


def same_values(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row: do both sides hold the same set of rows, and with how many duplicates?"""
    counted = copies_per_row({"n_a__": baseline, "n_b__": candidate})
    return counted.agg(
        (F.count_if((F.col("n_a__") == 0) | (F.col("n_b__") == 0)) == 0).alias("same_projected_values"),
        F.coalesce(F.sum(F.greatest(F.col("n_a__") - 1, F.lit(0))), F.lit(0)).alias("dup_baseline"),
        F.coalesce(F.sum(F.greatest(F.col("n_b__") - 1, F.lit(0))), F.lit(0)).alias("dup_candidate"),
    )


def result_summary(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row of counts and match flags for two results."""
    counted = copies_per_row({"n_a__": baseline, "n_b__": candidate})

    def total(expression: str) -> Column:
        return F.coalesce(F.sum(F.expr(expression)), F.lit(0))

    names_match = baseline.columns == candidate.columns
    return counted.agg(
        total("n_a__").alias("n_baseline"),
        total("n_b__").alias("n_candidate"),
        total("greatest(n_a__ - 1, 0)").alias("dup_baseline"),
        total("greatest(n_b__ - 1, 0)").alias("dup_candidate"),
        total("greatest(n_a__ - n_b__, 0)").alias("n_only_baseline"),
        total("greatest(n_b__ - n_a__, 0)").alias("n_only_candidate"),
    ).select(
        "*",
        (F.col("n_baseline") == F.col("n_candidate")).alias("row_count_match"),
        F.lit(names_match).alias("column_names_match"),
        ((F.col("n_only_baseline") + F.col("n_only_candidate")) == 0).alias("is_equivalent"),
    )


def ordered_diff(
    baseline: DataFrame,
    candidate: DataFrame,
    order_baseline: Sequence[str | SortKey],
    order_candidate: Sequence[str | SortKey],
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Positions at which two ordered results hold different rows, or only one has a row.

    ``columns`` are the compared columns (default: all of the baseline). Both
    orders must be total; see ``topn_cutoff_ties`` for partial ones.
    """
    columns = list(columns or baseline.columns)
    first = baseline.select(*dict.fromkeys([*columns, *names(order_baseline)]))
    second = candidate.select(*dict.fromkeys([*columns, *names(order_candidate)]))
    left = running(first, [], order_baseline).select("pos", F.struct(*columns).alias("a__"))
    right = running(second, [], order_candidate).select(
        F.col("pos").alias("pos_b__"), F.struct(*columns).alias("b__")
    )
    joined = left.join(right, F.col("pos") == F.col("pos_b__"), "full")
    return joined.where("not (a__ <=> b__)").select(
        F.coalesce("pos", "pos_b__").alias("pos"),
        *[F.col(f"a__.{name}").alias(f"baseline_{name}") for name in columns],
        *[F.col(f"b__.{name}").alias(f"candidate_{name}") for name in columns],
    )


def shape_diff(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Per column: verdict on name, type and place, and the non-NULL values on each side."""
    left = {field.name: field.dataType.simpleString() for field in baseline.schema}
    right = {field.name: field.dataType.simpleString() for field in candidate.schema}
    verdicts: list[tuple[str, str, str | None, str | None]] = []
    same_width = len(left) == len(right)
    for place, (name, dtype) in enumerate(left.items()):
        if name in right:
            verdict = "same" if right[name] == dtype else "type_changed"
            if same_width and verdict == "same" and list(right)[place] != name:
                verdict = "position_changed"
            verdicts.append((verdict, name, name, name))
        elif same_width and list(right)[place] not in left:
            verdicts.append(("alias_changed", name, name, list(right)[place]))
        else:
            verdicts.append(("column_dropped", name, name, None))
    renamed = {row[3] for row in verdicts}
    verdicts += [("column_added", name, None, name) for name in right if name not in renamed]
    if not same_width:
        verdicts.append(("star_mismatch", "*", None, None))

    def values(df: DataFrame, side: str) -> DataFrame:
        counted = df.agg(*[F.count(F.col(name)).alias(f"c{i}") for i, name in enumerate(df.columns)])
        return long_form(
            counted, f"{side}_column",
            {name: {f"n_{side}": F.col(f"c{i}")} for i, name in enumerate(df.columns)},
        )

    spark = baseline.sparkSession
    table = spark.createDataFrame(
        [(v, c, a, b, left.get(a), right.get(b)) for v, c, a, b in verdicts],
        "verdict string, column string, a__ string, b__ string, "
        "baseline_type string, candidate_type string",
    )
    return (
        table.join(F.broadcast(values(baseline, "baseline")), F.col("a__") == F.col("baseline_column"), "left")
        .join(F.broadcast(values(candidate, "candidate")), F.col("b__") == F.col("candidate_column"), "left")
        .select("column", "verdict", "baseline_type", "candidate_type", "n_baseline", "n_candidate")
    )


def normalize_cells(df: DataFrame) -> DataFrame:
    """Every cell as comparable text: ``1.0`` as ``1``, bytes as UTF-8."""
    return df.select(
        *[K.normal_cell(F.col(field.name), field.dataType).alias(field.name) for field in df.schema]
    )


def duplicate_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Tuples that occur more than once, with the copies beyond the first."""
    return (
        df.groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .withColumn("excess", F.col("copies") - 1)
    )


def cartesian_suspect(
    baseline: DataFrame, factors: Sequence[DataFrame], has_condition: bool = False
) -> DataFrame:
    """Would the candidate, an unconditional join of ``factors``, blow the result up?

    The product is computed from the row counts; it is never built. One factor
    means the candidate's own rows.
    """
    frames = {"n_baseline": baseline}
    frames.update({f"f{index}": factor for index, factor in enumerate(factors)})
    counts = row_counts(frames)
    product = F.lit(1).cast("decimal(38,0)")
    for index in range(len(factors)):
        product = (product * F.col(f"f{index}")).cast("decimal(38,0)")
    return counts.select("n_baseline", product.alias("n_candidate")).withColumn(
        "suspected",
        (F.col("n_candidate") > F.greatest(F.col("n_baseline") * 2, F.col("n_baseline") + 3))
        & F.lit(not has_condition),
    )


def table_digest(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Fingerprint of a table (per ``by`` group) that ignores row order but counts copies."""
    head = F.substring(F.sha2(K.row_text([F.col(name) for name in columns]), 256), 1, 15)
    return df.groupBy(*by).agg(
        F.sum(F.conv(head, 16, 10).cast("decimal(38,0)")).cast("decimal(38,0)").alias("digest"),
        F.count(F.lit(1)).alias("n"),
    )


def repair_check(
    baseline: DataFrame, candidate: DataFrame, repaired: Mapping[str, DataFrame]
) -> DataFrame:
    """Per named repair: does it bring back the baseline bag, and was there a difference?

    All versions share one shuffle.
    """
    labels = list(repaired)
    versions = {"base__": baseline, "cand__": candidate}
    versions.update({f"r{index}__": repaired[name] for index, name in enumerate(labels)})
    counted = copies_per_row(versions)
    gaps = counted.agg(
        F.coalesce(F.sum(F.abs(F.col("base__") - F.col("cand__"))), F.lit(0)).alias("cand__"),
        *[
            F.coalesce(F.sum(F.abs(F.col("base__") - F.col(f"r{i}__"))), F.lit(0)).alias(f"r{i}__")
            for i in range(len(labels))
        ],
    )
    return long_form(
        gaps, "repair",
        {
            name: {"n_before": F.col("cand__"), "n_after": F.col(f"r{i}__")}
            for i, name in enumerate(labels)
        },
    ).withColumn("fixed_by_replacement", (F.col("n_before") > 0) & (F.col("n_after") == 0))
