"""What a changed join does, from counted keys instead of joined rows.

Each side is first counted per join key; the joins below meet one row per key
on either side, so neither a hot key nor a large product is ever expanded.
Products of counts are ``decimal(38,0)``: they can pass the range of a bigint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querydelta.functions import keys as K
from querydelta.functions.logic import as_column, keep, long_form, with_flag
from querydelta.functions.sorting import SortKey
from querydelta.operators.positions import running

WIDE = "decimal(38,0)"
Pairs = Sequence[tuple[str, str]]


def _times(left: Column, right: Column) -> Column:
    return (left.cast("decimal(20,0)") * right.cast("decimal(18,0)")).cast(WIDE)


def _total(expression: Column) -> Column:
    return F.coalesce(F.sum(expression), F.lit(0)).cast(WIDE)


def _rows(expression: Column) -> Column:
    return F.coalesce(F.sum(expression), F.lit(0)).cast("bigint")


def key_pairs(left: DataFrame, right: DataFrame, on: Pairs,
              left_extra: Sequence[Column] = (), right_extra: Sequence[Column] = ()) -> DataFrame:
    """One row per key of either side with its row counts; NULL keys pair with nothing.

    Columns: ``k0..`` (the key, from whichever side has it), ``n_l``, ``n_r``
    (0 where the side lacks the key), ``has_null`` and the extra aggregates.
    """
    l_keys = [as_column(a).alias(f"l{i}") for i, (a, _) in enumerate(on)]
    r_keys = [as_column(b).alias(f"r{i}") for i, (_, b) in enumerate(on)]
    l_counts = left.groupBy(*l_keys).agg(F.count(F.lit(1)).alias("n_l"), *left_extra)
    r_counts = right.groupBy(*r_keys).agg(F.count(F.lit(1)).alias("n_r"), *right_extra)
    matches = None
    for index in range(len(on)):
        same = F.col(f"l{index}") == F.col(f"r{index}")
        matches = same if matches is None else matches & same
    joined = l_counts.join(r_counts, matches, "full")
    extras = [name for name in (*l_counts.columns, *r_counts.columns)
              if name not in {"n_l", "n_r"} and name not in {f"{s}{i}" for s in "lr" for i in range(len(on))}]
    keys = [F.coalesce(f"l{i}", f"r{i}").alias(f"k{i}") for i in range(len(on))]
    has_null = F.lit(False)
    for index in range(len(on)):
        has_null = has_null | F.coalesce(f"l{index}", f"r{index}").isNull()
    return joined.select(
        *keys,
        F.coalesce("n_l", F.lit(0)).alias("n_l"), F.coalesce("n_r", F.lit(0)).alias("n_r"),
        has_null.alias("has_null"), *extras,
    )


def join_path_profile(left: DataFrame, right: DataFrame, on: Pairs) -> DataFrame:
    """Matched and dangling keys with the rows behind them on each side."""
    pairs = key_pairs(left, right, on)
    n_l, n_r, null = F.col("n_l"), F.col("n_r"), F.col("has_null")
    paths = {
        "matched": (n_l > 0) & (n_r > 0),
        "dangling_left": (n_r == 0) & ~null,
        "dangling_right": (n_l == 0) & ~null,
        "null_left": null & (n_l > 0),
        "null_right": null & (n_r > 0),
    }
    aggregates, entries = [], {}
    for index, (path, condition) in enumerate(paths.items()):
        aggregates += [
            F.count_if(condition).alias(f"k{index}"),
            _rows(F.when(condition, n_l)).alias(f"a{index}"),
            _rows(F.when(condition, n_r)).alias(f"b{index}"),
        ]
        entries[path] = {
            "n_keys": F.col(f"k{index}"), "n_left_rows": F.col(f"a{index}"),
            "n_right_rows": F.col(f"b{index}"),
        }
    return with_flag(long_form(pairs.agg(*aggregates), "path", entries), "n_keys")


def canonical_join_key(df: DataFrame, column: str) -> DataFrame:
    """Rows per canonical key: ``1``, ``'1'``, ``'01'`` and ``'1.0'`` are one key."""
    key = K.canonical_key(F.col(column), df.schema[column].dataType)
    return (
        df.select(key.alias("canonical"))
        .groupBy(F.col("canonical.kind").alias("kind"), F.col("canonical.key").alias("key"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _pair_total(left: DataFrame, right: DataFrame, pairs: Pairs) -> DataFrame:
    counted = key_pairs(left, right, pairs)
    return counted.agg(_total(_times(F.col("n_l"), F.col("n_r"))).alias("n"))


def join_condition_divergence(
    left: DataFrame, right: DataFrame, baseline: Pairs, candidate: Pairs
) -> DataFrame:
    """Row pairs that satisfy only one of two conjunctions of column equalities.

    |A and not B| = |A| - |A and B|; each term is a sum of products of key
    counts. For a self-join pass the table on both sides.
    """
    both = list(dict.fromkeys([*baseline, *candidate]))
    conjunctions = {frozenset(pairs): pairs for pairs in (baseline, candidate, both)}  # a dropped conjunct: two
    terms = None
    for index, pairs in enumerate(conjunctions.values()):
        term = _pair_total(left, right, pairs).select(F.lit(index).alias("term"), "n")
        terms = term if terms is None else terms.unionAll(term)
    place = {pairs: index for index, pairs in enumerate(conjunctions)}
    row = terms.agg(
        *[
            F.max(F.when(F.col("term") == place[frozenset(pairs)], F.col("n"))).alias(name)
            for name, pairs in {"a": baseline, "b": candidate, "ab": both}.items()
        ]
    )
    return with_flag(
        long_form(
            row, "direction",
            {
                "both": {"n_pairs": F.col("ab")},
                "baseline_only": {"n_pairs": (F.col("a") - F.col("ab")).cast(WIDE)},
                "candidate_only": {"n_pairs": (F.col("b") - F.col("ab")).cast(WIDE)},
            },
        ),
        "n_pairs",
    )


def join_type_effect(
    left: DataFrame, right: DataFrame, on: Pairs, how_baseline: str, how_candidate: str
) -> DataFrame:
    """Result rows per origin under two join types (inner, left, right, full, cross)."""
    counted = key_pairs(left, right, on).agg(
        _total(_times(F.col("n_l"), F.col("n_r"))).alias("matched"),
        _total(F.when(F.col("n_r") == 0, F.col("n_l"))).alias("left"),
        _total(F.when(F.col("n_l") == 0, F.col("n_r"))).alias("right"),
        _rows(F.col("n_l")).alias("rows_l"), _rows(F.col("n_r")).alias("rows_r"),
    )
    none = F.lit(0).cast(WIDE)

    def shown(how: str, part: str) -> Column:
        if part == "matched":
            return F.col("matched")
        if part == "unmatched_left":
            return F.col("left") if how in {"left", "full"} else none
        if part == "unmatched_right":
            return F.col("right") if how in {"right", "full"} else none
        product = _times(F.col("rows_l"), F.col("rows_r"))
        return (product - F.col("matched")).cast(WIDE) if how == "cross" else none

    parts = ("matched", "unmatched_left", "unmatched_right", "unconstrained_pairs")
    return long_form(
        counted, "path",
        {
            part: {"n_baseline": shown(how_baseline, part), "n_candidate": shown(how_candidate, part)}
            for part in parts
        },
    ).withColumn("delta", (F.col("n_candidate") - F.col("n_baseline")).cast(WIDE))


def outer_predicate_placement(
    left: DataFrame, right: DataFrame, on: Pairs, predicate: Column | str, how: str = "left", side: str = "right"
) -> DataFrame:
    """An outer join ``ON key AND p`` (baseline) against the same join ``ON key WHERE p`` (candidate).

    ``p`` reads columns of the table on ``side``; ``how`` is ``left``, ``right`` or ``full``. Every row of WHERE is one of ON:
    pairs that pass ``p`` are in both, and so are rows without a partner that pass it as they are extended. Only ON
    keeps rows of its preserved side whose pairs ``p`` takes away. Counted per key; no pair is built.
    """
    if how not in ("left", "right", "full") or side not in ("left", "right"):
        raise ValueError(f"no placement for how={how!r}, side={side!r}")
    if side == "left":  # the table that p reads always comes second below
        mirrored = {"left": "right", "right": "left", "full": "full"}[how]
        return outer_predicate_placement(right, left, [(b, a) for a, b in on], predicate, mirrored)
    pairs = key_pairs(left, right, on, right_extra=[F.count_if(keep(predicate)).alias("passing")])
    absent = {field.name: F.lit(None).cast(field.dataType) for field in right.schema}
    judged = pairs.withColumn("passing", F.coalesce("passing", F.lit(0))).withColumns(absent).withColumn(
        "null_row_passes", keep(predicate)
    )
    n_l, n_r, passing, null = F.col("n_l"), F.col("n_r"), F.col("passing"), F.col("has_null")
    matched = _total(F.when(~null, _times(n_l, passing)))
    shared, only_on = [], []
    if how in ("left", "full"):  # left rows without a partner under ON, and those WHERE keeps as well
        extended = (passing == 0) | null
        by_where = ((n_r == 0) | null) & F.col("null_row_passes")
        shared.append(_total(F.when(extended & by_where, n_l)))
        only_on.append(_total(F.when(extended & ~by_where, n_l)))
    if how in ("right", "full"):  # right rows that pass and have no partner, and those that do not pass
        shared.append(_total(F.when((n_l == 0) | null, passing)))
        only_on.append(_total(n_r - passing))
    counted = judged.agg(
        matched.alias("matched"), sum(shared[1:], shared[0]).cast(WIDE).alias("shared"),
        sum(only_on[1:], only_on[0]).cast(WIDE).alias("only_on"),
    )
    return long_form(
        counted, "direction",
        {
            "both": {"n": (F.col("matched") + F.col("shared")).cast(WIDE)},
            "baseline_only": {"n": F.col("only_on")},
            "candidate_only": {"n": F.lit(0).cast(WIDE)},
        },
    )


def join_presence_effect(base: DataFrame, joined: DataFrame, on: Pairs) -> DataFrame:
    """What adding (or forgetting) an inner join does to the base rows."""
    pairs = key_pairs(base, joined, on)
    matched = F.when(F.col("has_null"), F.lit(0)).otherwise(F.col("n_r"))
    paths = {
        "filtered_out": matched == 0, "kept_once": matched == 1, "multiplied": matched > 1,
    }
    aggregates, entries = [], {}
    for index, (path, condition) in enumerate(paths.items()):
        aggregates += [
            _rows(F.when(condition, F.col("n_l"))).alias(f"b{index}"),
            _total(F.when(condition, _times(F.col("n_l"), matched))).alias(f"j{index}"),
        ]
        entries[path] = {"n_base_rows": F.col(f"b{index}"), "n_joined_rows": F.col(f"j{index}")}
    return with_flag(long_form(pairs.agg(*aggregates), "path", entries), "n_base_rows")


def cross_join_blowup(left: DataFrame, right: DataFrame, on: Pairs) -> DataFrame:
    """Rows of the product against rows of the join, without building either."""
    counted = key_pairs(left, right, on).agg(
        _rows(F.col("n_l")).alias("n_left"), _rows(F.col("n_r")).alias("n_right"),
        _total(_times(F.col("n_l"), F.col("n_r"))).alias("joined"),
    )
    product = _times(F.col("n_left"), F.col("n_right"))
    return counted.select(
        "n_left", "n_right", product.alias("product"), "joined",
        F.when(
            F.col("joined") > 0,
            F.round(product.cast("double") / F.greatest(F.col("joined"), F.lit(1)).cast("double"), 4),
        ).alias("ratio"),
    )


def measured_cardinality(left: DataFrame, right: DataFrame, on: Pairs) -> DataFrame:
    """Cardinality of a join seen from the left side, measured on the data."""
    both = key_pairs(left, right, on).where("not has_null")
    counted = both.agg(
        F.coalesce(F.max("n_l"), F.lit(0)).alias("max_left"),
        F.coalesce(F.max("n_r"), F.lit(0)).alias("max_right"),
        F.count_if((F.col("n_l") > 0) & (F.col("n_r") > 0)).alias("shared_keys"),
    )
    many_left, many_right = F.col("max_left") > 1, F.col("max_right") > 1
    label = (
        F.when((F.col("max_left") == 0) | (F.col("max_right") == 0), "UNKNOWN")
        .when(~many_left & ~many_right, "ONE_TO_ONE")
        .when(many_left & ~many_right, "MANY_TO_ONE")
        .when(~many_left & many_right, "ONE_TO_MANY")
        .otherwise("MANY_TO_MANY")
    )
    return counted.select(
        "max_left", "max_right", "shared_keys", label.alias("cardinality"),
        many_right.alias("may_fan_out"),
    )


def fanout_inflation(
    base: DataFrame, joined: DataFrame, on: Pairs, measure: str, groups: Sequence[str],
) -> DataFrame:
    """SUM and COUNT per group of base rows before and after an inner join.

    The base is summed per (group, key) before it meets the key counts of the
    joined side, so the multiplied rows never exist.
    """
    keys = [as_column(a).alias(f"l{i}") for i, (a, _) in enumerate(on)]
    summed = base.groupBy(*groups, *keys).agg(
        F.sum(as_column(measure)).alias("total"), F.count(F.lit(1)).alias("n_l")
    )
    counted = joined.groupBy(
        *[as_column(b).alias(f"r{i}") for i, (_, b) in enumerate(on)]
    ).agg(F.count(F.lit(1)).alias("n_r"))
    matches = None
    for index in range(len(on)):
        same = F.col(f"l{index}") == F.col(f"r{index}")
        matches = same if matches is None else matches & same
    n_r = F.coalesce("n_r", F.lit(0))
    per_group = summed.join(counted, matches, "left").groupBy(*groups).agg(
        F.sum("total").alias("base_sum"),
        F.sum(F.when(n_r > 0, F.col("total") * n_r)).alias("joined_sum"),
        F.sum("n_l").alias("base_count"),
        F.sum(F.col("n_l") * n_r).alias("joined_count"),
        F.sum(F.when(n_r > 0, F.col("n_l")).otherwise(0)).alias("joined_entities"),
    )
    return per_group.withColumn(
        "inflation",
        F.round(F.col("joined_sum").cast("double") / F.nullif(F.col("base_sum").cast("double"), F.lit(0.0)), 6),
    )


_REGIONS = {
    "<": {"below"}, "<=": {"below", "at"}, "=": {"at"}, ">=": {"at", "above"},
    ">": {"above"}, "<>": {"below", "above"},
}


def self_join_range(
    df: DataFrame, key: str, offset, op_baseline: str, op_candidate: str, part: Sequence[str] = (),
) -> DataFrame:
    """Pairs ``(a, b)`` of one partition by where ``b.key`` lies against ``a.key + offset``.

    Counted without a theta join: every key is a point and, shifted by
    ``offset``, a query; one running total over both tells each query how many
    points lie above it.
    """
    counted = df.where(F.col(key).isNotNull()).groupBy(*part, F.col(key).alias("at__")).agg(
        F.count(F.lit(1)).alias("n__")
    )
    shift = offset if isinstance(offset, Column) else F.lit(offset)
    points = counted.select(
        *part, F.col("at__"), F.lit(0).alias("kind__"), F.col("n__").alias("points__"),
        F.lit(0).cast("bigint").alias("queries__"),
    )
    queries = counted.select(
        *part, (F.col("at__") + shift).alias("at__"), F.lit(1).alias("kind__"),
        F.lit(0).cast("bigint").alias("points__"), F.col("n__").alias("queries__"),
    )
    placed = points.unionAll(queries).groupBy(*part, "at__").agg(
        F.sum("points__").alias("points__"), F.sum("queries__").alias("queries__")
    )
    ordered = running(
        placed, part, [SortKey("at__", descending=True, nulls_last=True)],
        {"from_here__": ("sum", F.col("points__"))},
    )
    sizes = counted.groupBy(*part).agg(F.sum("n__").alias("size__"))
    everything = sizes.agg(_total(_times(F.col("size__"), F.col("size__"))).alias("total"))
    placed_pairs = ordered.agg(
        _total(_times(F.col("queries__"), F.col("points__"))).alias("at"),
        _total(_times(F.col("queries__"), F.col("from_here__") - F.col("points__"))).alias("above"),
    )
    row = placed_pairs.select("at", "above", everything.scalar().alias("total")).withColumn(
        "below", (F.col("total") - F.col("at") - F.col("above")).cast(WIDE)
    )
    a, b = _REGIONS[op_baseline], _REGIONS[op_candidate]
    return long_form(
        row, "path",
        {
            region: {
                "n_pairs": F.col(region),
                "direction": F.lit(
                    "baseline_only" if region in a - b
                    else "candidate_only" if region in b - a
                    else "both" if region in a & b else "neither"
                ),
            }
            for region in ("below", "at", "above")
        },
    )


