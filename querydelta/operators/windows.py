"""Window functions, specifications and frames.

A partition may hold a third of a table; rows are placed by the chunked plan of ``positions``, whatever its size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querydelta.functions.logic import as_column, compare, direction, keep, tally, with_flag
from querydelta.functions.sorting import SortKey, names, place
from querydelta.operators.positions import (
    RANK_FUNCTIONS, Total, at_offsets, exact_parts, first_rows, null_safe_lookup, scan,
)
from querydelta.session import durable

Keys = Sequence[str | SortKey]
Spec = tuple[Sequence[str], Keys]


def window_path_profile(df: DataFrame, part: Sequence[str], order: Keys) -> DataFrame:
    """One row: partitions, ties, partitions with two order values, NULL order keys."""
    keys = names(order)
    peers = df.groupBy(*part, *[name for name in keys if name not in part]).agg(
        F.count(F.lit(1)).alias("n__")
    )
    null_key = F.lit(False)
    for name in keys:
        null_key = null_key | F.col(name).isNull()
    partitions = peers.groupBy(*part).agg(
        F.sum("n__").alias("rows"), F.count(F.lit(1)).alias("values"),
        F.count_if(F.col("n__") > 1).alias("ties"),
        F.sum(F.when(null_key, F.col("n__")).otherwise(0)).alias("nulls"),
    )

    def total(column: Column) -> Column:
        return F.coalesce(F.sum(column), F.lit(0))

    return partitions.agg(
        F.count(F.lit(1)).alias("n_partitions"),
        total(F.col("rows")).alias("n_rows"),
        total(F.col("ties")).alias("n_tied_peer_groups"),
        F.count_if(F.col("values") > 1).alias("n_ordered_partitions"),
        total(F.col("nulls")).alias("n_null_order_rows"),
    )


def rank_function_divergence(
    df: DataFrame, part: Sequence[str], order: Keys, baseline: str, candidate: str,
    keys: Sequence[str], buckets: int = 4,
) -> DataFrame:
    """Rows on which two rank functions disagree; ``keys`` identify a row and break ties."""
    ranked = scan(
        df.select(*_columns(part, order, keys)), part, order, keys,
        {"v_baseline": baseline, "v_candidate": candidate}, buckets=buckets,
    )
    return ranked.select(*keys, "v_baseline", "v_candidate").where("not (v_baseline <=> v_candidate)")


def _columns(part: Sequence[str], order: Keys, others: Sequence[str]) -> list[str]:
    return list(dict.fromkeys([*part, *names(order), *others]))


def _window_value(df: DataFrame, function: str, spec: Spec, keys: Sequence[str], name: str) -> DataFrame:
    """Add a rank, or an aggregate of ``value__`` (of the partition, or running in the order)."""
    part, order = spec
    if function in RANK_FUNCTIONS:
        return scan(df, part, order, keys, {name: function})
    return _framed(df, function, F.col("value__"), part, order, keys, {name: "range" if order else "whole"})


def window_spec_divergence(
    df: DataFrame, function: str, baseline: Spec, candidate: Spec, keys: Sequence[str],
) -> DataFrame:
    """Rows whose window value changes with the PARTITION BY or ORDER BY.

    ``function`` is a rank function or ``sum``/``min``/``max``/``count`` of an
    expression such as ``"sum(value)"``; a specification is ``(partition columns,
    sort keys)``.
    """
    columns = list(dict.fromkeys([*_columns(*baseline, keys), *_columns(*candidate, [])]))
    name, _, argument = function.partition("(")
    value = [F.expr(argument.rstrip(") ")).alias("value__")] if argument else []
    valued = df.select(*columns, *value)
    valued = _window_value(valued, name, baseline, keys, "v_baseline")
    valued = _window_value(valued, name, candidate, keys, "v_candidate")
    return valued.select(*keys, "v_baseline", "v_candidate").where("not (v_baseline <=> v_candidate)")


_AGGREGATES = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


Frame = str | tuple[int, int]


def _framed(
    df: DataFrame, fn: str, value: Column, part: Sequence[str], order: Keys, keys: Sequence[str], frames: Mapping[str, Frame]
) -> DataFrame:
    """Add ``fn(value)`` per name over its frame: ``rows``, ``range``, ``whole`` or ``(first, last)`` row offsets."""
    running = {name: Total(fn, value, frame == "range") for name, frame in frames.items() if frame in ("rows", "range")}
    out = scan(df, part, order, keys, totals=running) if running else df
    for name, frame in frames.items():
        if frame == "whole":
            out = _whole(out, fn, value, part, name)
        elif name not in running:
            out = _sliding(out, fn, value, part, [*order, *keys], frame, name)
    return out


def _whole(df: DataFrame, fn: str, value: Column, part: Sequence[str], name: str) -> DataFrame:
    rows, parts, read = exact_parts(df, fn, value)
    facts = rows.groupBy(*part).agg(
        *[_AGGREGATES[step](column).cast(rows.schema[column].dataType).alias(column) for column, step in parts.items()]
    )
    found = null_safe_lookup(rows.drop(*parts), facts, list(part))
    return found.select(*df.columns, (F.coalesce(read, F.lit(0)) if fn == "count" else read).alias(name))


def _sliding(
    df: DataFrame, fn: str, value: Column, part: Sequence[str], total_order: Keys, frame: tuple[int, int], name: str
) -> DataFrame:
    """A frame of fixed width, at a cost that does not depend on the width.

    Each partition is cut into blocks as wide as the frame, so a frame is the end of one block and the start of the next:
    running totals from either end of a block, one read at the last and one at the first row of the frame.
    """
    first, last = frame
    width = last - first + 1
    if width < 1:
        raise ValueError(f"a frame ends before it starts: {frame}")
    rows, parts, read = exact_parts(df, fn, value)
    placed = scan(rows, part, total_order, ranks={"place__": "row_number", "n__": "size"})
    placed = placed.withColumn("block__", F.floor((F.col("place__") - 1) / width))
    blocks = [*part, "block__"]
    upto = {f"{column}upto": Total(step, F.col(column)) for column, step in parts.items()}
    onward = {f"{column}on": Total(step, F.col(column)) for column, step in parts.items()}
    placed = scan(placed, blocks, ["place__"], totals=upto, largest=width)
    placed = scan(placed, blocks, [SortKey("place__", descending=True)], totals=onward, largest=width)
    placed = durable(placed.drop(*parts))
    ends = [f"{column}upto" for column in parts]
    shifts = {f"{column}_end": (column, last) for column in ends} | {f"{column}on_start": (f"{column}on", first) for column in parts}
    framed = at_offsets(placed, part, [*df.columns, "place__", "n__"], shifts, "place__")
    if last > 0:  # frames that the partition cuts off end with its last row
        final = placed.where("place__ = n__").select(*part, *[F.col(column).alias(f"{column}_final") for column in ends])
        framed = null_safe_lookup(framed, final, list(part))
    start, stop = F.col("place__") + first, F.least(F.col("place__") + last, F.col("n__"))
    outside = (F.col("place__") + last < 1) | (start > F.col("n__"))
    one_block = F.floor((start - 1) / width) == F.floor((stop - 1) / width)
    cut = F.col("place__") + last > F.col("n__")
    found = {}
    for column, step in parts.items():
        kind = rows.schema[column].dataType
        end, on = F.col(f"{column}upto_end").cast(kind), F.col(f"{column}on_start").cast(kind)
        if last > 0:
            end = F.when(cut, F.col(f"{column}upto_final").cast(kind)).otherwise(end)
        both = F.when(on.isNull(), end).when(end.isNull(), on).otherwise(_COMBINE[step](on, end))
        whole = F.when(start < 1, end).when(one_block & cut, on).when(one_block, end).otherwise(both)
        found[column] = F.when(~outside, whole)
    read_from = framed.select(*df.columns, *[column.alias(key) for key, column in found.items()])
    result = F.coalesce(read, F.lit(0)) if fn == "count" else read
    return read_from.select(*df.columns, result.alias(name))


_COMBINE = {"sum": lambda a, b: a + b, "min": F.least, "max": F.greatest}


def frame_divergence(
    df: DataFrame, function: str, value: Column | str, part: Sequence[str], order: Keys,
    baseline, candidate, keys: Sequence[str],
) -> DataFrame:
    """Rows whose running aggregate changes with the frame.

    A frame is ``"rows"`` or ``"range"`` (from the start of the partition to the
    current row), ``"whole"``, or ``(first, last)`` row offsets.
    """
    rows = df.select(*_columns(part, order, keys), as_column(value).alias("value__"))
    framed = _framed(rows, function, F.col("value__"), part, order, keys, {"v_baseline": baseline, "v_candidate": candidate})
    return framed.select(*keys, "v_baseline", "v_candidate").where("not (v_baseline <=> v_candidate)")


def _edges(df: DataFrame, part: Sequence[str], total_order: Keys, value: str) -> DataFrame:
    """``v_first`` and ``v_last`` of each partition, by an aggregate: a partition is reduced before the shuffle."""
    at = place(df, total_order)
    return df.groupBy(*part).agg(F.min_by(value, at).alias("v_first"), F.max_by(value, at).alias("v_last"))


def first_last_divergence(
    df: DataFrame, value: str, part: Sequence[str], order: Keys, keys: Sequence[str],
) -> DataFrame:
    """Rows for which LAST_VALUE under the default frame is not the last of the partition.

    Also gives FIRST_VALUE (``v_first``). With ``keys`` the order is total, so the default frame ends at the row itself.
    Sort keys may have any type and direction and place NULLs on either side.
    """
    facts = _edges(df, part, [*order, *keys], value).withColumnRenamed("v_last", "v_candidate")
    rows = null_safe_lookup(df.select(*dict.fromkeys([*part, *keys, value])), facts, list(part))
    return rows.select(*keys, F.col(value).alias("v_baseline"), "v_candidate", "v_first").where(
        "not (v_baseline <=> v_candidate)"
    )


def edge_value_divergence(
    df: DataFrame, value: str, part: Sequence[str], baseline: Keys, candidate: Keys, keys: Sequence[str], edge: str = "first",
) -> DataFrame:
    """Partitions whose FIRST_VALUE (or, over the whole partition, LAST_VALUE) changes with the order, and their rows."""
    if edge not in ("first", "last"):
        raise ValueError(f"unknown edge: {edge}")
    aggregate = F.min_by if edge == "first" else F.max_by
    found = df.groupBy(*part).agg(
        F.count(F.lit(1)).alias("n_rows"),
        aggregate(value, place(df, [*baseline, *keys])).alias("v_baseline"),
        aggregate(value, place(df, [*candidate, *keys])).alias("v_candidate"),
    )
    return found.where("not (v_baseline <=> v_candidate)")


def _lagged(df: DataFrame, value: str, part: Sequence[str], total_order: Keys, offsets: Sequence[int]) -> DataFrame:
    """``value`` with ``lag0__``, ``lag1__`` ... for row offsets (negative offsets look ahead)."""
    placed = scan(df, part, total_order, ranks={"pos__": "row_number"})
    return at_offsets(placed, part, [value], {f"lag{index}__": (value, -offset) for index, offset in enumerate(offsets)})


def lag_lead_paths(
    df: DataFrame, value: str, part: Sequence[str], order: Keys, keys: Sequence[str],
    offset_baseline: int, offset_candidate: int, op_baseline: str, op_candidate: str,
) -> DataFrame:
    """Rows by their relation to the lagged value, and where two comparisons to LAG/LEAD part.

    Offsets count rows back; negative ones look ahead (LEAD).
    """
    rows = _lagged(
        df.select(*_columns(part, order, [*keys, value])), value, part, [*order, *keys],
        [offset_baseline, offset_candidate],
    )
    cell, lag_a, lag_b = F.col(value), F.col("lag0__"), F.col("lag1__")
    divergent = keep(compare(cell, op_baseline, lag_a)) != keep(compare(cell, op_candidate, lag_b))
    paths = {
        "null_lag": lag_a.isNull() | cell.isNull(), "below_lag": keep(cell < lag_a),
        "equal_to_lag": keep(cell == lag_a), "above_lag": keep(cell > lag_a),
    }
    return with_flag(tally(rows, paths, divergent))


def window_filter_boundary(
    df: DataFrame, part: Sequence[str], order: Keys, function: str,
    limit_baseline: int, op_baseline: str, limit_candidate: int, op_candidate: str,
    keys: Sequence[str],
) -> DataFrame:
    """Rows kept by only one of two Top-k filters on a rank (``<``, ``<=`` or ``=``)."""
    top = max(limit_baseline, limit_candidate)
    rows = df.select(*_columns(part, order, keys))
    if function in ("row_number", "rank", "dense_rank"):
        ranked = first_rows(rows, part, order, keys, top, function, "rank__")
    else:
        ranked = scan(rows, part, order, keys, {"rank__": function}).where(F.col("rank__") <= top)
    a = compare(F.col("rank__"), op_baseline, limit_baseline)
    b = compare(F.col("rank__"), op_candidate, limit_candidate)
    return ranked.select(
        *dict.fromkeys([*part, *keys]), F.col("rank__").alias("rank"), direction(a, b).alias("direction")
    ).where("direction is not null")


def partition_sizes(df: DataFrame, part: Sequence[str], k: int) -> DataFrame:
    """Partitions with fewer than, exactly and more than ``k`` rows."""
    sizes = df.groupBy(*part).agg(F.count(F.lit(1)).alias("n__"))
    return with_flag(
        tally(sizes, {"fewer": F.col("n__") < k, "exactly": F.col("n__") == k, "more": F.col("n__") > k})
    )
