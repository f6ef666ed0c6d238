"""Row numbers, ranks and running totals for partitions of any size, in one plan.

Rows are written once and counted there. They are dealt by range on (partition, order) into chunks of about
``querydelta.chunkRows`` rows, each chunk is sorted alone, and what the earlier chunks of its partition hold is added. Only
partitions that run over several chunks need such a carry; a chunk has at most two of them, so the carries have at most two
rows per chunk and are broadcast. Sums do not depend on the chunks: floating-point values are summed as decimals.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, DoubleType, FloatType

from querydelta.functions.sorting import SortKey, names, orders, sort_keys
from querydelta.session import chunk_rows, durable

RANK_FUNCTIONS = ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile")

_FUNCTIONS = {"sum": F.sum, "min": F.min, "max": F.max}
_BEFORE = (Window.unboundedPreceding, -1)
_UPTO = (Window.unboundedPreceding, Window.currentRow)

#: Digits of a sum, and those of them that the largest summand may take; the others are left to the number of rows.
_PRECISION, _DIGITS = 37, 25


#: Rows worth a chunk of their own.
SPREAD_ROWS = 20_000


@dataclass(frozen=True)
class Total:
    """A running ``sum``, ``min``, ``max`` or ``count`` up to the row itself, or up to its last peer."""

    function: str
    value: Column
    peers: bool = False


@dataclass(frozen=True)
class _Step:
    """One column to run: how values combine, and how the result is read."""

    name: str
    function: str
    peers: bool
    read: Column | None = None

    def combine(self, first: Column, second: Column) -> Column:
        if self.function == "sum":
            return F.when(first.isNull(), second).when(second.isNull(), first).otherwise(first + second)
        return F.least(first, second) if self.function == "min" else F.greatest(first, second)


def scan(
    df: DataFrame,
    part: Sequence[str],
    order: Sequence[str | SortKey],
    ties: Sequence[str | SortKey] = (),
    ranks: Mapping[str, str] | None = None,
    totals: Mapping[str, Total] | None = None,
    buckets: int = 4,
    largest: int | None = None,
    rows_per_chunk: int | None = None,
    spread: bool = False,
) -> DataFrame:
    """Add rank columns and running totals, per partition in ``order``.

    ``ranks`` maps an output name to a rank function or ``size`` (rows of the partition), ``totals`` one to a ``Total``. Rows equal on ``order`` are peers;
    ``ties`` puts them into a total order for row numbers and totals that end at the row. ``largest`` is a known bound of
    the rows of a partition. With ``spread`` there are as many chunks as the session has shuffle partitions, if that is
    more and leaves ``SPREAD_ROWS`` to each.
    """
    ranks, totals = dict(ranks or {}), dict(totals or {})
    unknown = set(ranks.values()) - {*RANK_FUNCTIONS, "size"}
    if unknown:
        raise ValueError(f"unknown rank functions: {sorted(unknown)}")
    if "cume_dist" in ranks.values():
        totals["upto__"] = Total("count", F.lit(1), peers=True)
    columns, limit = df.columns, rows_per_chunk or chunk_rows(df.sparkSession)
    values = {f"{name}__in": total.value for name, total in totals.items() if total.function != "count"}
    rows = df.select("*", *[value.alias(name) for name, value in values.items()])
    types = {name: rows.select(F.sum(name)).schema[0].dataType for name in values if totals[name[:-4]].function == "sum"}
    floats = [name for name, kind in types.items() if isinstance(kind, (DoubleType, FloatType))]
    chunks, scales = 1, {}
    if floats or largest is None or largest > limit:
        rows = durable(rows)
        n, scales = _measured(rows, floats)
        if largest is None or largest > limit:
            chunks = max(1, math.ceil(n / limit))
        if spread:
            chunks = max(chunks, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // SPREAD_ROWS))
    steps = [step for name, total in totals.items() for step in _steps(name, total, types, scales)]
    rows = rows.select(*columns, *[value.alias(step.name) for step, value in steps])
    steps = [step for step, _ in steps]
    local = _local(rows, part, order, ties, ranks, steps, chunks)
    if chunks > 1:
        local = _carried(local, columns, part, names(order), ranks, steps)
    return local.select(*columns, *_outputs(ranks, totals, steps, buckets))


def _measured(rows: DataFrame, floats: Sequence[str]) -> tuple[int, dict[str, tuple[int, int, bool]]]:
    """The number of rows; per floating-point column a power of two, a decimal scale, and whether all values are finite."""
    finite = {name: F.abs(F.when(_is_finite(F.col(name)), F.col(name))) for name in floats}
    facts = rows.agg(
        F.count(F.lit(1)).alias("n__"),
        *[F.max(value).alias(name) for name, value in finite.items()],
        *[F.count_if(F.col(name).isNotNull() & ~_is_finite(F.col(name))).alias(f"{name}odd") for name in floats],
    ).first()
    scales = {}
    for name in floats:
        power, bits = 0, math.frexp(facts[name] or 1.0)[1]
        if not _DIGITS - _PRECISION < bits * math.log10(2) <= _DIGITS:
            power = min(1023, 1 - bits)
        digits = math.ceil((bits + power) * math.log10(2))
        scales[name] = power, min(_PRECISION - 1, _DIGITS - digits), facts[f"{name}odd"] > 0
    return facts["n__"], scales


def _is_finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) < float("inf"))


def _steps(
    name: str, total: Total, types: Mapping[str, DataType], scales: Mapping[str, tuple[int, int, bool]]
) -> list[tuple[_Step, Column]]:
    """The columns that a total needs, with the value of a row in each."""
    source = f"{name}__in"
    if total.function == "count":
        counted = F.when(total.value.isNotNull(), 1).otherwise(0).cast("bigint")
        return [(_Step(f"{name}__at", "sum", total.peers, F.col(f"{name}__at")), counted)]
    if total.function != "sum":
        return [(_Step(f"{name}__at", total.function, total.peers, F.col(f"{name}__at")), F.col(source))]
    if source not in scales:
        kind = types[source]
        wide = DecimalType(min(_PRECISION, kind.precision), kind.scale) if isinstance(kind, DecimalType) else "bigint"
        return [(_Step(f"{name}__at", "sum", total.peers, F.col(f"{name}__at").cast(kind)), F.col(source).cast(wide))]
    power, scale, odd = scales[source]
    exact = F.when(_is_finite(F.col(source)), F.col(source) * 2.0**power if power else F.col(source))
    exact = F.when(F.col(source).isNotNull(), F.coalesce(exact, F.lit(0.0))).cast(DecimalType(_PRECISION, scale))
    read = F.col(f"{name}__at").cast("double") / 2.0**power if power else F.col(f"{name}__at").cast("double")
    found = []
    if odd:
        nan, up, down = (F.col(f"{name}__{kind}") for kind in ("nan", "up", "down"))
        infinite = F.lit(float("inf"))
        read = (
            F.when((nan > 0) | ((up > 0) & (down > 0)), F.lit(float("nan"))).when(up > 0, infinite).when(down > 0, -infinite)
            .otherwise(read)
        )
        cases = {"nan": F.isnan(source), "up": F.col(source) == infinite, "down": F.col(source) == -infinite}
        found = [
            (_Step(f"{name}__{kind}", "sum", total.peers), F.when(case, 1).otherwise(0).cast("bigint"))
            for kind, case in cases.items()
        ]
    return [(_Step(f"{name}__at", "sum", total.peers, read.cast(types[source])), exact), *found]


def exact_parts(df: DataFrame, function: str, value: Column) -> tuple[DataFrame, dict[str, str], Column]:
    """The rows with columns that combine exactly in any order, the function of each, and the result read from them."""
    total = Total(function, value)
    if function == "count":
        steps, rows = _steps("value__", total, {}, {}), df
    else:
        rows = df.withColumn("value____in", value)
        kind = rows.select(F.sum("value____in")).schema[0].dataType if function == "sum" else None
        scales = {}
        if isinstance(kind, (DoubleType, FloatType)):
            rows = durable(rows)
            scales = _measured(rows, ["value____in"])[1]
        steps = _steps("value__", total, {"value____in": kind}, scales)
    rows = rows.select(*df.columns, *[column.alias(step.name) for step, column in steps])
    return rows, {step.name: step.function for step, _ in steps}, steps[0][0].read


def _local(rows, part, order, ties, ranks, steps, chunks) -> DataFrame:
    """Positions and totals inside each chunk."""
    total_order = [*order, *ties]
    if chunks > 1:
        dealt = rows.repartitionByRange(chunks, *[F.col(name) for name in part], *orders(total_order))
        rows = dealt.withColumn("chunk__", F.spark_partition_id())
    else:
        rows = rows.withColumn("chunk__", F.lit(0))
    each = Window.partitionBy(*part, "chunk__")
    line = each.orderBy(*orders(total_order))
    peers = each.orderBy(*orders(order)).rangeBetween(*_UPTO) if order else each
    wanted = set(ranks.values())
    by_peers = bool(wanted & {"rank", "dense_rank", "percent_rank"}) or any(step.peers for step in steps)
    found = [F.row_number().over(line).cast("bigint").alias("pos__")]
    if wanted & {"percent_rank", "cume_dist", "ntile", "size"}:
        found.append(F.count(F.lit(1)).over(each).alias("size__"))
    if by_peers and order:
        ordered = each.orderBy(*orders(order))
        found += [F.rank().over(ordered).cast("bigint").alias("rank__"), F.dense_rank().over(ordered).cast("bigint").alias("dense__")]
    elif by_peers:
        found += [F.lit(1).cast("bigint").alias("rank__"), F.lit(1).cast("bigint").alias("dense__")]
    kept = [name for name in rows.columns if name not in {step.name for step in steps}]
    return rows.select(
        *kept, *found,
        *[
            _FUNCTIONS[step.function](step.name).over(peers if step.peers else line.rowsBetween(*_UPTO)).cast(
                rows.schema[step.name].dataType
            ).alias(step.name)
            for step in steps
        ],
    )


def _carried(local: DataFrame, columns, part, order_names, ranks, steps) -> DataFrame:
    """Add to every chunk what the earlier ones of its partition hold, and what later ones add to its last peers."""
    local = durable(local)
    by_peers = "dense__" in local.columns
    key = F.struct(*[F.col(name).alias(f"k{at}") for at, name in enumerate(order_names)]) if order_names else F.lit(1)
    pieces = local.groupBy(*part, "chunk__").agg(
        F.count(F.lit(1)).alias("n__"),
        *[F.max_by(step.name, "pos__").alias(step.name) for step in steps],
        *[F.min_by(step.name, "pos__").alias(f"{step.name}head") for step in steps if step.peers],
        *(
            [
                F.max("dense__").alias("last__"), F.max("rank__").alias("tail__"),
                F.min_by(key, "pos__").alias("lo__"), F.max_by(key, "pos__").alias("hi__"),
            ]
            if by_peers else []
        ),
    )
    each = Window.partitionBy(*part)
    forward, back = each.orderBy("chunk__"), each.orderBy(F.desc("chunk__"))
    pieces = pieces.withColumn("pieces__", F.count(F.lit(1)).over(each)).where("pieces__ > 1")
    pieces = pieces.select(
        "*",
        F.coalesce(F.sum("n__").over(forward.rowsBetween(*_BEFORE)), F.lit(0)).alias("before__"),
        F.sum("n__").over(each).alias("all__"),
        *[
            _FUNCTIONS[step.function](step.name).over(forward.rowsBetween(*_BEFORE))
            .cast(local.schema[step.name].dataType).alias(f"{step.name}before")
            for step in steps
        ],
        *(
            [
                F.coalesce(F.lag("hi__").over(forward).eqNullSafe(F.col("lo__")) & F.lag("chunk__").over(forward).isNotNull(), F.lit(False)).alias("goes_on__"),
                F.coalesce(F.lead("lo__").over(forward).eqNullSafe(F.col("hi__")) & F.lead("chunk__").over(forward).isNotNull(), F.lit(False)).alias("stays__"),
            ]
            if by_peers else []
        ),
    )
    facts = ["before__", "all__", *[f"{step.name}before" for step in steps]]
    if by_peers:
        start = F.when((F.col("last__") > 1) | ~F.col("goes_on__"), F.col("before__") + F.col("tail__"))
        passes = (F.col("last__") == 1) & F.col("stays__")
        pieces = pieces.select(
            "*", F.last(start, True).over(forward.rowsBetween(*_BEFORE)).alias("start__"),
            F.coalesce(F.sum(F.col("last__") - F.col("goes_on__").cast("int")).over(forward.rowsBetween(*_BEFORE)), F.lit(0)).alias("dense_before__"),
            *[
                F.last(F.when(~passes, step.combine(F.col(f"{step.name}before"), F.col(f"{step.name}head"))), True)
                .over(back.rowsBetween(*_BEFORE)).cast(local.schema[step.name].dataType).alias(f"{step.name}end")
                for step in steps if step.peers
            ],
        )
        facts += ["last__", "goes_on__", "stays__", "start__", "dense_before__", *[f"{step.name}end" for step in steps if step.peers]]
    carried = pieces.select(
        *[F.col(name).alias(f"part{at}__") for at, name in enumerate(part)], F.col("chunk__").alias("of__"), *facts
    )
    same = [F.col(name).eqNullSafe(F.col(f"part{at}__")) for at, name in enumerate(part)]
    joined = local.join(F.broadcast(carried), reduce(lambda a, b: a & b, same, F.col("chunk__") == F.col("of__")), "left")
    out = {"pos__": F.col("pos__") + F.coalesce("before__", F.lit(0))}
    if "size__" in local.columns:
        out["size__"] = F.coalesce("all__", "size__")
    if by_peers:
        first = (F.col("dense__") == 1) & F.col("goes_on__")
        last = (F.col("dense__") == F.col("last__")) & F.col("stays__")
        out["rank__"] = F.when(first, F.col("start__")).otherwise(F.col("rank__") + F.coalesce("before__", F.lit(0)))
        out["dense__"] = F.col("dense__") + F.coalesce(F.col("dense_before__") - F.col("goes_on__").cast("int"), F.lit(0))
    for step in steps:
        own = step.combine(F.col(f"{step.name}before"), F.col(step.name)).cast(local.schema[step.name].dataType)
        out[step.name] = F.when(last, F.col(f"{step.name}end")).otherwise(own) if step.peers else own
    return joined.select(*columns, *[value.alias(name) for name, value in out.items()])


def _outputs(ranks, totals, steps, buckets) -> list[Column]:
    position, rows, rank = F.col("pos__"), F.col("size__"), F.col("rank__")
    small, extra = F.expr(f"size__ div {buckets}"), F.col("size__") % buckets
    wide = extra * (small + 1)
    ntile = F.when(position <= wide, F.floor((position - 1) / (small + 1)) + 1).otherwise(
        extra + F.floor((position - wide - 1) / F.greatest(small, F.lit(1))) + 1
    )
    upto = next((step.read for step in steps if step.name == "upto____at"), None)
    values = {
        "row_number": lambda: position,
        "size": lambda: rows,
        "ntile": lambda: ntile.cast("bigint"),
        "rank": lambda: rank,
        "dense_rank": lambda: F.col("dense__"),
        "percent_rank": lambda: F.when(rows == 1, F.lit(0.0)).otherwise((rank - 1) / F.greatest(rows - 1, F.lit(1))),
        "cume_dist": lambda: upto / rows,
    }
    read = {step.name: step.read for step in steps}
    return [
        *[values[function]().alias(name) for name, function in ranks.items()],
        *[read[f"{name}__at"].alias(name) for name in totals if name != "upto__"],
    ]


def running(
    df: DataFrame,
    part: Sequence[str],
    order: Sequence[str | SortKey],
    totals: Mapping[str, tuple[str, Column]] | None = None,
    position: str = "pos",
    rows_per_chunk: int | None = None,
    spread: bool = False,
) -> DataFrame:
    """Add the row number and running totals ``name: (function, expression)``; ``order`` is total within a partition."""
    steps = {name: Total(function, value) for name, (function, value) in (totals or {}).items()}
    return scan(df, part, order, (), {position: "row_number"}, steps, rows_per_chunk=rows_per_chunk, spread=spread)


def first_rows(
    df: DataFrame, part: Sequence[str], order: Sequence[str | SortKey], ties: Sequence[str | SortKey], k: int,
    function: str = "row_number", name: str = "rank", salts: int = 64,
) -> DataFrame:
    """Rows with ``row_number``, ``rank`` or ``dense_rank`` up to ``k``, with it as column ``name``.

    A row among the first ``k`` of its partition is so in every part of it, so salted parts are cut first (before the shuffle
    where Spark has a group limit for ``k``); only what is left is numbered.
    """
    keys = list(dict.fromkeys([*part, *names(order), *names(ties)]))
    salted = Window.partitionBy(*part, "salt__").orderBy(*orders(order), *(orders(ties) if function == "row_number" else []))
    cut = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}[function]().over(salted)
    left = df.withColumn("salt__", F.pmod(F.xxhash64(*keys), F.lit(salts))).withColumn("cut__", cut).where(F.col("cut__") <= k)
    return scan(left.drop("salt__", "cut__"), part, order, ties, {name: function}).where(F.col(name) <= k)


def at_offsets(
    placed: DataFrame, part: Sequence[str], kept: Sequence[str], shifts: Mapping[str, tuple[str, int]], position: str = "pos__",
) -> DataFrame:
    """The columns ``kept``, with ``name: (column, offset)`` read from the row ``offset`` places on in the partition.

    A row is sent to each place that reads it, so one shuffle serves all offsets.
    """
    types = {name: placed.schema[column].dataType for name, (column, _) in shifts.items()}
    own = F.struct(*kept)

    def sent(at: Column, owner: Column, values: Mapping[str, Column]) -> Column:
        cells = [values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in types.items()]
        return F.struct(at.cast("bigint").alias(position), owner.alias("own__"), *cells)

    nobody = F.when(F.lit(False), own)
    rows = [sent(F.col(position), own, {})]
    rows += [sent(F.col(position) - offset, nobody, {name: F.col(column)}) for name, (column, offset) in shifts.items()]
    keys = [F.col(name).alias(f"part{at}__") for at, name in enumerate(part)]
    spread = placed.select(*keys, F.explode(F.array(*rows)).alias("sent__")).select(*[f"part{at}__" for at in range(len(part))], "sent__.*")
    met = spread.groupBy(*[f"part{at}__" for at in range(len(part))], position).agg(
        F.first("own__", True).alias("own__"), *[F.first(name, True).alias(name) for name in shifts]
    )
    return met.where("own__ is not null").select("own__.*", *shifts)


def null_safe_lookup(rows: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the columns of ``facts`` (one row per key, NULL is a key) to ``rows``.

    The facts hold one row per key, so a hot key only makes the row side of the
    join uneven, which adaptive skew-join splitting handles.
    """
    if not keys:
        return rows.select("*", *[facts.select(name).scalar().alias(name) for name in facts.columns])
    renamed = facts.withColumnsRenamed({key: f"{key}__fact" for key in keys})
    same = None
    for key in keys:
        part = F.col(key).eqNullSafe(F.col(f"{key}__fact"))
        same = part if same is None else same & part
    return rows.join(renamed, same, "left").drop(*[f"{key}__fact" for key in keys])


def with_totals(df: DataFrame, part: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """Add whole-partition aggregates without sorting or collecting a partition."""
    facts = df.groupBy(*part).agg(*aggregates)
    return null_safe_lookup(df, facts, list(part))
