"""The n-th row of an order without a sort: the histogram of the sort key is refined around it.

A few keys of the open range are drawn, all rows of the range are counted between and at them, and the part that holds
the n-th row becomes the open range. A key that many rows share is a part of its own, so ties of any size end the search.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from querydelta.functions.sorting import SortKey, place

#: Keys drawn in a round.
DRAWN = 32


@dataclass(frozen=True)
class Range:
    """Keys between two others (None: open); ``low`` and ``high`` are the same key where all rows share it."""

    low: Row | None
    high: Row | None
    before: int
    rows: int

    @property
    def one_key(self) -> bool:
        return self.low is not None and self.low == self.high


def with_place(df: DataFrame, order: Sequence[str | SortKey]) -> DataFrame:
    """The rows with their sort key as one ascending column ``at__``."""
    return df.withColumn("at__", place(df, order))


def _literal(key: Row, kind: StructType) -> Column:
    return F.struct(*[F.lit(value).cast(field.dataType).alias(field.name) for value, field in zip(key, kind.fields, strict=True)])


def inside(placed: DataFrame, first: Range, last: Range | None = None) -> DataFrame:
    """The rows from the start of one range to the end of another (default: of the same one)."""
    kind, at, last = placed.schema["at__"].dataType, F.col("at__"), last or first
    out = placed
    if first.low is not None:
        low = _literal(first.low, kind)
        out = out.where(at >= low if first.one_key else at > low)
    if last.high is not None:
        high = _literal(last.high, kind)
        out = out.where(at <= high if last.one_key else at < high)
    return out


def locate(placed: DataFrame, n: int, enough: int, rows: int) -> Range:
    """The range that holds row ``n`` (from 1) of the ``rows`` rows: at most ``enough`` rows, or rows of one key."""
    kind, at = placed.schema["at__"].dataType, F.col("at__")
    found = Range(None, None, 0, rows)
    while found.rows > enough and not found.one_key:
        open_ = inside(placed, found)
        drawn = open_.select("at__").orderBy(F.xxhash64("at__")).limit(DRAWN * DRAWN).distinct()
        keys = [row["at__"] for row in drawn.orderBy(F.xxhash64("at__")).limit(DRAWN).orderBy("at__").collect()]
        bounds = [_literal(key, kind) for key in keys]
        below = reduce(lambda a, b: a + b, [(bound < at).cast("int") for bound in bounds])
        equal = reduce(lambda a, b: a | b, [bound == at for bound in bounds])
        counted = open_.groupBy((2 * below + equal.cast("int")).alias("bucket")).count().collect()
        before = found.before
        for bucket, count in sorted((row["bucket"], row["count"]) for row in counted):
            if before + count >= n:
                least, is_key = divmod(bucket, 2)
                if is_key:
                    found = Range(keys[least], keys[least], before, count)
                else:
                    low = keys[least - 1] if least else found.low
                    found = Range(low, keys[least] if least < len(keys) else found.high, before, count)
                break
            before += count
    return found
