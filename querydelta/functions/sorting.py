"""Sort keys written as ``"column"``, ``"column desc"``, ``"column desc nulls last"``."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType, BooleanType, DataType, DateType, IntegralType, NumericType, StringType, TimestampNTZType, TimestampType,
)


@dataclass(frozen=True)
class SortKey:
    column: str
    descending: bool = False
    nulls_last: bool = False

    @property
    def order(self) -> Column:
        column = F.col(self.column)
        if self.descending:
            return column.desc_nulls_last() if self.nulls_last else column.desc_nulls_first()
        return column.asc_nulls_last() if self.nulls_last else column.asc_nulls_first()


def sort_key(text: str | SortKey) -> SortKey:
    """NULLs come first when ascending and last when descending unless stated."""
    if isinstance(text, SortKey):
        return text
    words = text.split()
    rest = " ".join(words[1:]).lower()
    descending = rest.startswith("desc")
    if "nulls" in rest:
        nulls_last = rest.endswith("last")
    else:
        nulls_last = descending
    return SortKey(words[0], descending, nulls_last)


def sort_keys(keys: Sequence[str | SortKey]) -> list[SortKey]:
    return [sort_key(key) for key in keys]


def orders(keys: Sequence[str | SortKey]) -> list[Column]:
    return [key.order for key in sort_keys(keys)]


def names(keys: Sequence[str | SortKey]) -> list[str]:
    return [key.column for key in sort_keys(keys)]


_HEX = "0123456789ABCDEF"


def _ascending(column: Column, kind: DataType) -> Column:
    """A value that sorts as ``column`` does and can be written as a literal without a time zone."""
    if isinstance(kind, DateType):
        return F.unix_date(column)
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.unix_micros(column.cast("timestamp"))
    return F.hex(column) if isinstance(kind, BinaryType) else column


def _descending(column: Column, kind: DataType) -> tuple[Column, Column]:
    """A flag and a value that ascend as ``column`` descends."""
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        return F.lit(0), -_ascending(column, kind)
    if isinstance(kind, IntegralType):
        return F.lit(0), F.bitwise_not(column.cast("bigint"))
    if isinstance(kind, NumericType):  # NaN sorts above all numbers
        nan = F.isnan(column) if kind.typeName() in ("float", "double") else F.lit(False)
        return F.when(nan, 0).otherwise(1), F.when(~nan, -column)
    if isinstance(kind, BooleanType):
        return F.lit(0), ~column
    if isinstance(kind, (StringType, BinaryType)):  # complemented bytes; the end sorts after any byte
        return F.lit(0), F.concat(F.translate(F.hex(column), _HEX, _HEX[::-1]), F.lit("G"))
    raise TypeError(f"no descending order for {kind.simpleString()}")


def place(df: DataFrame, keys: Sequence[str | SortKey]) -> Column:
    """A struct that ascends in the order of ``keys``, for ``min_by``, ``max_by`` and comparisons.

    NULLs are placed by a flag; a descending key becomes a value that ascends instead.
    """
    fields = []
    for at, key in enumerate(sort_keys(keys)):
        column, kind = F.col(key.column), df.schema[key.column].dataType
        flag, value = _descending(column, kind) if key.descending else (F.lit(0), _ascending(column, kind))
        null_flag = 2 if key.nulls_last else -1
        fields.append(F.when(column.isNull(), null_flag).otherwise(flag).alias(f"flag{at}"))
        fields.append(value.alias(f"value{at}"))
    return F.struct(*fields)
