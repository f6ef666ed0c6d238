"""Row identity: canonical join keys, cell normalisation, content-addressed ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PLAIN_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)$"
_SCIENTIFIC_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)[eE][+-]?\d+$"


def plain_digits(text: Column) -> Column:
    """One spelling per number: no plus sign, no padding zeros, no ``-0``."""
    negative = text.startswith("-")
    unsigned = F.regexp_replace(text, r"^[+-]", "")
    whole = F.regexp_replace(F.substring_index(unsigned, ".", 1), r"^0+", "")
    fraction = F.when(
        F.instr(unsigned, ".") > 0,
        F.regexp_replace(F.substring_index(unsigned, ".", -1), r"0+$", ""),
    ).otherwise("")
    body = F.concat(
        F.when(whole == "", "0").otherwise(whole),
        F.when(fraction == "", "").otherwise(F.concat(F.lit("."), fraction)),
    )
    return F.when(negative & (body != "0"), F.concat(F.lit("-"), body)).otherwise(body)


def canonical_key(column: Column, dtype: T.DataType) -> Column:
    """``struct(kind, key)``; numbers and numeric-looking text share one key."""
    if isinstance(dtype, T.BooleanType):
        pair = (F.lit("boolean"), column.cast("string"))
    elif isinstance(dtype, T.NumericType):
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            exact = column.cast("string")
            exact = F.when(exact.rlike(_PLAIN_NUMBER), exact).otherwise(
                column.try_cast("decimal(38,10)").cast("string")
            )
        else:
            exact = column.cast("string")
        pair = (F.lit("numeric"), F.coalesce(plain_digits(exact), column.cast("string")))
    elif isinstance(dtype, T.StringType):
        stripped = F.regexp_replace(column, r"^\s+|\s+$", "")
        scientific = stripped.try_cast("decimal(38,10)").cast("string")
        is_plain = stripped.rlike(_PLAIN_NUMBER)
        is_scientific = stripped.rlike(_SCIENTIFIC_NUMBER) & scientific.isNotNull()
        pair = (
            F.when(is_plain | is_scientific, "numeric").otherwise("text"),
            F.when(is_plain, plain_digits(stripped))
            .when(is_scientific, plain_digits(scientific))
            .otherwise(column),
        )
    else:
        pair = (F.lit("other"), column.cast("string"))
    return F.when(
        column.isNotNull(), F.struct(pair[0].alias("kind"), pair[1].alias("key"))
    )


def normal_cell(column: Column, dtype: T.DataType) -> Column:
    """A cell as comparable text: integral floats like integers, bytes as UTF-8."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        integral = (column == F.floor(column)) & (F.abs(column) < 1e15)
        return F.when(integral, column.try_cast("bigint").cast("string")).otherwise(
            column.cast("string")
        )
    if isinstance(dtype, T.BinaryType):
        return F.make_valid_utf8(column.cast("string"))
    if isinstance(dtype, T.StringType):
        return column
    return column.cast("string")


def row_text(columns: Sequence[Column]) -> Column:
    """The cells of a row as one unambiguous text: ``length:cell`` or ``-`` for NULL."""
    cells = []
    for column in columns:
        text = column.cast("string")
        cells.append(
            F.when(text.isNull(), "-").otherwise(F.concat(F.length(text), F.lit(":"), text))
        )
    return F.concat(*cells)


def stable_id(prefix: str, columns: dict[str, Column]) -> Column:
    """``prefix_`` and 16 hex digits of the SHA-256 of the sorted, compact JSON."""
    ordered = [column.cast("string").alias(name) for name, column in sorted(columns.items())]
    body = F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(body, 256), 1, 16))
