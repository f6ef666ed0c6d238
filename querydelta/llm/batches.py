"""Arrow batches in and out of Python, cut so that long texts stay bounded."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Characters of text that one call of a vectorised helper sees at once (one longer text is a slice of its own).
SLICE_CHARS = 1 << 20


def slices(texts: list[str | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Cut ``texts`` into runs ``[first, last)`` of about ``limit`` characters."""
    first = size = 0
    for at, text in enumerate(texts):
        size += len(text) if text else 0
        if size >= limit:
            yield first, at + 1
            first, size = at + 1, 0
    if first < len(texts):
        yield first, len(texts)


def map_columns(df: DataFrame, function: Callable[..., list], schema: str) -> DataFrame:
    """``mapInArrow`` with lists: ``function(*columns)`` returns one list (or array) per output column."""
    types = StructType.fromDDL(schema)
    arrow = to_arrow_schema(types)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = function(*[column.to_pylist() for column in batch.columns])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values, type=field.type) for values, field in zip(out, arrow, strict=True)], schema=arrow
                )

    return df.mapInArrow(run, types)


def stream_rows(df: DataFrame, text_col: str, function: Callable[[pa.RecordBatch, list], pa.RecordBatch], schema: StructType) -> DataFrame:
    """``mapInArrow`` over whole rows by slices of bounded text: ``function(rows, texts)`` gives the rows that go on.

    Only one slice is held as Python objects; no row waits beside its text.
    """

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.names.index(text_col))
            lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            first = 0
            while first < batch.num_rows:
                before = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, before + SLICE_CHARS, "right")))
                part = batch.slice(first, last - first)
                out = function(part, column.slice(first, last - first).to_pylist())
                if out.num_rows:
                    yield out
                first = last

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, text_col: str, keep: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """The rows whose text (NULL: empty) ``keep`` keeps, with all their columns."""
    return stream_rows(df, text_col, lambda rows, texts: rows.filter(pa.array(keep([text or "" for text in texts]))), df.schema)


def replace_texts(df: DataFrame, text_col: str, function: Callable[[list[str]], list[str]]) -> DataFrame:
    """The rows with each text replaced; NULL stays."""

    def replaced(rows: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        found = function([text or "" for text in texts])
        new = [None if old is None else text for old, text in zip(texts, found, strict=True)]
        at = rows.schema.names.index(text_col)
        return rows.set_column(at, rows.schema.field(at), pa.array(new, rows.schema.field(at).type))

    return stream_rows(df, text_col, replaced, df.schema)


def document_columns(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Only the id and the text (NULL: empty), under names that no other column can take."""
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more
    )


def map_groups(df: DataFrame, keys: Sequence[str], function: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """``function(rows)`` for the rows of each group, read in a stream; only one group is held, so groups must be bounded.

    A row is a tuple of the columns of ``df`` in order, which begin with ``keys``.
    """
    types = StructType.fromDDL(schema)
    arrow, n = to_arrow_schema(types), len(keys)

    def run(batches):
        rows = (row for batch in batches for row in zip(*[column.to_pylist() for column in batch.columns], strict=True))
        for _, group in itertools.groupby(rows, key=lambda row: row[:n]):
            found = function(list(group))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values, type=field.type) for values, field in zip(zip(*found, strict=True), arrow, strict=True)],
                    schema=arrow,
                )

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, types)


def hash_sample(rows: DataFrame, share: float, salt: str, columns: list[str]) -> DataFrame:
    """The rows whose hash of ``columns``, added as ``place``, lies in the lowest ``share`` of all hashes; equal rows go together."""
    place = F.shiftrightunsigned(F.xxhash64(*columns, F.lit(salt)), 11)
    return rows.withColumn("place", place).where(F.col("place") < int(share * (1 << 53)))


def smallest(sample: DataFrame, k: int) -> DataFrame:
    """One row per ``place``, the ``k`` with the smallest: bounded however often a row is repeated, in a fixed order."""
    return sample.dropDuplicates(["place"]).orderBy("place").limit(k)
