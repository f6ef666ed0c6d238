"""Fingerprints of documents from content-defined chunks.

A gear hash over the last 32 bytes is taken at every byte; a chunk ends where it has
zeros under a mask. The mask is strict up to the normal size of a chunk and loose beyond it,
which keeps sizes near the normal one. Ends depend on nearby bytes only, so an edit
changes the chunks that it touches and those after fall back into step. A fingerprint
is the set of chunk digests, each with its length in bytes.
"""

from __future__ import annotations

import functools
import hashlib
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from querydelta.llm.batches import document_columns
from querydelta.llm.shingles import mix

SMALLEST, NORMAL, LARGEST = 16, 64, 256
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
#: 8 bits and 4 of them, among the highest, which all 32 bytes reach.
_STRICT, _LOOSE = np.uint32(0xFF000000), np.uint32(0xF0000000)
_DIGEST_BITS = 48
#: Key ranges per shuffle partition.
RANGES_PER_PARTITION = 4


def chunk_ends(data: bytes) -> list[int]:
    """Where the chunks of ``data`` end."""
    rolled = _GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):
        shifted = rolled[:-step] << np.uint32(step)
        rolled[step:] = rolled[step:] + shifted
    loose = np.flatnonzero((rolled & _LOOSE) == 0)
    strict = (loose[(rolled[loose] & _STRICT) == 0] + 1).tolist()
    loose = (loose + 1).tolist()
    ends, start, n = [], 0, len(data)
    while start < n:
        end = min(n, start + LARGEST)
        at = bisect_left(strict, start + SMALLEST)
        if at < len(strict) and strict[at] < start + NORMAL:
            end = strict[at]
        else:
            at = bisect_left(loose, start + NORMAL)
            if at < len(loose) and loose[at] < end:
                end = loose[at]
        ends.append(end)
        start = end
    return ends


def chunk_set(text: str) -> dict[int, int]:
    """The length of each distinct chunk, by its digest."""
    data, start, found = text.encode(), 0, {}
    for end in chunk_ends(data):
        found[xxhash.xxh3_64_intdigest(data[start:end]) >> 64 - _DIGEST_BITS] = end - start
        start = end
    return found


def fingerprint(chunks: dict[int, int]) -> str:
    """``digest:length`` of the chunks, sorted; texts are equal only if these are, but for chance."""
    return ",".join([f"{digest:012x}:{length}" for digest, length in sorted(chunks.items())])


def containment(chunks: dict[int, int], other: dict[int, int]) -> float:
    """The share of the first set's bytes that the other holds; 1 for two empty sets, 0 for one."""
    if not chunks:
        return 0.0 if other else 1.0
    return sum(length for digest, length in chunks.items() if digest in other) / sum(chunks.values())


def _ranges(ids: DataFrame, n: int) -> np.ndarray:
    """Bounds that cut the ids into about ``n`` even ranges."""
    probabilities = [at / n for at in range(1, n)]
    if not probabilities:
        return np.zeros(0, np.int64)
    found = ids.agg(F.percentile_approx("order", probabilities, 10 * n)).first()[0]
    return np.unique(np.array(found or [], np.int64))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row.

    The edited text has its last third (``n_chars // 3`` code points) replaced by the first as many code points of the
    next document, by descending id; the first follows the last. NULL ids come last, rows of one id by text; a row
    alone follows itself. ``near_edited`` and ``near_next`` are the shares of its bytes in chunks that the edited text and
    the next document hold. A NULL or empty text has an empty fingerprint, which is like another empty one (1) and like no
    other (0). Repeated rows each have a row; an empty table gives an empty one; other columns are ignored.

    Texts are moved once, into ranges of ids. A range is read in order with one text in memory; the first text of the
    following range is sent along at its end. The ranges' bounds and first ids are what the driver holds.
    """
    spark = docs.sparkSession
    rows = document_columns(docs, id_col, text_col).withColumn("order", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))))
    n = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _ranges(rows.select("order"), n)

    def part_of(order: pd.Series) -> pd.Series:
        return pd.Series(len(bounds) - np.searchsorted(bounds, order.to_numpy(np.int64)))

    part = F.pandas_udf(part_of, "bigint")(F.col("order"))
    heads = rows.select("order", part.alias("part")).groupBy("part").agg(F.max("order").alias("order"))
    heads = sorted((row.part, row.order) for row in heads.collect())
    sent = [(order, heads[at - 1][0]) for at, (_, order) in enumerate(heads)]
    wanted = spark.createDataFrame(sent, "order bigint, part bigint")
    first_texts = (
        rows.join(F.broadcast(wanted), "order").groupBy("order", "part").agg(F.min("text").alias("text"))
        .select(F.lit(None).cast("bigint").alias("doc_id"), "text", "order", "part", F.lit(1).alias("sent"))
    )
    own = rows.select("doc_id", "text", "order", part.alias("part"), F.lit(0).alias("sent"))
    ordered = own.union(first_texts).repartitionByRange("part").sortWithinPartitions(
        "part", "sent", F.desc("order"), "text"
    )
    types = StructType.fromDDL(
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return ordered.select("doc_id", "text", "sent").mapInArrow(functools.partial(_follow, to_arrow_schema(types)), types)


def _follow(arrow, batches):
    """Compare every text with the one behind it; a sent text ends a range and is nobody's own."""
    before = None
    for batch in batches:
        out = []
        for doc_id, text, sent in zip(*batch.columns, strict=True):
            text, chunks = text.as_py(), None
            if before is not None:
                chunks = chunk_set(text)
                out.append(_row(*before, text, chunks))
            before = None if sent.as_py() else (doc_id.as_py(), text, chunk_set(text) if chunks is None else chunks)
        columns = list(zip(*out, strict=True)) if out else [[]] * len(arrow)
        yield pa.RecordBatch.from_arrays(
            [pa.array(values, type=field.type) for values, field in zip(columns, arrow, strict=True)], schema=arrow
        )


def _row(doc_id, text, chunks, following, following_chunks):
    third = len(text) // 3
    edited = text[: len(text) - third] + following[:third]
    edited_chunks = chunk_set(edited)
    return (
        doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprint(chunks), fingerprint(edited_chunks),
        containment(chunks, edited_chunks), containment(chunks, following_chunks),
    )
