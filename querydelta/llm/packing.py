"""Token ids as files of fixed-width bit-packed blocks.

A file set is a Parquet folder written and read by Spark, so it can be kept in any
store. One row is one block: whole documents, closed once it holds ``block_ids``
ids, packed with the fewest bits that hold every id of the vocabulary, most
significant bit first. ``first_id`` is the block's offset in its shard; shards are
ranges of ``doc_id`` in ascending order, and the blocks of a shard follow each other.
An id is therefore found by its shard, its block and a shift, without reading others.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from querydelta.functions.octets import octets_of
from querydelta.llm.batches import document_columns
from querydelta.llm.bpe import WHITE_SPACE

BLOCK_IDS = 1 << 16
BLOCKS = "shard int, block int, first_id bigint, n_ids bigint, bits int, doc_ids array<bigint>, doc_sizes array<bigint>, payload binary"
#: Short pieces that a worker remembers; when more come, it goes on with those of the texts at hand.
CACHE_PIECES = 1_000_000
#: Bytes of text that are cut and numbered at once (one longer text is taken alone).
SLICE_BYTES = 1 << 23
_LONG_PIECE = 64
#: Pieces in one call of the library.
_ASKED_PIECES = 256
_SPACES = [chr(code).encode() for code in range(0x3001) if re.match(f"[{WHITE_SPACE}]", chr(code))]
_ONE_BYTE = np.zeros(256, bool)
_ONE_BYTE[[space[0] for space in _SPACES if len(space) == 1]] = True
#: First bytes of wider white space, and these characters as numbers, by width.
_LEADS = np.zeros(256, bool)
_LEADS[[space[0] for space in _SPACES if len(space) > 1]] = True
_WIDE = {width: [int.from_bytes(space) for space in _SPACES if len(space) == width] for width in (2, 3)}


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each, most significant first; the last byte is filled with zeros."""
    octets = np.ascontiguousarray(ids, ">u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:
        return octets[:, 4 - bits // 8 :].tobytes()
    return np.packbits(np.unpackbits(octets, axis=1)[:, 32 - bits :].reshape(-1)).tobytes()


def unpack(payload: bytes, bits: int, n_ids: int, first: int = 0) -> np.ndarray:
    """``n_ids`` ids from position ``first`` on, without touching those before."""
    if n_ids == 0:
        return np.zeros(0, np.uint32)
    start, stop = first * bits, (first + n_ids) * bits
    octets = np.frombuffer(payload, np.uint8)[start // 8 : -(-stop // 8)]
    wide = np.zeros((n_ids, 32), np.uint8) if bits % 8 else np.zeros((n_ids, 4), np.uint8)
    if bits % 8:
        wide[:, 32 - bits :] = np.unpackbits(octets)[start % 8 : start % 8 + n_ids * bits].reshape(n_ids, bits)
        wide = np.packbits(wide, axis=1)
    else:
        wide[:, 4 - bits // 8 :] = octets.reshape(n_ids, bits // 8)
    return np.ascontiguousarray(wide).view(">u4").reshape(-1).astype(np.uint32)


def _white(octets: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 belong to white space."""
    white = _ONE_BYTE[octets]
    at = np.flatnonzero(_LEADS[octets])
    number = octets[at].astype(np.int32)
    for width, spaces in _WIDE.items():
        number = number << 8 | octets[np.minimum(at + width - 1, len(octets) - 1)]
        found = at[np.isin(number, spaces)]
        for offset in range(width):
            white[found + offset] = True
    return white


def _chosen(sizes: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of ids with these sizes, those at ``at`` in that order: sizes and ids."""
    starts, chosen = np.cumsum(sizes) - sizes, sizes[at]
    ends = np.cumsum(chosen)
    return chosen, ids[np.repeat(starts[at] - (ends - chosen), chosen) + np.arange(chosen.sum())]


def byte_slices(column: pa.Array, limit: int) -> Iterator[pa.Array]:
    """``column`` in parts of at most ``limit`` bytes, or one value."""
    _, bounds = octets_of(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1)
        yield column.slice(first, last - first)
        first = last


class PieceEncoder:
    """Whole texts through a ``tokenizers`` file, asking the library once per distinct piece.

    A piece is white space and the word behind it; every scan of a byte-level pattern cuts between two of them. New pieces
    are asked for many at a time, as one text: its ids are those of the pieces one after another, and are dealt back by the
    bytes that each id stands for. Pieces are cut, numbered and looked up as Arrow columns, never as single objects.
    """

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size()
        special = {added.content: at for at, added in self.library.get_added_tokens_decoder().items()}
        self.length = np.zeros(self.size, np.int64)
        for token, at in self.library.get_vocab().items():
            self.length[at] = len(token.encode()) if token in special else len(token)
        self.cache_pieces = cache_pieces
        self.known = pa.array([], pa.binary())
        self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _ask(self, pieces: pa.Array, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids. ``inner``: white space and then a word, which stand well behind each other; others are asked for alone."""
        octets, bounds = octets_of(pieces.filter(pa.array(inner)))
        sizes, ids = [], []
        for first in range(0, len(bounds) - 1, _ASKED_PIECES):
            asked = bounds[first : first + _ASKED_PIECES + 1]
            text = octets[asked[0] : asked[-1]].tobytes().decode()
            found = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            token_ends, piece_ends = np.cumsum(self.length[found]), asked[1:] - asked[0]
            cuts = np.searchsorted(token_ends, piece_ends, "left") + 1
            if (token_ends[cuts - 1] != piece_ends).any():
                raise AssertionError("a token of the library spans two pieces")
            sizes.append(np.diff(cuts, prepend=0))
            ids.append(found)
        other = pieces.filter(pa.array(~inner)).cast(pa.string()).to_pylist()
        for found in self.library.encode_batch_fast(other, add_special_tokens=False):
            sizes.append([len(found.ids)])
            ids.append(np.array(found.ids, "<u4"))
        order = np.argsort(np.concatenate([np.flatnonzero(inner), np.flatnonzero(~inner)]))
        return _chosen(np.concatenate([*sizes, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*ids, np.zeros(0, "<u4")]), order)

    def _look_up(self, pieces: pa.Array, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of distinct pieces; short ones are remembered."""
        at = pc.fill_null(pc.index_in(pieces, value_set=self.known), -1).to_numpy().astype(np.int64)
        new = at < 0
        asked_sizes, asked_ids = self._ask(pieces.filter(pa.array(new)), inner[new])
        at[new] = len(self.known) + np.arange(len(asked_sizes))
        sizes, ids = _chosen(np.concatenate([self.sizes, asked_sizes]), np.concatenate([self.ids, asked_ids]), at)
        kept = pc.less_equal(pc.binary_length(pieces), _LONG_PIECE).to_numpy(zero_copy_only=False)
        full = len(self.known) + np.count_nonzero(new & kept) > self.cache_pieces
        rows = np.flatnonzero(kept)[: self.cache_pieces] if full else np.flatnonzero(new & kept)
        more, more_sizes, more_ids = pieces.take(pa.array(rows)), *_chosen(sizes, ids, rows)
        if full:
            self.known, self.sizes, self.ids = more, more_sizes, more_ids
        else:
            self.known = pa.concat_arrays([self.known, more])
            self.sizes, self.ids = np.concatenate([self.sizes, more_sizes]), np.concatenate([self.ids, more_ids])
        return sizes, ids

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no NULLs) one after another, and the bounds of each text's ids in them."""
        octets, bounds = octets_of(texts)
        if not len(octets):
            return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        white = _white(octets)
        cut = np.ones(len(octets) + 1, bool)
        cut[1:-1] = white[1:] & ~white[:-1]
        cut[bounds] = True
        cuts = np.flatnonzero(cut)
        places = [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(octets)]
        numbered = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, places).dictionary_encode()
        number = numbered.indices.to_numpy()
        inner = np.zeros(len(numbered.dictionary), bool)
        inner[number] = white[cuts[:-1]] & ~white[cuts[1:] - 1]
        sizes, ids = _chosen(*self._look_up(numbered.dictionary, inner), number)
        return ids, np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(cuts, bounds)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        ids, bounds = self.encode_column(pa.array(texts, pa.string()))
        return np.split(ids, bounds[1:-1]) if texts else []


@functools.cache
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, block_ids: int = BLOCK_IDS,
    id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Write the ids of every document, each followed by ``end_id``, in ascending ``doc_id`` order.

    A NULL or empty text is its end id alone. NULL ids come first; rows with one id are ordered by text, and repeated
    rows are all written. An empty table gives a file set without blocks. A document is never cut, so a block is larger
    than ``block_ids`` only by its last document. Other columns are ignored.
    """
    types = StructType.fromDDL(BLOCKS)
    arrow = to_arrow_schema(types)

    def write(batches):
        own = piece_encoder(tokenizer)
        bits = max(own.size - 1, end_id).bit_length()
        end = np.array([end_id], np.uint32)
        shard, block, first, n, parts, doc_ids, sizes = TaskContext.get().partitionId(), 0, 0, 0, [], [], []

        def close():
            row = [[shard], [block], [first], [n], [bits], [doc_ids], [sizes], [pack(np.concatenate(parts), bits)]]
            return pa.RecordBatch.from_arrays(
                [pa.array(value, type=field.type) for value, field in zip(row, arrow, strict=True)], schema=arrow
            )

        for batch in batches:
            parts_of = map(own.encode_column, byte_slices(batch.column(1), SLICE_BYTES))
            encoded = (ids[a:b] for ids, bounds in parts_of for a, b in itertools.pairwise(bounds.tolist()))
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
                parts += [ids, end]
                doc_ids.append(doc_id)
                sizes.append(len(ids) + 1)
                n += len(ids) + 1
                if n >= block_ids:
                    yield close()
                    block, first, n, parts, doc_ids, sizes = block + 1, first + n, 0, [], [], []
        if n:
            yield close()

    ordered = document_columns(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(write, types).write.parquet(folder)


def token_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks of a file set with ``start``, the number of ids in all blocks before.

    Only shard totals are added up in order: one row per writing task, a table bounded by the number of tasks, which is
    why it may be broadcast.
    """
    blocks = spark.read.schema(BLOCKS).parquet(folder)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("shard").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return blocks.join(F.broadcast(offsets), F.col("shard") == F.col("of")).select(
        *blocks.columns, (F.col("offset") + F.col("first_id")).alias("start")
    )


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the packed blocks.

    ``start`` counts the ids of all documents before; ``ids_crc32`` is taken over the ids as little-endian unsigned
    32-bit integers.
    """
    types = StructType.fromDDL("doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    arrow = to_arrow_schema(types)

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"], row["bits"], row["n_ids"]).astype("<u4")
                ends = np.cumsum(row["doc_sizes"])
                starts = ends - row["doc_sizes"]
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [row["doc_ids"], (starts + row["start"]).tolist(), row["doc_sizes"], sums]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value, type=field.type) for value, field in zip(columns, arrow, strict=True)], schema=arrow
                )

    wanted = token_blocks(spark, folder).select("doc_ids", "doc_sizes", "n_ids", "bits", "payload", "start")
    return wanted.mapInArrow(read, types)


def read_range(spark: SparkSession, folder: str, start: int, n_ids: int) -> DataFrame:
    """``start, ids (array<bigint>)`` for the parts of ids ``[start, start + n_ids)``, one row per block touched."""

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                first = max(0, start - row["start"])
                last = min(row["n_ids"], start + n_ids - row["start"])
                ids = unpack(row["payload"], row["bits"], last - first, first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["start"] + first], pa.int64()), pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))],
                    names=["start", "ids"],
                )

    touched = token_blocks(spark, folder).where(
        (F.col("start") < start + n_ids) & (F.col("start") + F.col("n_ids") > start)
    )
    return touched.select("start", "n_ids", "bits", "payload").mapInArrow(read, "start bigint, ids array<bigint>")
