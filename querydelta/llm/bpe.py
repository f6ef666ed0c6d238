"""Byte-level BPE as a monoid over text: encode halves, join neighbours at their border.

A text is split in halves down to leaves, each leaf is encoded alone, and two
neighbours are joined by encoding only a window around their border again. The
window grows on each side until it ends where a non-space character meets white
space. Every scan of the splitting pattern cuts there, whatever stands further
away: no alternative holds white space after another character, and none looks
back. So all tokens outside the window are final, and the join is associative.
Decoding concatenates the bytes of the leaves up the same tree.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from querydelta.llm.batches import document_columns, map_columns, stream_rows

#: Characters that Unicode calls white space.
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LEAF_CHARS = 4096
_FIRST_WINDOW = 64
_BORDER = re.compile(f"[^{WHITE_SPACE}](?=[{WHITE_SPACE}])")


class TreeEncoder:
    """Encodes and decodes by a rank file (one base64 token and its rank a line)."""

    def __init__(self, path: str, pattern: str, leaf_chars: int = LEAF_CHARS):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.leaf = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.leaf_chars = leaf_chars
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)

    def _leaf(self, text: str) -> np.ndarray:
        return self.leaf.encode_to_numpy(text, disallowed_special=())

    def encode(self, text: str) -> np.ndarray:
        """The ids of ``text`` as unsigned 32-bit integers."""
        if len(text) <= self.leaf_chars:
            return self._leaf(text)
        middle = len(text) // 2
        left, right = text[:middle], text[middle:]
        return self.join(left, self.encode(left), right, self.encode(right))

    def join(self, left: str, left_ids: np.ndarray, right: str, right_ids: np.ndarray) -> np.ndarray:
        """The ids of ``left + right`` from those of both parts."""
        cut_left, cut_right = _last_border(left), _first_border(right)
        window = self._leaf(left[cut_left:] + right[:cut_right])
        drop_left = self._tokens(left_ids[::-1], len(left[cut_left:].encode()))
        drop_right = self._tokens(right_ids, len(right[:cut_right].encode()))
        return np.concatenate([left_ids[: len(left_ids) - drop_left], window, right_ids[drop_right:]])

    def _tokens(self, ids: np.ndarray, n_bytes: int) -> int:
        """How many leading ``ids`` make up exactly ``n_bytes``."""
        if n_bytes == 0:
            return 0
        ends = np.cumsum(self.length[ids[:n_bytes]])
        at = int(np.searchsorted(ends, n_bytes))
        if at >= len(ends) or ends[at] != n_bytes:
            raise AssertionError("a border of the pattern must be a border of tokens")
        return at + 1

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self.leaf_chars:
            return b"".join([self.bytes_of[i] for i in ids.tolist()])
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def _last_border(text: str) -> int:
    """The last place in ``text`` where white space follows another character; 0 without one."""
    window = _FIRST_WINDOW
    while True:
        first = max(0, len(text) - window)
        found = 0
        for match in _BORDER.finditer(text, first):
            found = match.end()
        if found or first == 0:
            return found
        window *= 2


def _first_border(text: str) -> int:
    """The first such place; the whole length without one."""
    window = _FIRST_WINDOW
    while True:
        match = _BORDER.search(text, 0, window)
        if match:
            return match.end()
        if window >= len(text):
            return len(text)
        window *= 2


@functools.cache
def encoder(path: str, pattern: str, leaf_chars: int = LEAF_CHARS) -> TreeEncoder:
    """One encoder per worker process."""
    return TreeEncoder(path, pattern, leaf_chars)


def encode_documents(
    docs: DataFrame, path: str, pattern: str, leaf_chars: int = LEAF_CHARS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_tokens, ids (array<int>)`` per row of ``docs``.

    A NULL or empty text gives no ids; a NULL id stays NULL; repeated rows are encoded each on their own; an empty table
    gives an empty one; other columns are ignored. No row is moved.
    """

    def encode(ids, texts):
        own = encoder(path, pattern, leaf_chars)
        tokens = [own.encode(text).astype(np.int32) for text in texts]
        return ids, [len(x) for x in tokens], tokens

    return map_columns(document_columns(docs, id_col, text_col), encode, "doc_id bigint, n_tokens bigint, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded (binary)``: the bytes behind the ids of ``encode_documents``."""

    def decode(doc_ids, counts, ids):
        own = encoder(path, pattern, leaf_chars)
        return doc_ids, counts, ids, [own.decode(np.array(x, np.int64)) for x in ids]

    return map_columns(
        encoded.select("doc_id", "n_tokens", "ids"), decode, "doc_id bigint, n_tokens bigint, ids array<int>, decoded binary"
    )


def encode_checked(
    docs: DataFrame, path: str, pattern: str, leaf_chars: int = LEAF_CHARS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_tokens, ids (array<int>), decoded_sha256``: the ids, and the digest of what they decode to.

    Encoded and decoded in one worker, slice by slice. NULLs, empty texts and tables as in ``encode_documents``.
    """
    types = StructType.fromDDL("doc_id bigint, n_tokens bigint, ids array<int>, decoded_sha256 string")
    arrow = to_arrow_schema(types)

    def encode(rows, texts):
        own = encoder(path, pattern, leaf_chars)
        tokens = [own.encode(text) for text in texts]
        digests = [hashlib.sha256(own.decode(ids)).hexdigest() for ids in tokens]
        offsets = np.cumsum([0, *map(len, tokens)], dtype=np.int32)
        flat = np.concatenate([np.zeros(0, np.uint32), *tokens]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)).cast(arrow.field("ids").type)
        counts = pa.array(np.diff(offsets), pa.int64())
        return pa.RecordBatch.from_arrays([rows.column(0), counts, ids, pa.array(digests, arrow.field(3).type)], schema=arrow)

    return stream_rows(document_columns(docs, id_col, text_col), "text", encode, types)


def encoded_digests(
    docs: DataFrame, path: str, pattern: str, leaf_chars: int = LEAF_CHARS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per row, without carrying ids or bytes out of the worker."""

    def digest(ids, texts):
        own = encoder(path, pattern, leaf_chars)
        counts, of_ids, of_bytes = [], [], []
        for text in texts:
            tokens = own.encode(text)
            counts.append(len(tokens))
            of_ids.append(hashlib.sha256(tokens.astype("<u4").tobytes()).hexdigest())
            of_bytes.append(hashlib.sha256(own.decode(tokens)).hexdigest())
        return ids, counts, of_ids, of_bytes

    return map_columns(
        document_columns(docs, id_col, text_col), digest,
        "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    )
