"""Pieces of DuckDB SQL that several queries' checks share."""

from __future__ import annotations

#: ``words(text)``: what lies between ASCII white space.
WORDS = "list_filter(string_split_regex(coalesce({text}, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

#: Unsigned CRC-32 of a short ASCII string, bit by bit.
CRC32 = (
    "xor(list_reduce([4294967295] || flatten(list_transform(range(1, length({text}) + 1), "
    "lambda i: [CAST(ascii(substr({text}, i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])), "
    "lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"
)


def words(text: str) -> str:
    return WORDS.format(text=text)


def crc32(text: str) -> str:
    return CRC32.format(text=text)
