"""JSON payloads as text: their keys, their string values, and pruning."""

from __future__ import annotations

import json
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys that never leave the audit.
FORBIDDEN_KEYS = (
    "answer_sql", "correct_sql", "standard_sql", "standard_node", "standard_fragment", "standard_result",
    "standard_sample_rows", "replacement_sql", "mutation_sql", "mutant_sql", "variant_sql", "test_database",
    "witness_world", "raw_observation", "llm_arbitration_input",
)

# The inside of a JSON string; possessive, so long strings need no regex stack.
_INSIDE = r'[^"\\]*+(?:\\.[^"\\]*+)*+'


def json_keys(payload: Column) -> Column:
    """All object keys of a JSON text at any depth, unescaped and in lower case."""
    found = F.regexp_extract_all(payload, F.lit(rf'"({_INSIDE})"\s*+:|"{_INSIDE}"'), F.lit(1))
    return F.array_distinct(F.transform(F.filter(found, lambda key: key != ""), lambda key: F.lower(unescape(key))))


def json_values(payload: Column) -> Column:
    """All non-empty string values of a JSON text at any depth, as written (still escaped)."""
    found = F.regexp_extract_all(payload, F.lit(rf'"{_INSIDE}"\s*+:|"({_INSIDE})"'), F.lit(1))
    return F.filter(found, lambda value: value != "")


def replace_values(payload: Column, shown: Column) -> Column:
    """The JSON text with string values replaced; ``shown`` maps values as written to what is written instead.

    Keys and all else stay as they are, also a key equal to a replaced value.
    """
    pieces = F.regexp_extract_all(payload, F.lit(rf'("{_INSIDE}"\s*+:|"{_INSIDE}"|[^"]++|")'), F.lit(1))

    def piece(part: Column) -> Column:
        value = F.try_element_at(shown, F.substring(part, F.lit(2), F.length(part) - 2))
        is_value = (F.length(part) > 2) & part.startswith('"') & part.endswith('"')
        return F.when(is_value & value.isNotNull(), F.concat(F.lit('"'), value, F.lit('"'))).otherwise(part)

    return F.array_join(F.transform(pieces, piece), "")


def unescape(token: Column) -> Column:
    """The text a JSON string stands for."""
    plain = F.from_json(F.concat(F.lit('["'), token, F.lit('"]')), "array<string>")
    return F.when(F.instr(token, "\\") == 0, token).otherwise(F.get(plain, F.lit(0)))


def mentions(payload: Column, keys: Iterable[str]) -> Column:
    return F.arrays_overlap(json_keys(payload), F.array(*[F.lit(key) for key in keys]))


class _Number(str):
    """A number as it was written."""


class _Members(list):
    """The members of an object in order, repeated keys included."""


def _parsed(text: str):
    return json.loads(
        text, parse_int=_Number, parse_float=_Number, parse_constant=_no_constant, object_pairs_hook=_Members
    )


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def _written(value, unwanted: frozenset[str]) -> str:
    if isinstance(value, _Number):
        return str(value)
    if isinstance(value, _Members):
        kept = [(key, inner) for key, inner in value if key.lower() not in unwanted]
        return "{" + ",".join([f"{json.dumps(key, ensure_ascii=False)}:{_written(inner, unwanted)}" for key, inner in kept]) + "}"
    if isinstance(value, list):
        return "[" + ",".join([_written(inner, unwanted) for inner in value]) + "]"
    return json.dumps(value, ensure_ascii=False)


def prune_keys(payload: Column, keys: Iterable[str]) -> Column:
    """The JSON text without the given keys at any depth.

    Removing a nested value needs a parser, so rows that mention a key go through an Arrow batch; all others pass
    untouched. Numbers and repeated keys stay as written. A row that mentions a key and is not JSON is withheld (NULL).
    """
    unwanted = frozenset(key.lower() for key in keys)

    def prune(text: str | None) -> str | None:
        try:
            return None if text is None else _written(_parsed(text), unwanted)
        except ValueError:
            return None

    @F.pandas_udf("string")
    def pruned(batch: pd.Series) -> pd.Series:
        return batch.map(prune)

    dirty = F.when(mentions(payload, unwanted), payload)
    return F.when(dirty.isNull(), payload).otherwise(pruned(dirty))
