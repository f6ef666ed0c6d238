"""Text normalisation and pattern translation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a secret shorter than this is never searched for.
MIN_SECRET_CHARS = 8


def collapse(text: Column) -> Column:
    """Case-folded text with runs of white space replaced by one blank."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def normalized_secret(text: Column) -> Column:
    """Collapsed text without the trailing semicolons (and blanks) of a statement."""
    return collapse(F.regexp_replace(text, r"[\s;]+$", ""))


def glob_regex(pattern: str) -> str:
    """An anchored Java regex for a case-sensitive shell pattern."""
    out = []
    position = 0
    while position < len(pattern):
        char = pattern[position]
        close = pattern.find("]", position + 2) if char == "[" else -1
        if char == "*":
            out.append(".*")
        elif char == "?":
            out.append(".")
        elif close > 0:
            body = pattern[position + 1 : close]
            negated = body[0] in "!^"
            members = re.sub(r"([\\\[\]&^])", r"\\\1", body[1:] if negated else body)
            out.append(f"[{'^' if negated else ''}{members}]")
            position = close
        else:
            out.append(re.escape(char))
        position += 1
    return r"(?s)\A" + "".join(out) + r"\z"
