"""Licence notices in texts, by the Dice coefficient over word bigrams."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Short public notices by which a licence is named or granted.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
    "compliance with the License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
    "later version.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_2 = TEMPLATES["bsd"] + """
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution.
"""
#: Whole licences without their copyright lines; those of the GPL, Apache and MPL hold their headers and are found by these.
FULL_TEXTS = {
    "bsd-2-clause-text": _BSD_2 + _AS_IS,
    "bsd-3-clause-text": _BSD_2 + """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse
or promote products derived from this software without specific prior written permission.
""" + _AS_IS,
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}
THRESHOLD = 0.75
#: Stands for a line that is a notice itself, so that no window reaches over it.
_BREAK = "\ua66e"
#: Words too frequent to search for when a bigram has another one.
FREQUENT = frozenset("a and are by for from in is it of or that the this to under with".split())


def template_words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _words(lowered: Column) -> Column:
    plain = F.trim(F.regexp_replace(lowered, r"[^\p{L}\p{N}]+", " "))
    return F.split(plain, " ")


def _pairs(words: Column) -> Column:
    following = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1)))
    pairs = F.zip_with(words, following, lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))
    return F.filter(pairs, lambda pair: pair.isNotNull())


def _bigrams(words: Column) -> Column:
    return F.array_distinct(_pairs(words))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def needles(templates: dict[str, list[str]], low: float) -> list[str]:
    """Words one of which every text with a share ``low`` of a template's bigrams holds."""
    words = set()
    for bigrams in templates.values():
        rarest = sorted((max((word not in FREQUENT, len(word), word) for word in pair.split()) for pair in bigrams), reverse=True)
        words.update(word for _, _, word in rarest[: len(bigrams) - math.ceil(low * len(bigrams) - 1e-9) + 1])
    return sorted(words)


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(value) for value in values])


def scan_licences(
    docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_notices, licence, dice, licences`` of every row.

    Every line of a text, and a text of several lines as a whole, is normalised (lower case; letters and digits of any
    script are words) and compared with every template whose size allows ``threshold``: for sets of ``a`` and ``b`` bigrams
    Dice is at most ``2 min(a, b) / (a + b)``. A unit's notice is its best template, ties by name. Then windows of as many
    words as a template has are compared with it over the words of the whole text, whatever the line breaks, but for lines
    that are notices themselves; of windows that overlap the one with most of its template's bigrams counts (then the higher
    Dice, the name, the first). In a text that is a notice as a whole, windows of that template do not count again.

    ``n_notices`` counts units with a notice and windows, ``licences`` lists their names, and ``licence`` and ``dice`` are the
    best of the text. A text without a notice, empty or NULL has 0, NULL, NULL and an empty list. Rows are judged alone, so
    repeated rows, NULL ids and an empty table need no care; other columns are ignored. No row is moved.

    Only windows that begin with a bigram of their template are compared: any other one can move on to its first such
    bigram and loses none. A text whose distinct bigrams hold too few of a template's has no window of it.

    Units that cannot match are left out first. A match holds a share ``threshold / (2 - threshold)`` of its template's
    bigrams, so it holds one of any set of bigrams with more than the rest, and so one of ``needles``. A unit of fewer words
    than the smallest template needs, or of more distinct words than the largest allows (a new word makes a new bigram),
    is out as well.
    """
    templates = TEMPLATES | FULL_TEXTS if templates is None else templates
    own = {name: template_bigrams(text) for name, text in sorted(templates.items())}
    if not own or not all(own.values()):
        raise ValueError("every template needs two words")
    low = threshold / (2 - threshold)
    fewest = min(len(x) for x in own.values()) * low
    most = max(len(x) for x in own.values()) / low
    wanted_words = needles(own, low)
    long_words = [F.lit(word) for word in wanted_words if len(word) > 3]
    short_words = "|".join(word for word in wanted_words if len(word) <= 3)

    def possible(lowered: Column) -> Column:
        tests = [lowered.contains(word) for word in long_words]
        if short_words:
            tests.append(lowered.rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{short_words})(?![\p{{L}}\p{{N}}])"))
        return functools.reduce(lambda a, b: a | b, tests)

    def judged(bigrams: Column) -> Column:
        found = []
        for name, wanted in own.items():
            size, common = F.size(bigrams), F.size(F.array_intersect(bigrams, _strings(wanted)))
            fits = (size >= len(wanted) * low) & (size <= len(wanted) / low)
            dice = 2.0 * common / (size + len(wanted))
            found.append(F.when(fits & (dice >= threshold), F.struct((-dice).alias("minus"), F.lit(name).alias("name"))))
        return F.array_min(F.array(*found))

    lengths = {name: len(template_words(text)) - 1 for name, text in templates.items()}
    every = sorted({pair for bigrams in own.values() for pair in bigrams})

    def windows(name: str, pairs: Column, hits: Column) -> Column:
        """``(less, minus, name, start, end)`` of the windows that match one template; places are those of bigrams."""
        wanted, length = own[name], lengths[name]
        needed = math.ceil(len(wanted) * low - 1e-9)

        def window(hit: Column) -> Column:
            def scored(bigrams: Column) -> Column:
                common = F.size(F.array_intersect(bigrams, _strings(wanted)))
                return F.struct(
                    (-common).alias("less"), (-2.0 * common / (F.size(bigrams) + len(wanted))).alias("minus"),
                    F.lit(name).alias("name"), hit["at"].alias("start"), (hit["at"] + length).alias("end"),
                )

            return _bound(F.array_distinct(F.slice(pairs, hit["at"] + 1, F.lit(length))), scored)

        def judged_windows(mine: Column) -> Column:
            def close(hit: Column, at: Column) -> Column:
                return F.get(mine, at + (needed - 1))["at"] < hit["at"] + length

            enough = F.size(F.array_distinct(F.transform(mine, lambda hit: hit["pair"]))) >= needed
            return F.when(enough, F.filter(
                F.transform(F.filter(mine, close), window), lambda one: one["minus"] <= -threshold))

        return _bound(F.filter(hits, lambda hit: hit["pair"].isin(wanted)), judged_windows)

    def window_notices(words: Column, whole: Column) -> Column:
        kind = "array<struct<less:int,minus:double,name:string,start:int,end:int>>"
        again = F.coalesce(whole["name"], F.lit(""))

        def of_hits(pairs: Column) -> Column:
            hits = F.array_compact(F.transform(pairs, lambda pair, at: F.when(
                pair.isin(every), F.struct(at.alias("at"), pair.alias("pair")))))
            return _bound(hits, lambda hits: F.flatten(F.array(*[
                F.coalesce(windows(name, pairs, hits), F.array().cast(kind)) for name in own
            ])))

        def add(chosen: Column, one: Column) -> Column:
            taken = F.exists(chosen, lambda other: (other["start"] <= one["end"]) & (one["start"] <= other["end"]))
            return F.when(taken, chosen).otherwise(F.concat(chosen, F.array(one)))

        def best(found: Column) -> Column:
            own_first = F.concat(F.filter(found, lambda one: one["name"] == again), F.filter(found, lambda one: one["name"] != again))
            return F.filter(F.aggregate(own_first, F.array().cast(kind), add), lambda one: one["name"] != again)

        return F.transform(
            _bound(F.array_sort(_bound(_pairs(words), of_hits)).cast(kind), best),
            lambda one: F.struct(one["minus"].alias("minus"), one["name"].alias("name")),
        )

    def unit_notice(lowered: Column) -> Column:
        """The notice of a line or text, NULL if it is none."""
        def fitting(unit: Column) -> Column:
            return F.when(
                (F.size(unit) - 1 >= fewest) & (F.size(F.array_distinct(unit)) - 1 <= most),
                _bound(_bigrams(unit), judged),
            )

        return F.when(possible(lowered), _bound(_words(lowered), fitting))

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def of_text(lines: Column) -> Column:
        return _bound(F.when(F.size(lines) > 1, unit_notice(F.lower("text"))), lambda whole: with_whole(lines, whole))

    def with_whole(lines: Column, whole: Column) -> Column:
        judged_lines = F.transform(lines, lambda line: F.struct(line.alias("line"), unit_notice(line).alias("notice")))

        def both(found: Column) -> Column:
            notices = F.array_compact(F.concat(F.transform(found, lambda one: one["notice"]), F.array(whole)))
            rest = F.array_join(F.transform(
                found, lambda one: F.when(one["notice"].isNull(), one["line"]).otherwise(F.lit(_BREAK))), " ")
            return F.concat(notices, window_notices(_words(rest), whole))

        return _bound(judged_lines, both)

    found_in_text = _bound(F.split(F.lower("text"), "\n"), of_text)
    notices = F.when(possible(F.lower("text")), found_in_text).otherwise(F.array().cast("array<struct<minus:double,name:string>>"))
    found = texts.select("doc_id", notices.alias("notices"))
    best = F.array_min("notices")
    return found.select(
        "doc_id", F.size("notices").cast("bigint").alias("n_notices"), best["name"].alias("licence"),
        (-best["minus"]).alias("dice"),
        F.array_sort(F.array_distinct(F.transform("notices", lambda notice: notice["name"]))).alias("licences"),
    )


def licence_sql(templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """The same as DuckDB SQL over ``documents``, without the early tests."""
    own = {name: template_bigrams(text) for name, text in (templates or TEMPLATES).items()}
    rows = ", ".join(
        f"('{name}', [{', '.join(repr(pair) for pair in bigrams)}])" for name, bigrams in sorted(own.items())
    )
    return f"""
    WITH template(name, wanted) AS (VALUES {rows}),
    texts AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
    lines AS (SELECT r, string_split(text, chr(10)) AS lines, text FROM texts),
    units AS (
      SELECT r, unnest(CASE WHEN len(lines) > 1 THEN list_append(lines, text) ELSE lines END) AS unit FROM lines),
    words AS (
      SELECT r, row_number() OVER () AS u,
        string_split(trim(regexp_replace(lower(unit), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM units),
    bigrams AS (
      SELECT r, u, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b
      FROM words WHERE len(w) > 1 AND len(list_distinct(w)) < 1000),
    scored AS (
      SELECT r, u, name, 2.0 * len(list_intersect(b, wanted)) / (len(b) + len(wanted)) AS dice
      FROM bigrams, template WHERE len(list_intersect(b, wanted)) > 0),
    notices AS (
      SELECT r, u, name, dice FROM scored WHERE dice >= {threshold}
      QUALIFY row_number() OVER (PARTITION BY u ORDER BY dice DESC, name) = 1),
    found AS (
      SELECT r, count(*) AS n, arg_min(name, (-dice, name)) AS licence, max(dice) AS dice,
        list_sort(list(DISTINCT name)) AS licences
      FROM notices GROUP BY r)
    SELECT doc_id, coalesce(n, 0) AS n_notices, licence, CAST(dice AS DOUBLE) AS dice, coalesce(licences, []) AS licences
    FROM texts LEFT JOIN found USING (r)
    """
