from __future__ import annotations

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, words__ int"


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Nulls, empty and long texts, repeated rows, one id twice, a clashing column."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    long = "word " * 30_000
    text = "One two three four five six seven eight nine ten, eleven. mail a.b@c.de or +1 (212) 555-0100."
    rows = [
        (1, text, "en", "a", 5, 1), (1, text, "en", "a", 5, 1), (2, None, "en", "a", None, 1), (3, "", None, None, 0, 1),
        (None, text + " More.", "en", "a", 1, 1), (4, long, "en", "a", 1, 1), (1, "other text of the same id", "en", "a", 1, 1),
        (5, " \n\t ", "de", "a", 4, 1), (6, "é 日本 🙂", "de", "a", 4, 1), (7, "4111111111111111 12.1.2.3", "de", "a", 1, 1),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark, odd):
    return odd.limit(0)
