from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from querydelta.session import CHUNK_ROWS, local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def con():
    from tools.check_oracle import duck

    return duck(SMALL)


@pytest.fixture
def tiny_groups(spark):
    """Deal rows into chunks of three."""
    spark.conf.set(CHUNK_ROWS, "3")
    yield
    spark.conf.unset(CHUNK_ROWS)


@pytest.fixture
def rows(spark):
    """``rows("a int, b string", (1, "x"), ...)`` as a DataFrame; no rows make an empty one."""

    def build(schema: str, *values):
        return spark.createDataFrame(list(values), schema)

    return build


def table(df, key, *columns):
    """The rows as a dict from ``key`` to a tuple of ``columns``, or to the only one."""
    out = {}
    for row in df.collect():
        values = tuple(row[name] for name in columns)
        out[row[key]] = values if len(values) > 1 else values[0]
    return out
