"""Every registered query against its SQL, and the chunked plans once more."""

from __future__ import annotations

import pytest

from querydelta.registry import load
from querydelta.session import CHUNK_ROWS
from tests.conftest import SMALL
from tools.check_oracle import compare

REGISTRY = load()

# Queries that number, rank or frame rows.
POSITIONAL = [
    "ordered_diff", "self_join_range", "self_join_offset", "aggregate_order_reversals", "rank_function_divergence",
    "rank_row_number", "rank_fractions", "rank_ntile", "window_spec_divergence", "window_direction",
    "window_null_placement", "window_aggregate_partition", "frame_divergence", "frame_whole_partition",
    "frame_sliding", "first_last_divergence", "lag_lead_paths", "lag_to_lead", "window_filter_boundary",
    "window_filter_rank", "topn_membership_diff", "topn_offset_change", "grouped_order_divergence",
    "repair_duplicate_keys", "witness_sample_cases", "scope_order", "rank_candidates",
]


def test_contract():
    import __spark_entry__ as entry

    assert set(REGISTRY) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_agrees_with_sql(spark, con, name):
    ok, message = compare(spark, con, REGISTRY[name], SMALL)
    assert ok, message


@pytest.mark.parametrize("name", POSITIONAL)
def test_chunked_plan_agrees_with_sql(spark, con, name):
    spark.conf.set(CHUNK_ROWS, "20")
    try:
        ok, message = compare(spark, con, REGISTRY[name], SMALL)
    finally:
        spark.conf.unset(CHUNK_ROWS)
    assert ok, message


def test_partition_count_does_not_matter(spark, con):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for count in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", count)
            for name in ("bag_diff", "frame_divergence", "join_path_profile", "table_digest"):
                ok, message = compare(spark, con, REGISTRY[name], SMALL)
                assert ok, message
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
