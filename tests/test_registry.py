"""Every registered query next to its SQL counterpart, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from turnledger.registry import all_queries, all_sql
from verify import compare, connect

SF, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
# Queries that show positions of sessions with several files; only the middle tables hold every such case.
POSITIONS = ("stream_merge", "narration_reclass", "transcript_errors", "file_operations", "git_operations", "replay_messages", "replay_answers",
             "chat_filter", "day_dividers", "flow_events", "session_markdown", "command_output_tokens", "chars_per_token_by_model")
QUERIES, SQL = all_queries(), all_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_a_counterpart():
    assert set(SQL) == set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, SF, name, QUERIES[name], SQL[name]) is None


@pytest.mark.parametrize("name", POSITIONS)
def test_positions(spark, name):
    assert compare(spark, connect(MIDDLE), MIDDLE, name, QUERIES[name], SQL[name]) is None


def test_a_second_file_without_a_first(spark):
    """The middle tables hold sessions of which only the second file exists: their positions start at the first file's."""
    from pyspark.sql import functions as F

    from turnledger.registry.transcripts import silver

    files = silver(spark, MIDDLE).groupBy("session_id").agg(F.min("file_stem").alias("first"), F.max("ord").alias("last"))
    alone = files.where(F.col("first").endswith("_b")).collect()
    assert alone and all(r.last < 1 << 48 for r in alone)
