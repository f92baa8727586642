"""What queries take up beside their result."""

import os

import pytest

import __spark_entry__ as entry
from gavelyard.sources import scratch

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def size(folder):
    return sum(os.path.getsize(os.path.join(d, x)) for d, _, names in os.walk(folder) for x in names)


@pytest.fixture
def left(spark, tmp_path, monkeypatch):
    """Bytes that a query leaves in the folders for intermediate tables."""
    monkeypatch.setattr(scratch, "folder", lambda _, name: f"file://{tmp_path}/{name}-{len(os.listdir(tmp_path))}")
    spark.sparkContext.setCheckpointDir(f"file://{tmp_path}")

    def run(name):
        rows = entry.queries()[name](spark, DATA).collect()
        return rows, size(tmp_path)

    return run


def test_auction_rebuild_keeps_no_copy_of_notices(left):
    rows, kept = left("auction_rebuild")
    assert len(rows) == 1500 and kept < 10_000


def test_auction_rebuild_sources_keeps_no_copy_of_notices(left):
    rows, kept = left("auction_rebuild_sources")
    assert len(rows) == 1500 + sum(1 for r in rows if r.label and not r.label.removeprefix(r.source + ' ').isdigit()) and kept < 10_000


def test_change_history_keeps_no_copy_of_notices(left):
    rows, kept = left("change_history")
    assert len(rows) == len({(r.group_key, r.changed_at, r.field) for r in rows}) > 0 and kept < 10_000


def test_rule_a_unique_match_keeps_no_copy_of_notices(left):
    rows, kept = left("rule_a_unique_match")
    assert rows and all(r.source_id.endswith("-r") for r in rows) and kept < 10_000


def test_rule_b_next_round_keeps_no_copy_of_notices(left):
    rows, kept = left("rule_b_next_round")
    assert rows and all(r.source_id.endswith("-2") for r in rows) and kept < 10_000


def test_register_cases_keeps_no_copy_of_notices(left):
    rows, kept = left("register_cases")
    assert len(rows) == 2000 and kept < 10_000


def test_content_hash_dedup_keeps_no_copy_of_notices(left):
    rows, kept = left("content_hash_dedup")
    assert len(rows) == 4500 and kept < 10_000


def test_reparse_counts_keeps_versions_compressed(left, tmp_path):
    rows, _ = left("reparse_counts")
    assert {r.result: r.n for r in rows} == {"new": 1500, "same": 750, "changed": 750}
    assert not [d for d, _, _ in os.walk(tmp_path) if os.path.basename(d).startswith("rdd-")]
