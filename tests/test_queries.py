"""Registered queries against DuckDB. ``ALL_QUERIES=1`` checks every one at sf0.01 (slow)."""

import os

import pytest

import __spark_entry__ as entry
from compare import check, duck

EVERY = os.environ.get("ALL_QUERIES") == "1"
SF = "/root/testdata/sf0.01" if EVERY else "/root/testdata/sf0.001"
SAMPLE = ["split_ranking_metrics", "six_way_splits", "overlap_counts_salted", "hydrate_windows", "scan_motifs", "single_edits", "paired_permutation", "prediction_store", "stream_latest", "usage_labels"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()) if EVERY else SAMPLE)
def test_query(spark, con, name):
    ok, note = check(spark, con, SF, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, note


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
