"""Queries that return every row that they find, not sums over them."""

import __spark_entry__
import pytest

WHOLE = [
    "match_adjacent",
    "match_all_pairs",
    "match_same_lemma",
    "match_three",
    "match_equal_relations",
    "match_group_start",
    "rewrite_dry_run",
    "tree_crossings",
    "rule_any_right",
]


@pytest.mark.parametrize("name", WHOLE)
def test_every_row(spark, name):
    found = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    assert "sent_id" in found.columns and found.count() > found.select("sent_id").distinct().count() > 50
