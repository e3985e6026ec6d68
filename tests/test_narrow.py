"""Queries that work inside the sentence: no kept table of words, and no shuffle of words by sentence."""

import __spark_entry__
import pytest

NARROW = [
    "group_runs",
    "sub_groups",
    "aligned_edits",
    "frames_matched",
    "induced_roles",
    "multiword_units",
    "projected_tags",
    "search_groups",
    "search_notes",
    "sequential_posteriors",
    "search_trees",
    "multiwords_merged",
    "alignment_errors",
    "alignment_codes",
    "lexical_preferences",
    "resegmented",
    "retokenized",
    "frequent_subtrees",
    "subtree_including",
    "rewrite_groups",
    "tree_unprojective",
    "delete_reattached",
    "tree_similarity",
    "same_graphs",
    "tree_shapes",
    "tree_faults",
    "subtree_extracted",
    "match_three",
    "frames_in_order",
    "subtree_shares",
    "match_equal_relations",
    "sentences_drawn",
    "sentences_split",
    "match_same_lemma",
    "delete_punctuation",
    "transition_parser",
]
#: What these shuffle by sentence are few rows: those found, or one a sentence.
SOME = ["search_trees", "sentences_drawn", "frames_matched"]


@pytest.mark.parametrize("name", NARROW)
def test_plan(spark, name):
    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" not in plan
    assert name in SOME or "hashpartitioning(sent_id" not in plan
