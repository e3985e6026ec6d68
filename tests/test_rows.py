"""Queries that look at a sentence or a document where it is: nothing but the texts and the results is shuffled, and documents
that share a key are looked at together, as they were.
"""

import random

import __spark_entry__
import numpy as np
import pytest
from pyspark.sql import functions as F

from treemill.operators import forest, frames, match, multiwords, segments, transitions, tree, wordrules
from treemill.operators.match import Triplet
from treemill.operators.wordrules import WordRule

WORDS = ["the", "Paris", "seen", "it", "quickly", "42", "of", "l'or", "aujourd'hui", "national", "x.", "a,b", "Rome,", "...", "orange", "é漢", "walk"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw, out = random.Random(5), tmp_path_factory.mktemp("texts")
    texts = [(k, "".join(draw.choice(WORDS) + draw.choice([" ", "  ", "\n", ". ", "! "]) for _ in range(draw.randrange(120)))) for k in range(60)]
    spark.createDataFrame([*texts, (60, ""), (61, None), (62, "one")], "doc_id long, text string").repartition(5).write.parquet(f"{out}/documents.parquet")
    return str(out)


def treebank(spark, folder):
    from treemill.sources.adapter import Treebank

    return Treebank(spark, folder)


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def narrow(spark, folder, name):
    plan = __spark_entry__.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(sent_id" not in plan and "hashpartitioning(doc" not in plan.replace("hashpartitioning(doc_id", "") and "Join" not in plan and "Window" not in plan


def twice(spark, folder, tmp_path, name):
    """Half of the documents twice: the query gives what it gave for all of them as words."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.unionByName(docs.where("doc_id % 2 = 0")).write.parquet(f"{tmp_path}/documents.parquet")
    return __spark_entry__.queries()[name](spark, str(tmp_path)), treebank(spark, str(tmp_path))


def test_only_between(spark, folder, tmp_path):
    narrow(spark, folder, "match_onlyp_between")
    found, tb = twice(spark, folder, tmp_path, "match_onlyp_between")
    pairs = match.search(tb.linked, [Triplet("pos = 'NAM'"), Triplet("pos = 'VER'")], "dep0 < dep1 and dep1 <= dep0 + 8")
    same(found, match.between(pairs, tb.linked, "dep0", "dep1", ~F.col("pos").isin("DET", "PRP"), present=False).select("sent_id", "dep0", "dep1"))
    tb = treebank(spark, folder)
    for present in (True, False):
        pairs = match.search(tb.linked, [Triplet("pos = 'DET'"), Triplet()], "dep0 < dep1")
        rows = match.search(tb.rows("poss", "heads", "labels"), [Triplet("pos = 'DET'"), Triplet()], "dep0 < dep1", keep=("poss",))
        one = match.between(pairs, tb.linked, "dep0", "dep1", F.col("pos") == "NUM", present)
        same(match.between(rows, None, "dep0", "dep1", lambda pos: pos == "NUM", present).select("sent_id", "dep0", "dep1"), one.select("sent_id", "dep0", "dep1"))


def test_penalties(spark, folder, tmp_path):
    narrow(spark, folder, "topology_penalties")
    found, tb = twice(spark, folder, tmp_path, "topology_penalties")
    same(found, tree.penalties(tb.tokens, tb.gold))
    tb = treebank(spark, folder)
    same(tree.penalties(tb.rows("heads")), tree.penalties(tb.tokens, tb.gold))


def test_overlaps(spark, folder, tmp_path):
    narrow(spark, folder, "segment_overlaps")
    twice(spark, folder, tmp_path, "segment_overlaps")[0].collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("text is not null").select(F.col("doc_id").alias("doc"), "text")
    from treemill.plans import catalog

    found = segments.overlaps_in(docs, catalog._view_places, catalog._token_places, "idx_a int, n_b long")
    one = segments.overlaps(*catalog._two(treebank(spark, folder)))
    same(found, one.select("doc", "idx_a", "n_b", "shared"))


def test_rules(spark, folder, tmp_path):
    from treemill.plans.catalog import WORD_RULES

    narrow(spark, folder, "word_rules")
    twice(spark, folder, tmp_path, "word_rules")[0].collect()
    tb = treebank(spark, folder)
    rules = [*WORD_RULES, *[WordRule(f"r{n}", f"pos = '{('DET', 'NOM', 'VER')[n % 3]}'", ("after", "before", n % 9 - 4)[n % 3], "L", "pos = 'VER'", "head >= 0 or size(sons) > 1", ("label = 'SUJ'", None)[n % 2]) for n in range(70)]]
    columns = ["rule", "sent_id", "gov", "head", "label"]
    rows = tb.rows("forms", "poss", "heads", "labels")
    same(wordrules.candidates(rows, rules).select(*columns), wordrules.candidates(tb.linked, rules).select(*columns))
    assert wordrules.candidates(rows, []).count() == 0


def test_replays_and_repairs(spark, folder):
    plan = __spark_entry__.queries()["transition_replays"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "collect_list" not in plan
    draw = random.Random(1)
    for n in range(150):
        trees = [[draw.choice([-1, -1, *[h for h in range(m) if h != i]]) for i in range(m)] for m in [draw.randrange(14) for _ in range(draw.randrange(1, 12))]]
        sizes, heads = np.array([len(t) for t in trees]), np.array([h for t in trees for h in t], np.int64)
        starts = np.cumsum(sizes) - sizes
        assert forest.repaired_all(starts, sizes, heads).tolist() == [h for t in trees for h in forest.repaired(t)]
        *_, at, actions = transitions.steps_of(heads, starts, sizes)
        if n % 2:
            actions = np.array([draw.randrange(4) for _ in at], np.int64)
        of = np.searchsorted(starts, at, "right") - 1
        given = [h for k, t in enumerate(trees) for h in transitions.replayed([transitions.ACTIONS[a] for a in actions[of == k]], len(t))]
        assert transitions.replayed_all(at, actions, starts, sizes).tolist() == given


def test_enriched_and_frames(spark, folder):
    tb = treebank(spark, folder)
    rows = match.enriched(tb.rows("forms", "poss", "heads", "labels", "names", "firsts", "lasts"))
    words = rows.select("sent_id", "size", F.posexplode(F.arrays_zip("childrens", "roots", "startss", "insides")).alias("idx", "w"))
    in_order = lambda c: F.sort_array(c)
    found = words.select("sent_id", "idx", "w.childrens", "size", "w.roots", in_order("w.startss"), in_order("w.insides"))
    same(found, match.enriched(tb.linked, tb.groups).select("sent_id", "idx", "children", "size", "root", in_order("starts"), in_order("inside")))
    columns = ["sent_id", "idx", "lemma", "args"]
    same(frames.observed(tb.rows("forms", "poss", "heads", "labels"), F.col("pos") == "VER").select(*columns), frames.observed(tb.linked, F.col("pos") == "VER").select(*columns))


def test_units_in_rows(spark, folder):
    tb = treebank(spark, folder)
    units = [("the_Paris",), ("of_the",), ("of_the_seen",), ("seen_it_of",), ("42_42",), ("Paris_seen",)]
    lexicon = spark.createDataFrame([(f[0], "l", "M") for f in units], "form string, lemma string, pos string")
    columns = ["sent_id", "first_idx", "last_idx", "form", "pos"]
    found = multiwords.found_units(tb.rows("forms"), lexicon).select(*columns)
    assert found.count() > 3
    same(found, multiwords.found_units(tb.tokens, lexicon).select(*columns))
    words, arcs, _ = multiwords.merged(tb.tokens, tb.gold, tb.groups, lexicon)
    rows = multiwords.merged_rows(tb.rows("forms", "poss", "heads", "labels"), lexicon).select("sent_id", F.posexplode(F.arrays_zip("forms", "poss", "heads", "labels")).alias("idx", "w"))
    same(rows.select("sent_id", "idx", "w.forms", "w.poss"), words.select("sent_id", "idx", "form", "pos"))
    same(rows.where("w.heads >= 0").select("sent_id", "idx", "w.heads", "w.labels"), arcs.select("sent_id", "gov", "head", "label"))
    n = multiwords.pairs(tb.rows("forms")).groupBy("form").agg(F.sum("n").alias("n"))
    from pyspark.sql import Window

    two = tb.tokens.withColumn("form", F.concat_ws("_", "form", F.lead("form").over(Window.partitionBy("sent_id").orderBy("idx")))).withColumn("_n", F.lead("idx").over(Window.partitionBy("sent_id").orderBy("idx")))
    same(n, two.where("_n is not null").groupBy("form").agg(F.count("*").alias("n")))
