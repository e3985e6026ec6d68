"""Multiword units against a plain loop, and what merging and cutting do to arcs and groups."""

import random

from treemill.operators import multiwords

WORDS = "sent_id long, idx int, form string, lemma string, pos string"
ARCS = "sent_id long, gov int, head int, label string"
SPANS = "sent_id long, name string, first_idx int, last_idx int"


def made(spark, sentences):
    return spark.createDataFrame([(s, i, w, w.lower(), "P") for s, words in enumerate(sentences) for i, w in enumerate(words.split())], WORDS)


def lexicon(spark, forms):
    return spark.createDataFrame([(f, f"L{f}", "MWE") for f in forms], "form string, lemma string, pos string")


def plain(words, forms):
    at, out = 0, []
    while at < len(words):
        k = max((len(f.split("_")) for f in forms if "_" in f and words[at : at + len(f.split("_"))] == f.split("_")), default=1)
        if k > 1:
            out.append((at, at + k - 1))
        at += k
    return out


def test_leftmost_longest_units(spark):
    rng = random.Random(1)
    sentences = [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(80)]
    forms = ["a_b", "b_c_a", "a_b_c_c", "c_c", "b_a_b_a_b", "a_a_a", "a", "b_c"]
    found = multiwords.found_units(made(spark, sentences), lexicon(spark, [*forms, "a_b"]))
    want = {(s, *u) for s, words in enumerate(sentences) for u in plain(words.split(), forms)}
    rows = found.collect()
    assert {(r.sent_id, r.first_idx, r.last_idx) for r in rows} == want and len(rows) == len(want)
    assert all(r.form == "_".join(sentences[r.sent_id].split()[r.first_idx : r.last_idx + 1]) and r.lemma == f"L{r.form}" for r in rows)
    assert multiwords.found_units(made(spark, sentences), lexicon(spark, ["a"])).count() == 0


def test_merging_renumbers_arcs_and_groups(spark):
    words = made(spark, ["we saw at least New York City today"])
    arcs = spark.createDataFrame([(0, 0, 1, "S"), (0, 2, 3, "in"), (0, 3, 6, "M"), (0, 4, 6, "in"), (0, 5, 6, "in"), (0, 6, 1, "O"), (0, 7, 1, "T"), (0, 2, 7, "X")], ARCS)
    groups = spark.createDataFrame([(0, "G", 3, 6), (0, "H", 5, 5), (0, "H", 6, 6)], SPANS)
    toks, deps, spans = multiwords.merged(words, arcs, groups, lexicon(spark, ["at_least", "New_York", "New_York_City", "York_City"]))
    assert [(r.idx, r.form, r.lemma, r.pos) for r in toks.orderBy("idx").collect()] == [(0, "we", "we", "P"), (1, "saw", "saw", "P"), (2, "at_least", "Lat_least", "MWE"), (3, "New_York_City", "LNew_York_City", "MWE"), (4, "today", "today", "P")]
    assert {tuple(r) for r in deps.collect()} == {(0, 0, 1, "S"), (0, 2, 4, "X"), (0, 3, 1, "O"), (0, 4, 1, "T")}
    assert {tuple(r) for r in spans.collect()} == {(0, "G", 2, 3), (0, "H", 3, 3)}


def test_splitting_undoes_merging(spark):
    words = made(spark, ["x New_York_City _ y", "a_b"])
    arcs = spark.createDataFrame([(0, 1, 0, "A"), (0, 3, 1, "B")], ARCS)
    groups = spark.createDataFrame([(0, "G", 1, 1), (0, "K", 0, 2)], SPANS)
    toks, deps, spans = multiwords.split(words, arcs, groups)
    assert [(r.sent_id, r.idx, r.form, r.pos) for r in toks.orderBy("sent_id", "idx").collect()] == [(0, 0, "x", "P"), (0, 1, "New", "P"), (0, 2, "York", "unk"), (0, 3, "City", "unk"), (0, 4, "_", "P"), (0, 5, "y", "P"), (1, 0, "a", "P"), (1, 1, "b", "unk")]
    assert {tuple(r) for r in deps.collect()} == {(0, 1, 0, "A"), (0, 5, 1, "B")}
    assert {tuple(r) for r in spans.collect()} == {(0, "G", 1, 3), (0, "K", 0, 4)}


def test_retokenizing_cuts_and_deletes(spark):
    words = made(spark, ["l'ami (*) aujourd'hui a_b"])
    arcs = spark.createDataFrame([(0, 0, 2, "A"), (0, 1, 0, "gone"), (0, 3, 1, "gone"), (0, 3, 0, "B")], ARCS)
    groups = spark.createDataFrame([(0, "G", 0, 1), (0, "empty", 1, 1), (0, "K", 1, 3)], SPANS)
    toks, deps, spans = multiwords.retokenized(words, arcs, groups)
    assert [(r.idx, r.form, r.lemma, r.pos) for r in toks.orderBy("idx").collect()] == [(0, "l'", "l'", "P"), (1, "ami", "ami", "P"), (2, "aujourd'hui", "aujourd'hui", "P"), (3, "a", "a", "P"), (4, "b", "b", "P")]
    assert {tuple(r) for r in deps.collect()} == {(0, 0, 2, "A"), (0, 3, 0, "B")}
    assert {tuple(r) for r in spans.collect()} == {(0, "G", 0, 1), (0, "K", 2, 4)}
