import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from treemill.functions import text as fn
from treemill.operators import align, evaluate, match, parsing, rewrite, rules, transitions, tree
from treemill.sources import conll, other
from treemill.streaming import counts

CONLL = "1\tThe\tthe\tDT\tDT\t_\t2\tNMOD\t_\t_\n2\tcat\tcat\tNN\tNN\tn=s|g=f\t3\tSBJ\t_\t_\n3\tsat\tsit\tVB\tVB\t_\t0\tROOT\t_\t_\n\n1\tbroken\n\n1\tGo\tgo\tVB\tVB\t_\t0\tROOT\t_\t_"
ROLES = "1\tShe\tshe\tshe\tPRP\tPRP\t_\t_\t2\t2\tSBJ\tSBJ\t_\t_\tA0\t_\n2\tsaw\tsee\tsee\tVB\tVB\t_\t_\t0\t0\tROOT\tROOT\tY\tsee.1\t_\tA1\n3\tgone\tgo\tgo\tVB\tVB\t_\t_\t2\t2\tOBJ\tOBJ\tY\tgo.1\tA1\t_\n"


def tokens(spark, words):
    return spark.createDataFrame([(1, i, w, w.lower(), p) for i, (w, p) in enumerate(words)], "sent_id long, idx int, form string, lemma string, pos string")


def deps(spark, arcs):
    return spark.createDataFrame([(1, *a) for a in arcs], "sent_id long, gov int, head int, label string")


def test_conll06_reads_last_sentence_and_skips_broken_ones(spark, tmp_path):
    (tmp_path / "a.conll").write_text(CONLL)
    toks, arcs, _ = conll.read(spark, str(tmp_path / "a.conll"))
    assert [r.form for r in toks.orderBy("sent_id", "idx").collect()] == ["The", "cat", "sat", "Go"]
    assert {(r.gov, r.head, r.label) for r in arcs.collect()} == {(0, 1, "NMOD"), (1, 2, "SBJ")}
    out = str(tmp_path / "out")
    conll.write(conll.lines06(toks, arcs), out)
    again, arcs2, _ = conll.read(spark, out + "/*.txt")
    assert sorted(r.form for r in again.collect()) == sorted(r.form for r in toks.collect())
    assert {(r.gov, r.head, r.label) for r in arcs2.collect()} == {(0, 1, "NMOD"), (1, 2, "SBJ")}
    assert again.where("form = 'cat'").first()["extra"]["FEATS"] == "n=s|g=f"


def test_conll09_round_trip_with_roles(spark, tmp_path):
    (tmp_path / "a").write_text(ROLES)
    toks, arcs, roles = conll.read(spark, str(tmp_path / "a"), "09")
    assert {(r.gov, r.head, r.label) for r in roles.collect()} == {(0, 1, "A0"), (2, 1, "A1"), (1, 2, "A1")}
    assert conll.lines09(toks, arcs, roles).first()["text"] == ROLES


def test_brackets(spark, tmp_path):
    (tmp_path / "a.mrg").write_text("( (S (NP (DT The)\n (NN cat)) (VP (VB sat))))\n( (S (VB Go)))\n")
    found = other.brackets(spark, str(tmp_path / "a.mrg")).orderBy("sent_id", "idx").collect()
    assert [(r.sent_id, r.idx, r.pos, r.form) for r in found] == [(0, 0, "DT", "The"), (0, 1, "NN", "cat"), (0, 2, "VB", "sat"), (1, 0, "VB", "Go")]


def test_numbers_run_on_over_files(spark, tmp_path):
    (tmp_path / "a.mrg").write_text("(S (X a))\n(S (X b)\n  (X c))\n")
    (tmp_path / "b.mrg").write_text("(S)\n(S (X d))\n")
    (tmp_path / "c.mrg").write_text("(S (X e))\n")
    found = other.brackets(spark, str(tmp_path)).collect()
    assert sorted((r.sent_id, r.idx, r.form) for r in found) == [(0, 0, "a"), (1, 0, "b"), (1, 1, "c"), (2, 0, "d"), (3, 0, "e")]


def test_transcripts(spark, tmp_path):
    (tmp_path / "a.stm").write_text("x male> hello there\nno\n")
    (tmp_path / "a.trs").write_text("<Turn>\n<Sync/>\nhello\n# c\nyou\n</Turn>\n<Turn>\nbye\n</Turn>\n")
    assert [r.text for r in other.stm(spark, str(tmp_path / "a.stm")).collect()] == ["hello there"]
    assert [r.text for r in other.trs(spark, str(tmp_path / "a.trs")).orderBy("turn").collect()] == ["hello you", "bye"]


def test_transcript_in_another_encoding(spark, tmp_path):
    (tmp_path / "b.stm").write_bytes("x male> été\n".encode("latin-1"))
    assert other.stm(spark, str(tmp_path / "b.stm"), "ISO-8859-1").first()["text"] == "été"


def test_xml_round_trip(spark, tmp_path):
    toks = tokens(spark, [("The", "DT"), ("cat", "NN")])
    arcs = deps(spark, [(0, 1, "NMOD")])
    groups = spark.createDataFrame([(1, "NP", 0, 1)], "sent_id long, name string, first_idx int, last_idx int")
    (tmp_path / "a.xml").write_text(other.xml_lines(toks, arcs, groups).first()["text"])
    words, arcs2, spans = other.read_xml(spark, str(tmp_path / "a.xml"))
    assert [(r.idx, r.form, r.pos) for r in words.orderBy("idx").collect()] == [(0, "The", "DT"), (1, "cat", "NN")]
    assert [tuple(r) for r in arcs2.collect()] == [(1, 0, 1, "NMOD")]
    assert [tuple(r) for r in spans.collect()] == [(1, "NP", 0, 1)]


def test_root_words_pass_head_tests(spark):
    words = match.linked(tokens(spark, [("a", "D"), ("b", "N"), ("c", "V")]), deps(spark, [(0, 1, "DET")]))
    found = match.search(words, [match.Triplet(head="head_pos = 'X'")])
    assert {r.dep0 for r in found.collect()} == {1, 2}


def test_first_and_closest(spark):
    words = match.linked(tokens(spark, [("a", "A"), ("b", "B"), ("a", "A"), ("b", "B")]), deps(spark, [(0, 1, "X")]))
    pair = [match.Triplet("pos = 'A'"), match.Triplet("pos = 'B'")]
    assert {(r.dep0, r.dep1) for r in match.search(words, pair, mode="first").collect()} == {(0, 1), (2, 1)}
    assert {(r.dep0, r.dep1) for r in match.search(words, pair, closest=("dep1", "dep0")).collect()} == {(0, 1), (2, 1)}


def test_cycles_end(spark):
    toks, arcs = tokens(spark, [("a", "A"), ("b", "B"), ("c", "C")]), deps(spark, [(0, 1, "X"), (1, 0, "X"), (2, 1, "X")])
    assert {r.idx for r in tree.cyclic(toks, arcs).collect()} == {0, 1}
    assert {(r.idx, r.root) for r in tree.root_of(toks, arcs).collect()} == {(0, None), (1, None), (2, None)}


def test_rules_keep_protected_labels(spark):
    arcs = deps(spark, [(0, 1, "_P"), (1, 2, "Q")])
    new = deps(spark, [(0, 2, "N"), (1, 0, "N"), (1, 3, "N"), (2, 1, "N")])
    assert {(r.gov, r.head, r.label) for r in rules.applied(arcs, new, replace=True).collect()} == {(0, 1, "_P"), (1, 0, "N"), (2, 1, "N")}
    assert {(r.gov, r.head, r.label) for r in rules.applied(arcs, new).collect()} == {(0, 1, "_P"), (1, 2, "Q"), (2, 1, "N")}


def test_added_arcs_skip_roots_and_repeats(spark):
    found = spark.createDataFrame([(1, 0, 1), (1, 1, -1), (1, 0, 1)], "sent_id long, dep0 int, head0 int")
    assert rewrite.add_arcs(deps(spark, [(0, 1, "X")]), found, "dep0", "head0", "X").count() == 1
    assert rewrite.add_arcs(deps(spark, [(0, 1, "X")]), found, "dep0", "head0", "Y").count() == 2


def test_perfect_system(spark):
    toks, arcs = tokens(spark, [("a", "A"), ("b", "B")]), deps(spark, [(0, 1, "X")])
    found = evaluate.attachment(evaluate.side_by_side(toks, arcs, arcs)).first()
    assert (found.uas, found.las) == (1, 1)


def test_projection_onto_itself(spark):
    toks, arcs = tokens(spark, [("a", "A"), ("b", "B"), ("a", "A")]), deps(spark, [(0, 1, "X"), (2, 1, "Y")])
    linked = align.links(toks, toks)
    assert {tuple(r) for r in align.project_arcs(arcs, linked).collect()} == {tuple(r) for r in arcs.collect()}
    assert align.edits(toks, toks, linked).first().matched == 3


def test_closest_against_all_pairs(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["the", "of", "and"]) for _ in range(rng.randint(1, 7))) for _ in range(170)]
    rows = list(enumerate([*texts, "quite rare words", "quite rare word", "", None]))
    df = spark.createDataFrame(rows, "sent_id long, text string")
    asked = df.where("sent_id % 10 = 0 or sent_id >= 170")
    got = {r.sent_id: (r.distance, r.near_id) for r in align.closest(asked, df, rows=20).collect()}
    best = {i: min((_distance(a, b), j) for j, b in rows if b is not None and j != i) for i, a in rows if a is not None and (i % 10 == 0 or i >= 170)}
    assert got == best


def _distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(now[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def test_spanning_trees_against_all_trees():
    rng = np.random.default_rng(1)
    for n in (2, 3, 4, 5):
        for _ in range(20):
            w = rng.normal(size=(n, n))
            best = max(sum(w[h, d] for d, h in enumerate(hs, 1)) for hs in itertools.product(range(n), repeat=n - 1) if _is_tree(hs))
            heads = parsing.tree_of(w)
            assert _is_tree(heads[1:]) and sum(w[heads[d], d] for d in range(1, n)) == pytest.approx(best)


def _is_tree(heads):
    for d in range(1, len(heads) + 1):
        seen = set()
        while d:
            if d in seen:
                return False
            seen.add(d)
            d = heads[d - 1]
    return True


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    start, move, emit = rng.normal(size=3), rng.normal(size=(3, 3)), rng.normal(size=(4, 3))
    score = lambda p: start[p[0]] + sum(move[a, b] for a, b in itertools.pairwise(p)) + sum(emit[i, s] for i, s in enumerate(p))
    assert tuple(parsing.viterbi(start, move, emit)) == max(itertools.product(range(3), repeat=4), key=score)


def test_spanning_trees_in_spark(spark):
    rows = [(1, 0, 1, 5.0), (1, 1, -1, 5.0), (1, 0, -1, 1.0), (1, 1, 0, 1.0)]
    found = parsing.spanning_trees(spark.createDataFrame(rows, "sent_id long, gov int, head int, weight double"))
    assert {(r.gov, r.head) for r in found.collect()} == {(0, 1), (1, -1)}


def test_transitions():
    assert transitions.oracle([1, -1, 1]) == ["SHIFT", "LA", "SHIFT", "RA"]


def test_tokenizer(spark):
    df = spark.createDataFrame([("l’ami dit: aujourd'hui, 4.5 !",)], "t string")
    found = df.select(fn.tokenize(F.col("t")).alias("words"), fn.offsets(F.col("t")).alias("o")).first()
    assert found.words == ["l'", "ami", "dit", ":", "aujourd'hui", ",", "4", ".", "5", "!"]
    assert [(o.begin, o.end) for o in found.o][:3] == [(0, 2), (2, 5), (6, 9)]


def test_small_functions(spark):
    df = spark.createDataFrame([("n=s|g=f", "A [x] b (y)", "12", "3.5", "a b")], "f string, c string, i string, r string, k string")
    got = df.select(fn.feature(F.col("f"), "g"), fn.without_comments(F.col("c")), fn.number_class(F.col("i")), fn.number_class(F.col("r")), fn.add_note(F.col("k"), "c"), fn.drop_note(F.col("k"), "a")).first()
    assert tuple(got) == ("f", "A b", "entier", "reel", "a b c", "b")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text(CONLL)
    q = counts.label_counts(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("labels").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("labels").where("label = 'ROOT'").first()["n"] == 2
