"""Reading by ending, converting, putting together and editing corpora."""

import pytest
from pyspark.sql import functions as F

from treemill.operators import editing, match, rewrite
from treemill.sources import columns, conll, corpora, other
from treemill.sources.corpora import ARCS, GROUPS, TOKENS, Corpus

CONLL = "1\tThe\tthe\tDT\tDT\t_\t2\tNMOD\t_\t_\n2\tcat\tcat\tNN\tNN\t_\t3\tSBJ\t_\t_\n3\tsat\tsit\tVB\tVB\t_\t0\tROOT\t_\t_\n\n1\tGo\tgo\tVB\tVB\t_\t0\tROOT\t_\t_\n"


def made(spark, sentences, arcs=(), groups=()):
    words = [(s, i, w, w.lower(), w[:1].upper()) for s, text in sentences.items() for i, w in enumerate(text.split())]
    return Corpus(spark.createDataFrame(words, TOKENS), spark.createDataFrame(list(arcs), ARCS), spark.createDataFrame([], ARCS), spark.createDataFrame(list(groups), GROUPS))


def texts(corpus):
    out = {}
    for r in corpus.tokens.orderBy("sent_id", "idx").collect():
        out.setdefault(r.sent_id, []).append((r.idx, r.form))
    assert all([i for i, _ in v] == list(range(len(v))) for v in out.values())
    return {s: " ".join(w for _, w in v) for s, v in out.items()}


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_kinds_by_ending(spark, tmp_path):
    assert [corpora.kind_of(p) for p in ("a/b.conll", "x.CONLL09", "x.mrg.gz", "dir/x.xml/*", "a.ftb")] == ["06", "09", "brackets", "xml", "constituents"]
    with pytest.raises(ValueError):
        corpora.kind_of("a.doc")
    (tmp_path / "a.conll").write_text(CONLL)
    found = corpora.load(spark, str(tmp_path / "a.conll"))
    assert texts(found) == {0: "The cat sat", 1: "Go"} and rows(found.deps) == {(0, 0, 1, "NMOD"), (0, 1, 2, "SBJ")}
    assert found.roles.count() == found.groups.count() == 0


@pytest.mark.parametrize("to", ["06", "08", "09", "xml"])
def test_converting_keeps_words_and_arcs(spark, tmp_path, to):
    (tmp_path / "a.conll").write_text(CONLL)
    corpora.convert(spark, str(tmp_path / "a.conll"), str(tmp_path / "out"), to)
    found = corpora.load(spark, str(tmp_path / "out" / "*.txt"), to)
    assert sorted(texts(found).values()) == ["Go", "The cat sat"]
    assert {r[1:] for r in rows(found.deps)} == {(0, 1, "NMOD"), (1, 2, "SBJ")}


def test_converting_to_brackets(spark, tmp_path):
    (tmp_path / "a.mrg").write_text("( (S (NP (DT The)\n (NN cat)) (VP (VB sat))))\n")
    corpora.convert(spark, str(tmp_path / "a.mrg"), str(tmp_path / "out"), "brackets")
    assert texts(corpora.load(spark, str(tmp_path / "out" / "*.txt"), "brackets")) == {0: "The cat sat"}


def test_appending_interleaving_and_levels(spark):
    a, b = made(spark, {0: "a b", 1: "c"}, [(0, 0, 1, "X")], [(1, "G", 0, 0)]), made(spark, {0: "d", 3: "e f"}, [(3, 1, 0, "Y")])
    both = corpora.append(a, b)
    assert texts(both) == {0: "a b", 1: "c", 2: "d", 5: "e f"} and rows(both.deps) == {(0, 0, 1, "X"), (5, 1, 0, "Y")} and rows(both.groups) == {(1, "G", 0, 0)}
    assert texts(corpora.append(made(spark, {}), b)) == texts(b)
    mixed = corpora.interleave(a, b)
    assert texts(mixed) == {0: "a b", 1: "d", 2: "c", 7: "e f"} and rows(mixed.deps) == {(0, 0, 1, "X"), (7, 1, 0, "Y")}
    stacked = corpora.levels(a, b)
    assert texts(corpora.level(stacked, 1)) == texts(b) and stacked.tokens.count() == 6
    changed = corpora.put_level(stacked, 0, b)
    assert texts(corpora.level(changed, 0)) == texts(corpora.level(changed, 1)) == texts(b)
    assert corpora.without_arcs(a).deps.count() == 0 and corpora.without_arcs(a, "label = 'X'").deps.count() == 1


def test_joining_and_splitting(spark):
    c = made(spark, {0: "a b", 1: "c d e", 2: "f", 4: "g"}, [(0, 0, 1, "X"), (1, 2, 0, "Y"), (2, 0, 0, "Z")], [(1, "G", 1, 2)])
    target = spark.createDataFrame([(0, 0), (1, 0), (4, 0)], "sent_id long, into long")
    both = editing.joined(c, target)
    assert texts(both) == {0: "a b c d e g", 2: "f"} and rows(both.deps) == {(0, 0, 1, "X"), (0, 4, 2, "Y"), (2, 0, 0, "Z")} and rows(both.groups) == {(0, "G", 3, 4)}
    places = spark.createDataFrame([(0, 2), (0, 5), (0, 0)], "sent_id long, idx int")
    cut = editing.split_at(both, places)
    assert texts(cut) == {0: "a b", 1: "c d e", 2: "g", 6: "f"} and rows(cut.deps) == {(0, 0, 1, "X"), (1, 2, 0, "Y"), (6, 0, 0, "Z")} and rows(cut.groups) == {(1, "G", 1, 2)}
    across = editing.split_at(both, spark.createDataFrame([(0, 4)], "sent_id long, idx int"))
    assert (0, 0, 1, "X") in rows(across.deps) and across.deps.count() == 2 and across.groups.count() == 0


def test_drawing_and_shuffling(spark):
    sentences = spark.range(1000).select(F.col("id").alias("sent_id"))
    part = editing.drawn(sentences, 0.237)
    assert part.count() == 237 and rows(part) == rows(editing.drawn(sentences.repartition(7), 0.237)) != rows(editing.drawn(sentences, 0.237, seed=2))
    assert editing.drawn(sentences, 0).count() == 0 and editing.drawn(sentences, 1).count() == 1000
    c = made(spark, {i * 3: f"w{i} x" for i in range(50)}, [(i * 3, 1, 0, f"L{i}") for i in range(50)])
    mixed = editing.shuffled(c)
    assert sorted(texts(mixed)) == sorted(texts(c)) and sorted(texts(mixed).values()) == sorted(texts(c).values()) and texts(mixed) != texts(c)
    assert all(f"w{r.label[1:]} x" == texts(mixed)[r.sent_id] for r in mixed.deps.collect()[:5])


def test_filters(spark):
    c = made(spark, {0: "The cat", 1: "the THE", 2: "cat dog"})
    assert rows(editing.with_words(c.tokens, ["the", "Cat"], 2)) == {(0,)} and rows(editing.with_words(c.tokens, ["cat"])) == {(0,), (2,)}
    notes = spark.createDataFrame([(0, "check this"), (1, None), (2, "recheck")], "sent_id long, note string")
    assert rows(editing.with_notes(notes, F.col("note").rlike("check"))) == {(0,), (2,)}
    assert rows(editing.with_notes(notes, F.col("note").rlike("check"), after=0)) == {(2,)} and editing.with_notes(notes, F.col("note").rlike("check"), after=2).count() == 0
    assert texts(editing.only(c, editing.with_words(c.tokens, ["dog"]))) == {2: "cat dog"} and len(texts(editing.only(c, editing.with_words(c.tokens, ["dog"]), inside=False))) == 2


def test_searches_with_more_tests(spark):
    words = spark.createDataFrame([(1, 0, "a", "a", "A", 1, "X"), (1, 1, "b", "b", "B", -1, "ROOT"), (1, 2, "c", "c", "A", 1, "Y"), (2, 0, "a", "a", "A", -1, "ROOT")], "sent_id long, idx int, form string, lemma string, pos string, head int, label string")
    words = words.join(words.selectExpr("sent_id", "idx as head", "form as head_form", "lemma as head_lemma", "pos as head_pos"), ["sent_id", "head"], "left")
    groups = spark.createDataFrame([(1, "NP", 1, 2), (2, "NP", 0, 0)], GROUPS)
    notes = spark.createDataFrame([(1, "good one")], "sent_id long, note string")
    more = match.enriched(words, groups, notes)
    hits = lambda test, where="true": {(r.sent_id, r.dep0) for r in match.search(more, [match.Triplet(test)], where).collect()}
    assert hits("children = 2") == {(1, 1)} and hits("size = 1") == {(2, 0)} and hits("root = 1") == {(1, 0), (1, 1), (1, 2)}
    assert hits("array_contains(starts, 'NP')") == {(1, 1), (2, 0)} and hits("array_contains(inside, 'NP') and pos = 'A'") == {(1, 2), (2, 0)}
    assert hits("contains(note, 'good')", "children0 = 0") == {(1, 0), (1, 2)}
    plain = match.enriched(words)
    assert plain.where("note is not null or size(starts) > 0").count() == 0


def test_reattaching(spark):
    heads = [1, 2, 3, -1, 3, 4, 7, 6]
    words = spark.createDataFrame([(1, i, f"w{i}", h, f"L{i}") for i, h in enumerate(heads)], "sent_id long, idx int, form string, head int, label string")
    gone = spark.createDataFrame([(1, 1), (1, 2), (1, 4), (1, 7)], "sent_id long, idx int")
    left, arcs = rewrite.reattached(words, gone)
    assert [(r.idx, r.form) for r in left.orderBy("idx").collect()] == [(0, "w0"), (1, "w3"), (2, "w5"), (3, "w6")]
    assert rows(arcs) == {(1, 0, 1, "L0"), (1, 2, 1, "L5")}


def test_nulls_and_signs_in_writers(spark, tmp_path):
    words = spark.createDataFrame([(1, 0, 'a"<&>', None, None), (1, 1, None, "b", "B")], TOKENS)
    arcs = spark.createDataFrame([(1, 0, 1, "x&y")], ARCS)
    groups = spark.createDataFrame([(1, "noun phrase & more", 0, 1), (1, "G 1 2", 1, 1)], GROUPS)
    (tmp_path / "a.xml").write_text(other.xml_lines(words, arcs, groups).first()["text"])
    again, arcs2, groups2 = other.read_xml(spark, str(tmp_path / "a.xml"))
    assert again.orderBy("idx").first()["form"] == 'a"<&>' and rows(arcs2) == rows(arcs) and rows(groups2) == rows(groups)
    for lines, width in ((conll.lines06(words, arcs), 10), (conll.lines09(words.withColumn("sense", F.lit(None).cast("string")), arcs, arcs.limit(0)), 14)):
        assert [len(x.split("\t")) for x in lines.first()["text"].strip("\n").split("\n")] == [width, width]
    roles = spark.createDataFrame([(1, 0, 1, "A0")], ARCS)
    yields = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 0, 1)], "sent_id long, idx int, leftmost int, rightmost int")
    assert columns.props_lines(words, yields, roles).first()["text"] == "-\t(A0*)\n_\t(B*)\n"


def test_facts_of_sentences(spark, tmp_path):
    c = made(spark, {1: "a b", 2: "c"})
    facts = spark.createDataFrame([(1, "a < b\nc", None, 0.5, "file & more"), (2, None, "note", None, None)], "sent_id long, text string, comment string, conf double, source string")
    (tmp_path / "a.xml").write_text("\n".join(r.text for r in other.xml_lines(c.tokens, c.deps, c.groups, facts).orderBy("sent_id").collect()))
    assert rows(other.read_xml_facts(spark, str(tmp_path / "a.xml"))) == {(1, "a < b c", None, 0.5, "file & more"), (2, None, "note", None, None)}
    assert texts(corpora.load(spark, str(tmp_path / "a.xml"))) == {1: "a b", 2: "c"}


def test_marks_go_round(spark):
    from treemill.operators import spans

    marks = spark.createDataFrame([(1, 0), (1, 4), (3, 2), (9, 1)], "sent_id long, idx int")
    found = rows(spans.next_marks(marks, F.col("sent_id") > 5))
    assert found == {(1, 0, 1, 4), (1, 4, 3, 2), (3, 2, 1, 0), (9, 1, 9, 1)}
