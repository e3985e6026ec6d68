"""Role columns, CoNLL-08 lines and brackets on small invented sentences."""

from treemill.sources import columns, conll, other

PROPS = "-\t(A0*\t*\n-\t*)\t*\nsaw\t(V*)\t*\n-\t(A1*\t(A0*)\ngone\t*)\t(V*)\n"


def words(spark, tagged):
    return spark.createDataFrame([(1, i, w, w, p) for i, (w, p) in enumerate(tagged)], "sent_id long, idx int, form string, lemma string, pos string")


def test_props_reader(spark, tmp_path):
    (tmp_path / "a").write_text(PROPS + "\n-\t((B*)\t*\n\n" + "go (V*)\n- (A1*)\n")
    groups, roles = columns.read_props(spark, str(tmp_path / "a"))
    assert {tuple(r) for r in groups.where("sent_id <> 1").collect()} == {(0, "A0_0", 0, 1), (0, "A1_0", 3, 4), (0, "A0_1", 3, 3), (2, "A1_0", 1, 1)}
    assert {tuple(r) for r in roles.where("sent_id <> 1").collect()} == {(0, 0, 2, "A0"), (0, 3, 2, "A1"), (0, 3, 4, "A0"), (2, 1, 0, "A1")}


def test_props_lines(spark):
    toks = words(spark, [("the", "DT"), ("cat", "NN"), ("saw", "VB"), ("in", "IN"), ("mud", "NN")])
    yields = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 0, 1), (1, 2, 0, 4), (1, 3, 3, 3), (1, 4, 4, 4)], "sent_id long, idx int, leftmost int, rightmost int")
    roles = spark.createDataFrame([(1, 1, 2, "A0"), (1, 4, 2, "AM"), (1, 2, 1, "X")], "sent_id long, gov int, head int, label string")
    text = columns.props_lines(toks, yields, roles).first()["text"]
    assert text == "-\t(X*)\t(A0*\ncat\t(N*)\t*)\nsaw\t(X*\t(V*)\n-\t*\t(AM*\n-\t*)\t*)\n"


def test_lines08_round_trip(spark, tmp_path):
    toks = words(spark, [("She", "PRP"), ("saw", "VB"), ("gone", "VB")])
    deps = spark.createDataFrame([(1, 0, 1, "SBJ"), (1, 2, 1, "OBJ")], "sent_id long, gov int, head int, label string")
    roles = spark.createDataFrame([(1, 0, 1, "A0"), (1, 1, 2, "A1")], "sent_id long, gov int, head int, label string")
    text = columns.lines08(toks, deps, roles).first()["text"]
    assert text.split("\n")[1].split("\t")[8:] == ["0", "ROOT", "saw.0", "_", "A1"]
    (tmp_path / "a").write_text(text)
    toks2, deps2, roles2 = conll.read(spark, str(tmp_path / "a"), "08")
    assert {tuple(r)[1:] for r in deps2.collect()} == {(0, 1, "SBJ"), (2, 1, "OBJ")}
    assert {tuple(r)[1:] for r in roles2.collect()} == {(0, 1, "A0"), (1, 2, "A1")}
    assert {(r.idx, r.sense) for r in toks2.where("sense is not null").collect()} == {(1, "saw.0"), (2, "gone.1")}


def test_bracket_lines(spark, tmp_path):
    toks = words(spark, [("The", "DT"), ("(cat)", "NN"), ("sat", "VB")])
    groups = spark.createDataFrame([(1, "NP", 0, 1), (1, "ALL", 0, 2)], "sent_id long, name string, first_idx int, last_idx int")
    text = columns.bracket_lines(toks, groups).first()["text"]
    assert text == "( (S\n(ALL (NP (DT The)\n(NN -cat-))\n(VB sat))\n))\n"
    (tmp_path / "a.mrg").write_text(text)
    assert [r.form for r in other.brackets(spark, str(tmp_path / "a.mrg")).orderBy("idx").collect()] == ["The", "-cat-", "sat"]
