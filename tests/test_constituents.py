"""Nested constituents from XML."""

from treemill.sources import columns, other
from treemill.sources.constituents import read_constituents

FILE = """<?xml version="1.0" encoding="UTF-8"?>
<text>
<SENT nb="1"> <NP fct="SUJ"><w cat="D" lemma="le">La</w> <w cat="N" lemma="pomme">pomme</w>
<PP><w compound="yes" cat="P" lemma="de terre"><w catint="P">de</w><w catint="">terre</w></w><NP><w cat="D"></w></NP></PP></NP><!-- <NP> -->
<VN><w cat="V" lemma="cuire">a cuit</w></VN><w cat="PONCT" lemma="&quot;">&quot;</w> <x/>
</SENT>
<SENT nb="2"><NP><NP><w cat="N">Fin</w></NP><AP><w cat="A">dure</w></AP></NP></SENT>
<SENT nb="3"></SENT>
</text>
"""


def test_words_and_spans(spark, tmp_path):
    (tmp_path / "a.xml").write_text(FILE)
    words, groups = read_constituents(spark, str(tmp_path / "a.xml"))
    rows = [tuple(r) for r in words.orderBy("sent_id", "idx").collect()]
    assert rows == [(0, 0, "La", "le", "D"), (0, 1, "pomme", "pomme", "N"), (0, 2, "de", "de", "P"), (0, 3, "terre", "terre", "P"), (0, 4, "a_cuit", "cuire", "V"), (0, 5, '"', '"', "PONCT"), (1, 0, "Fin", "Fin", "N"), (1, 1, "dure", "dure", "A")]
    assert {tuple(r) for r in groups.collect()} == {(0, "NP", 0, 3), (0, "PP", 2, 3), (0, "VN", 4, 4), (1, "NP", 0, 1), (1, "NP", 0, 0), (1, "AP", 1, 1)}


def test_many_files_and_splits(spark, tmp_path):
    for name in "ba":
        (tmp_path / name).write_text("<c>" + "".join(f'<SENT nb="{i}"><NP><w cat="N">{name}{i}</w></NP></SENT>\n' for i in range(200)) + "</c>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        words, groups = read_constituents(spark, str(tmp_path))
        rows = words.orderBy("sent_id").collect()
        assert [r.form for r in rows] == [f"{n}{i}" for n in "ab" for i in range(200)] and [r.sent_id for r in rows] == list(range(400))
        assert groups.count() == 400
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_round_trip_through_brackets(spark, tmp_path):
    (tmp_path / "a.xml").write_text(FILE)
    words, groups = read_constituents(spark, str(tmp_path / "a.xml"))
    text = {r.sent_id: r.text for r in columns.bracket_lines(words, groups).collect()}
    assert text[1] == "( (S\n(NP (NP (N Fin))\n(AP (A dure)))\n))\n"
    (tmp_path / "b.mrg").write_text(text[0] + text[1])
    again = other.brackets(spark, str(tmp_path / "b.mrg")).orderBy("sent_id", "idx").collect()
    assert [(r.sent_id, r.idx, r.form, r.pos) for r in again] == [(r.sent_id, r.idx, r.form, r.pos) for r in words.orderBy("sent_id", "idx").collect()]


def test_other_encoding(spark, tmp_path):
    (tmp_path / "a.xml").write_bytes('<SENT nb="1"><w cat="N">été</w></SENT>'.encode("latin-1"))
    assert read_constituents(spark, str(tmp_path / "a.xml"), "ISO-8859-1")[0].first()["form"] == "été"
