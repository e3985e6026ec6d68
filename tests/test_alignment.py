"""Alignment with substitutions against a whole table, and two segmentations against all pairs."""

import random
import re

from treemill.operators import align, segments
from treemill.plans import catalog
from treemill.sources.adapter import Treebank, tokens

WORDS = "sent_id long, idx int, form string, pos string"


def table(a, b):
    """The same path by a whole table of costs."""
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j - 1] + (a[i - 1] != b[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    return d[-1][-1]


def test_paths_are_cheapest():
    rng = random.Random(1)
    for n in range(400):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 12 + n // 20))]
        b = [x for x in a if rng.random() > 0.2] if n % 2 else [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        for at in range(len(b)):
            if rng.random() < 0.1:
                b[at] = "z"
        path = align.edit_path(a, b)
        assert sum(code != align.SAME for code, _, _ in path) == table(a, b)
        assert [i for _, i, _ in path if i is not None] == list(range(len(a))) and [j for _, _, j in path if j is not None] == list(range(len(b)))
        for code, i, j in path:
            assert {align.SAME: i is not None and j is not None and a[i] == b[j], align.OTHER: i is not None and j is not None and a[i] != b[j], align.LEFT: j is None, align.RIGHT: i is None}[code] if code in range(4) else False


def made(spark, sentences):
    return spark.createDataFrame([(s, i, w, f"T{w}") for s, words in enumerate(sentences) for i, w in enumerate(words.split())], WORDS)


def test_codes_errors_and_tags(spark):
    left, right = made(spark, ["a b c d e", "x y", "same same"]), made(spark, ["a c d f", "x y z", "same same"])
    aligned = align.alignment(left, right)
    assert {r.sent_id: tuple(r)[1:] for r in align.edit_counts(aligned).collect()} == {0: (3, 1, 1, 0), 1: (2, 0, 0, 1), 2: (2, 0, 0, 0)}
    codes = [(r.code, r.idx_a, r.idx_b) for r in aligned.where("sent_id = 0").orderBy("place").collect()]
    assert codes == [(0, 0, 0), (1, 1, None), (0, 2, 1), (0, 3, 2), (3, 4, 3)]
    wrong = {(r.code, r.form_a, r.form_b): r.n for r in align.errors(aligned, left, right).collect()}
    assert wrong == {(1, "b", None): 1, (3, "e", "f"): 1, (2, None, "z"): 1}
    tags = {(r.sent_id, r.idx): r.pos for r in align.project_tags(aligned, left, right).collect()}
    assert tags == {(0, 0): "Ta", (0, 1): "Tc", (0, 2): "Td", (0, 3): "Te", (1, 0): "Tx", (1, 1): "Ty", (1, 2): None, (2, 0): "Tsame", (2, 1): "Tsame"}
    assert align.links(left, right).where("sent_id = 0").count() == 3 and align.links(left, right, others=True).where("sent_id = 0").count() == 4


def test_groups_are_projected(spark):
    left, right = made(spark, ["the big cat sat"]), made(spark, ["the cat sat down"])
    groups = spark.createDataFrame([(0, "NP", 0, 2), (0, "gone", 1, 1)], "sent_id long, name string, first_idx int, last_idx int")
    assert [tuple(r) for r in align.project_groups(groups, align.links(left, right)).collect()] == [(0, "NP", 0, 1)]


def test_offsets_give_back_the_words(spark):
    texts = ["  One two, three!  l’ami\taujourd'hui... x\n\né𝒳 end?", "", " \n", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = {(r.sent_id, r.idx, r.form, r.pos) for r in tokens(docs).collect()}
    placed = tokens(docs, offsets=True).collect()
    assert {(r.sent_id, r.idx, r.form, r.pos) for r in placed} == plain and len(placed) == len(plain) > 10
    assert all(texts[r.doc][r.begin : r.end] == r.form for r in placed)


def intervals(spark, docs, seed):
    rng, rows = random.Random(seed), []
    for doc in range(docs):
        at = 0
        for n in range(rng.randint(0, 40)):
            at += rng.randint(0, 3)
            end = at + rng.choice([0, 1, 2, 5, 90])
            rows.append((doc, doc * 100 + n // 7, n % 7, n, at, end))
            at = end
    return rows, spark.createDataFrame(rows, "doc long, sent_id long, idx int, n int, begin int, end int")


def test_overlaps_and_segments_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(segments, "CELL", 8)
    (rows_a, a), (rows_b, b) = intervals(spark, 20, 1), intervals(spark, 20, 2)
    want = {(x[0], x[3], y[3], min(x[5], y[5]) - max(x[4], y[4])) for x in rows_a for y in rows_b if x[0] == y[0] and min(x[5], y[5]) > max(x[4], y[4])}
    found = segments.overlaps(a, b).collect()
    assert {(r.doc, r.n_a, r.n_b, r.shared) for r in found} == want and len(found) == len(want)
    sent = {(x[0], x[3]): x[1] for x in rows_a}
    linked = {}
    for doc, n_a, n_b, _ in want:
        linked.setdefault(sent[doc, n_a], set()).add(n_b)
    segs = {}
    for r in segments.resegmented(a, b.select("doc", "n", "begin", "end")).collect():
        segs.setdefault(r.sent_id, []).append((r.idx, r.n))
    assert {s: sorted(v) for s, v in segs.items()} == {s: [(k, n) for k, n in enumerate(range(min(v), max(v) + 1))] for s, v in linked.items()}


def test_arcs_on_the_second_segmentation(spark):
    a = spark.createDataFrame([(0, 0, 0, 0, 3), (0, 0, 1, 3, 8), (0, 0, 2, 9, 12)], "doc long, sent_id long, idx int, begin int, end int")
    b = spark.createDataFrame([(0, 0, 0, 4, "l'am"), (0, 1, 4, 8, "i de"), (0, 2, 8, 9, " "), (0, 3, 9, 12, "pas")], "doc long, n int, begin int, end int, form string")
    deps = spark.createDataFrame([(0, 0, 1, "D"), (0, 2, 0, "O"), (0, 1, 2, "S")], "sent_id long, gov int, head int, label string")
    assert {tuple(r) for r in segments.carried_arcs(deps, a, b).collect()} == {(0, 0, 1, "D"), (0, 3, 0, "O"), (0, 1, 3, "S")}


def test_second_segmentation_of_documents(spark):
    tb = Treebank(spark, "/root/testdata/sf0.001")
    first, second = catalog._two(tb)
    texts = {r.doc_id: r.text.replace("’", "'") for r in tb.docs.collect()}
    words = second.collect()
    assert all(texts[r.doc][r.begin : r.end] == r.form for r in words)
    pattern = re.compile(r"""aujourd'hui|[^ \t\n\r,;:.?!"']*'|[^ \t\n\r,;:.?!"']+|[,;:.?!"]""")
    assert len(words) == sum(len(pattern.findall(t)) for t in texts.values())
    tb.release()
