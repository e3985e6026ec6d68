"""Sequential rewriting against a plain loop over the words of each sentence."""

import random

import pytest

from treemill.operators import match, rewrite
from treemill.operators.sequential import Rule, rewritten

SCHEMA = "sent_id long, idx int, form string, lemma string, pos string, head int, label string"


def made(spark, sentences):
    rows = [(s, i, w, w, p, h, x) for s, words in enumerate(sentences) for i, (w, p, h, x) in enumerate(words)]
    return spark.createDataFrame(rows, SCHEMA)


def randoms(seed, count=40):
    rng = random.Random(seed)
    for _ in range(count):
        n = rng.randint(1, 8)
        yield [(rng.choice("xyz"), rng.choice("ABC"), h := rng.choice([-1, *range(n)]), rng.choice(["S", "O", "_P"]) if h >= 0 else None) for _ in range(n)]


def plain(words, rules):
    """The same program as functions: when(w0), other(w0, w1) or None, act(state, w0, w1)."""
    heads, labels = [w[2] for w in words], [w[3] for w in words]
    for when, other, act in rules:
        for i in range(len(words)):
            look = lambda k: {"idx": k, "form": words[k][0], "pos": words[k][1], "head": heads[k], "label": labels[k], "head_pos": words[heads[k]][1] if heads[k] >= 0 else None}
            w0 = look(i)
            if not when(w0):
                continue
            w1 = None
            if other:
                w1 = next((look(j) for j in range(len(words)) if j != i and other(w0, look(j))), None)
                if w1 is None:
                    continue

            def put(k, head, label):
                if not (labels[k] or "").startswith("_"):
                    heads[k], labels[k] = head, label

            act(put, w0, w1)
    return list(zip(heads, labels, strict=True))


PROGRAMS = {
    "attach": ([Rule("w0.pos = 'A'", "w1.pos = 'B' and w1.idx > w0.idx", attach=(("w0.idx", "w1.idx", "'N'"),))],
               [(lambda a: a["pos"] == "A", lambda a, b: b["pos"] == "B" and b["idx"] > a["idx"], lambda put, a, b: put(a["idx"], b["idx"], "N"))]),
    "inherit": ([Rule("w0.head < 0", "w1.idx = w0.idx - 1 and w1.head >= 0 and w1.head <> w0.idx", attach=(("w0.idx", "w1.head", "w1.label"),))],
                [(lambda a: a["head"] < 0, lambda a, b: b["idx"] == a["idx"] - 1 and b["head"] >= 0 and b["head"] != a["idx"], lambda put, a, b: put(a["idx"], b["head"], b["label"]))]),
    "drop and lift": ([Rule("w0.label = 'S' and w0.head_pos = 'A'", drop=("w0",)), Rule("w0.head >= 0", "w1.idx = w0.head and w1.head >= 0 and w1.head <> w0.idx", attach=(("w0.idx", "w1.head", "w0.label"),))],
                      [(lambda a: a["label"] == "S" and a["head_pos"] == "A", None, lambda put, a, b: put(a["idx"], -1, None)),
                       (lambda a: a["head"] >= 0, lambda a, b: b["idx"] == a["head"] and b["head"] >= 0 and b["head"] != a["idx"], lambda put, a, b: put(a["idx"], b["head"], a["label"]))]),
    "two actions": ([Rule("w0.form = 'x'", "w1.form = 'y'", drop=("w1",), attach=(("w1.idx", "w0.idx", "'T'"), ("w0.idx", "w0.idx - 5", "'never'")))],
                    [(lambda a: a["form"] == "x", lambda a, b: b["form"] == "y", lambda put, a, b: (put(b["idx"], -1, None), put(b["idx"], a["idx"], "T"), put(a["idx"], a["idx"] - 5, "never") if a["idx"] - 5 >= 0 else None))]),
}


@pytest.mark.parametrize("name", PROGRAMS)
def test_programs_equal_a_plain_loop(spark, name):
    ours, theirs = PROGRAMS[name]
    sentences = list(randoms(len(name)))
    found = {(r.sent_id, r.idx): (r.head, r.label) for r in rewritten(made(spark, sentences), ours).collect()}
    assert found == {(s, i): r for s, words in enumerate(sentences) for i, r in enumerate(plain(words, theirs))}


def test_a_later_match_sees_an_earlier_rewrite(spark):
    sentence = [("x", "A", 1, "S"), ("y", "B", -1, None), ("z", "C", -1, None), ("z", "C", -1, None)]
    words = made(spark, [sentence])
    found = {r.idx: r.head for r in rewritten(words, PROGRAMS["inherit"][0]).collect()}
    assert found == {0: 1, 1: -1, 2: -1, 3: -1}
    words = made(spark, [[("x", "A", 3, "S"), *sentence[1:]]])
    found = {r.idx: r.head for r in rewritten(words, PROGRAMS["inherit"][0]).collect()}
    assert found == {0: 3, 1: 3, 2: 3, 3: -1}
    # the snapshot sees the first arcs only
    pairs = match.search(words.select("sent_id", "idx", "form", "lemma", "pos", "head", "label"), [match.Triplet("head < 0"), match.Triplet("head >= 0")], "dep1 = dep0 - 1 and head1 <> dep0")
    deps = words.where("head >= 0").selectExpr("sent_id", "idx as gov", "head", "label")
    assert {r.gov for r in rewrite.add_arcs(deps, pairs, "dep0", "head1", "rel1", copy=True).collect()} == {0, 1}


def test_the_second_rule_needs_the_first_ones_arc(spark):
    words = made(spark, [[("x", "A", -1, None), ("y", "B", -1, None), ("z", "C", -1, None)]])
    first = Rule("w0.pos = 'A'", "w1.pos = 'B'", attach=(("w0.idx", "w1.idx", "'N'"),))
    second = Rule("w0.pos = 'C'", "w1.label = 'N'", attach=(("w0.idx", "w1.head", "'M'"),))
    heads = lambda program: [r.head for r in rewritten(words, program).orderBy("idx").collect()]
    assert heads([first, second]) == [1, -1, 1] and heads([second, first]) == [1, -1, -1]


def test_arcs_beside_words(spark):
    tokens = spark.createDataFrame([(1, 0, "a", "a", "A"), (1, 1, "b", "b", None), (2, 0, "c", None, "C")], "sent_id long, idx int, form string, lemma string, pos string")
    deps = spark.createDataFrame([(1, 0, 1, "X"), (2, 0, 7, "Y")], "sent_id long, gov int, head int, label string")
    assert {tuple(r) for r in rewritten(tokens, [], deps).collect()} == {(1, 0, 1, "X"), (1, 1, -1, None), (2, 0, -1, None)}
