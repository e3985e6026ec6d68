"""Rules from word to word against a plain loop."""

import random

from treemill.operators import rules as single
from treemill.operators import wordrules
from treemill.operators.wordrules import WordRule

SCHEMA = "sent_id long, idx int, form string, lemma string, pos string, head int, label string"


def randoms(count, seed):
    rng = random.Random(seed)
    return [[("w", rng.choice(["A", "B", "C", None]), rng.choice([-1, *range(n)]), rng.choice("xyz")) for _ in range(n)] for n in (rng.randint(1, 9) for _ in range(count))]


def made(spark, sentences):
    return spark.createDataFrame([(s, i, f, f, p, h, x if h >= 0 else "ROOT") for s, words in enumerate(sentences) for i, (f, p, h, x) in enumerate(words)], SCHEMA)


def plain(words, when, place, halt, found, of_head):
    """(gov, head) of one rule; tests are functions of (words, place of the word)."""
    for i in range(len(words)):
        if not when(words, i):
            continue
        way = range(i + 1, len(words)) if place == "after" else range(i - 1, -1, -1) if place == "before" else [i + place] if 0 <= i + place < len(words) else []
        y = next((j for j in way if halt(words, j)), None)
        if y is None or not found(words, y):
            continue
        if of_head is None:
            yield i, y
        elif words[i][2] >= 0 and of_head(words, words[i][2]) and words[i][2] != y:
            yield words[i][2], y


def sons(words, i):
    return [w[3] for w in words if w[2] == i]


CASES = [
    (WordRule("a", "pos = 'A'", "after", "L", "pos = 'B'"), (lambda w, i: w[i][1] == "A", "after", lambda w, j: w[j][1] == "B", lambda w, j: True, None)),
    (WordRule("b", "head < 0", "before", "L", "pos <> 'C'", "head >= 0"), (lambda w, i: w[i][2] < 0, "before", lambda w, j: w[j][1] in ("A", "B"), lambda w, j: w[j][2] >= 0, None)),
    (WordRule("c", "true", 2, "L", "not array_contains(sons, 'x')"), (lambda w, i: True, 2, lambda w, j: "x" not in sons(w, j), lambda w, j: True, None)),
    (WordRule("d", "label = 'y'", -1, "L", found="pos = 'A'"), (lambda w, i: w[i][2] >= 0 and w[i][3] == "y", -1, lambda w, j: True, lambda w, j: w[j][1] == "A", None)),
    (WordRule("e", "pos = 'A'", "after", "M", "array_contains(sons, 'z')", of_head="head < 0"), (lambda w, i: w[i][1] == "A", "after", lambda w, j: "z" in sons(w, j), lambda w, j: True, lambda w, z: w[z][2] < 0)),
    (WordRule("f", "idx = 1", "before", "M", of_head="pos = 'B'"), (lambda w, i: i == 1, "before", lambda w, j: True, lambda w, j: True, lambda w, z: w[z][1] == "B")),
]


def test_rules_equal_a_plain_loop(spark):
    sentences = randoms(150, 1)
    found = wordrules.candidates(made(spark, sentences), [r for r, _ in CASES])
    got = {(r.rule, r.sent_id, r.gov, r["head"], r.label) for r in found.collect()}
    want = {(rule.name, s, gov, head, rule.label) for rule, case in CASES for s, words in enumerate(sentences) for gov, head in plain(words, *case)}
    assert got == want and {r for r, *_ in want} == set("abcdef")


def test_many_rules_cost_one_exchange(spark):
    words = made(spark, randoms(5, 2))
    found = wordrules.candidates(words, [WordRule(f"r{n}", f"pos = '{'ABC'[n % 3]}'", ("after", "before", n - 5)[n % 3], "L", "pos = 'B'", "head >= 0") for n in range(10)])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Scan") == 1


def test_candidates_are_applied(spark):
    words = made(spark, [[("w", "A", 2, "x"), ("w", "B", -1, "x"), ("w", "C", 1, "y")]])
    new = wordrules.candidates(words, [WordRule("r", "pos = 'A'", "after", "N", "pos = 'B'")]).drop("rule")
    deps = words.where("head >= 0").selectExpr("sent_id", "idx as gov", "head", "label")
    assert {(r.gov, r["head"], r.label) for r in single.applied(deps, new, replace=True).collect()} == {(0, 1, "N"), (2, 1, "y")}
