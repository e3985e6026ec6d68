"""Tree measures, sub-trees and projectivity against plain loops."""

import itertools
import random

import numpy as np
import pytest

from treemill.operators import forest, match, tree


def graphs(count, most=9, seed=1):
    rng = random.Random(seed)
    for _ in range(count):
        n = rng.randint(1, most)
        yield [rng.choice([-1, *range(n)]) for _ in range(n)]


def up(heads, i):
    """The ancestors of a word, nearest first; a cycle is gone round once."""
    found, at = [], heads[i]
    while at >= 0 and at not in found:
        found.append(at)
        at = heads[at]
    return found


def plain_measures(heads):
    for i in range(len(heads)):
        chain = up(heads, i)
        last = chain[-1] if chain else i
        free = heads[last] < 0
        below = [w for w in range(len(heads)) if w == i or i in up(heads, w)]
        yield len(chain) if free else -1, last if free else -1, min(below), max(below), len(below), i in chain


def test_measures_of_random_graphs():
    many = [*graphs(300), list(range(1, 70)) + [-1], [69, *range(69)], [-1]]
    starts = np.cumsum([0, *map(len, many)])[:-1]
    found = forest.measured(np.array([h for g in many for h in g]), starts)
    rows = list(zip(*(found[c].tolist() for c in ("depth", "root", "leftmost", "rightmost", "size", "cyclic")), strict=True))
    assert rows == [tuple(r) for g in many for r in plain_measures(g)]


def frame(spark, many):
    return spark.createDataFrame([(s, i, h, f"L{(s + i) % 3}", f"P{(s * i) % 2}") for s, g in enumerate(many) for i, h in enumerate(g)], "sent_id long, idx int, head int, label string, pos string")


def test_deep_trees_are_walked_to_the_root(spark):
    words = frame(spark, [list(range(1, 70)) + [-1]])
    assert tree.depths(words).where("idx = 0").first()["depth"] == 69
    assert {r.root for r in tree.root_of(words).collect()} == {69}
    assert len(tree.ancestors(words).where("idx = 0").first()["chain"]) == 69


def test_measures_of_arcs(spark, monkeypatch):
    monkeypatch.setattr(forest, "WORDS", 20)
    many = list(graphs(60, seed=2))
    words = frame(spark, many)
    deps = words.where("head >= 0").selectExpr("sent_id", "idx as gov", "head", "label")
    for found in (forest.measures(words), forest.measures(words.drop("head", "label"), deps)):
        got = {(r.sent_id, r.idx): (-1 if r.depth is None else r.depth, -1 if r.root is None else r.root, r.leftmost, r.rightmost, r["size"], r.cyclic) for r in found.collect()}
        assert got == {(s, i): r for s, g in enumerate(many) for i, r in enumerate(plain_measures(g))}
    chains = {(r.sent_id, r.idx): r.chain for r in tree.ancestors(words).collect()}
    assert chains == {(s, i): up(g, i) for s, g in enumerate(many) for i in range(len(g))}


def test_a_head_outside_the_sentence_is_none(spark):
    words = spark.createDataFrame([(1, 0, 5, "X", "A"), (1, 1, 0, "Y", "B")], "sent_id long, idx int, head int, label string, pos string")
    assert {(r.idx, r.depth, r.root) for r in forest.measures(words).collect()} == {(0, 0, 0), (1, 1, 0)}


def test_names_tell_trees_apart():
    heads, labels, tags = [1, -1, 1, 2], ["S", "", "O", "D"], ["N", "V", "N", "D"]
    swapped = forest.names_to(4, [2, 3, 3, -1], ["S", "O", "", ""], ["N", "N", "V", "V"])  # another shape
    one = forest.names_to(3, heads, labels, tags)
    assert one[0] == tags and one[1][1] == "V(O:N S:N)" and one[2][1] == "V(O:N(D:D) S:N)"
    # the same tree with its words in another order has the same name
    other = forest.names_to(3, [3, 0, 3, -1], ["O", "D", "S", ""], ["N", "D", "N", "V"])
    assert other[2][3] == one[2][1] and swapped[2][3] != one[2][1]


def test_subtrees_are_counted(spark):
    words = spark.createDataFrame([(s, i, h, x, p) for s in (1, 2) for i, (h, x, p) in enumerate([(1, "S", "N"), (-1, None, "V"), (1, "O", None)])], "sent_id long, idx int, head int, label string, pos string")
    found = {(r.k, r.tree): r.n for r in forest.frequent_subtrees(words, 2, 1).collect()}
    assert found == {(1, "N"): 2, (1, "V"): 2, (1, "_"): 2, (2, "N"): 2, (2, "V(O:_ S:N)"): 2, (2, "_"): 2}
    assert forest.frequent_subtrees(words, 2, 3).count() == 0


def included(target, labels, root, heads, own, word):
    """Inclusion by trying all permutations."""
    kids = [i for i, h in enumerate(target) if h == root]
    under = [i for i, h in enumerate(heads) if h == word]
    return any(all(labels[k] == own[c] and included(target, labels, k, heads, own, c) for k, c in zip(kids, chosen, strict=True)) for chosen in itertools.permutations(under, len(kids)))


def test_inclusion_equals_permutations(spark):
    rng = random.Random(3)
    trees = [[-1, *(rng.randrange(i) for i in range(1, n))] for n in (1, 2, 3, 3, 4, 4, 5, 7, 7, 8) for _ in range(6)]
    many = [(g, [rng.choice("ab") for _ in g]) for g in trees]
    hits = 0
    for target, labels in many[:36]:
        for heads, own in many:
            want = [w for w in range(len(heads)) if included(target, labels, 0, heads, own, w)]
            assert forest.places_of((target, labels), heads, own) == want
            hits += len(want)
    assert hits > 500
    words = spark.createDataFrame([(s, i, h, own[i]) for s, (g, own) in enumerate(many) for i, h in enumerate(g)], "sent_id long, idx int, head int, label string")
    for target, labels in many[12:18]:
        want = {(s, w) for s, (g, own) in enumerate(many) for w in range(len(g)) if included(target, labels, 0, g, own, w)}
        assert {tuple(r) for r in forest.including(words, target, labels).collect()} == want


def test_inclusion_in_a_cycle_ends():
    assert forest.places_of(([-1, 0], ["", "a"]), [1, 0], ["a", "a"]) == [0, 1]


def test_subtree_to_depth(spark):
    words = spark.createDataFrame([(1, i, h, f"w{i}") for i, h in enumerate([1, 3, 1, -1, 2])], "sent_id long, idx int, head int, form string")
    at = spark.createDataFrame([(1, 1), (1, 3)], "sent_id long, idx int")
    found = {(r.top, r.idx, r.head, r.form) for r in forest.subtree(words, at, 2).collect()}
    assert found == {(1, 0, 1, "w0"), (1, 1, -1, "w1"), (1, 2, 1, "w2"), (3, 0, 1, "w1"), (3, 1, -1, "w3")}


def crossing(heads):
    for i, h in enumerate(heads):
        if h >= 0:
            low, high = min(i, h), max(i, h)
            for j in range(low + 1, high):
                if heads[j] < low or heads[j] > high:
                    yield i


def plain_repair(heads):
    heads, changed = list(heads), True
    while changed:
        changed = False
        for i in range(len(heads)):
            if heads[i] >= 0 and (i in set(crossing(heads)) or heads[heads[i]] == i):
                heads[i] = -1
                changed = True
    return heads


@pytest.mark.parametrize("seed", [4, 5])
def test_repair_leaves_no_crossing(spark, seed):
    many = [*graphs(150, 12, seed), [1, 0], [1, 0, 3, 2], [0]]
    for g in many:
        got = forest.repaired(g)
        assert got == plain_repair(g) and not list(crossing(got)) and not any(h >= 0 and got[h] == i for i, h in enumerate(got))
    found = {(r.sent_id, r.idx): r.head for r in forest.projective(frame(spark, many)).collect()}
    assert found == {(s, i): h for s, g in enumerate(many) for i, h in enumerate(plain_repair(g))}


def test_projective_graphs_stay(spark):
    heads = [1, -1, 1, 2, 2]
    assert forest.repaired(heads) == heads
    assert match.first_arcs(frame(spark, [heads])).count() == 5


def test_similarity_branches_and_groups(spark):
    heads, labels = [1, 3, 1, -1, 3, 4], ["D", "S", "M", None, "O", "D"]
    words = spark.createDataFrame([(1, i, f"w{i}", h, x) for i, (h, x) in enumerate(zip(heads, labels, strict=True))], "sent_id long, idx int, form string, head int, label string")
    found = {r.idx: (r.parents, r.children, r.distance) for r in forest.similar(words, ["M", "S"], ["D", "M", "D"]).collect()}
    assert found == {0: (0, 0, 0), 1: (0, 2, -2), 2: (2, 0, -2), 3: (0, 0, 0), 4: (0, 1, -1), 5: (0, 0, 0)}
    at = spark.createDataFrame([(1, 2), (1, 5), (1, 3)], "sent_id long, idx int")
    got = {(r.top, r.form) for r in tree.branches(words, at).collect()}
    assert got == {(1, "w0"), (1, "w1"), (1, "w2"), (4, "w4"), (4, "w5")} | {(3, f"w{i}") for i in range(6)}
    groups = spark.createDataFrame([(1, "A", 1, 3), (1, "B", 0, 2)], "sent_id long, name string, first_idx int, last_idx int")
    assert [tuple(r) for r in tree.sub_groups(groups, 1, 4).collect()] == [(1, "A", 0, 2)]
