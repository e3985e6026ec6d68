"""The oracle gives trees back, and the model learns."""

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from treemill.operators import forest, transitions
from treemill.operators.transitions import ACTIONS, WEIGHTS, Automaton, oracle, replayed
from treemill.sources.adapter import Treebank, annotated_rows, tokens


def projective(rng, low, high, parent):
    """A random projective forest over [low, high) hung on ``parent``."""
    heads = {}
    while low < high:
        end = rng.randint(low + 1, high)
        top = rng.randrange(low, end)
        heads[top] = parent
        heads |= projective(rng, low, top, top) | projective(rng, top + 1, end, top)
        low = end
    return heads


def test_oracle_gives_back_projective_trees():
    rng = random.Random(1)
    for _ in range(500):
        n = rng.randint(0, 14)
        found = projective(rng, 0, n, -1)
        heads = [found[i] for i in range(n)]
        actions = oracle(heads)
        assert replayed(actions, n) == heads and len(actions) <= 2 * n
    assert oracle([1, -1, 1]) == ["SHIFT", "LA", "SHIFT", "RA"]


def test_roots_under_arcs_and_long_sentences():
    assert replayed(oracle([2, -1, -1]), 3) == [2, -1, -1]
    heads = [-1, *range(4999)]
    assert replayed(oracle(heads), 5000) == heads


def test_other_graphs_end():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 9)
        heads = [rng.choice([-1, *range(n)]) for _ in range(n)]
        got = replayed(oracle(heads), n)
        assert all(g in (h, -1) for g, h in zip(got, heads, strict=True))


def test_impossible_actions_shift():
    assert replayed(["LA", "REDUCE", "RA", "RA"], 3) == [-1, -1, 1]
    state = Automaton(2)
    for action in ("LA", "REDUCE", "REDUCE", "RA"):
        state.act(action)
    assert state.heads == [-1, -1] and state.at == 2
    # a word that has a head can't get another
    assert replayed(["SHIFT", "RA", "LA"], 3) == [-1, 0, -1]


def test_replays_of_the_treebank(spark):
    tb = Treebank(spark, "/root/testdata/sf0.001")
    words = tb.linked.drop("head").join(forest.projective(tb.linked), ["sent_id", "idx"])
    found = transitions.replays(words)
    assert found.where("head <> again").count() == 0 and found.where("head >= 0").count() > 40_000
    tb.release()


def test_model_learns_a_rule(spark):
    rng = random.Random(3)
    rows = []
    for s in range(300):
        tags = [rng.choice("DNV") for _ in range(rng.randint(2, 8))]
        for i, t in enumerate(tags):
            after = next((j for j in range(i + 1, len(tags)) if tags[j] == "N"), -1) if t == "D" else -1
            rows.append((s, i, f"w{rng.randint(0, 5)}", t, after))
    words = spark.createDataFrame(rows, "sent_id long, idx int, form string, pos string, head int")
    words = words.drop("head").join(forest.projective(words), ["sent_id", "idx"])
    weights = transitions.trained(words.where("sent_id < 200"), 3)
    test = words.where("sent_id >= 200")
    both = transitions.parsed(test.drop("head"), weights).join(test.withColumnRenamed("head", "gold"), ["sent_id", "idx"])
    right = both.agg(F.avg((F.col("head") == F.col("gold")).cast("double"))).first()[0]
    assert right > 0.93
    assert transitions.parsed(test, weights).count() == test.count()
    assert transitions.trained(words.limit(0)).any() == False  # noqa: E712


def features(state, forms, tags):
    """What stands on the stack and before it, one state at a time."""
    found = ["bias"]
    if state.stack:
        top = state.stack[-1]
        found += [f"sw {forms[top]}", f"sp {tags[top]}", f"sh {state.heads[top] >= 0} {tags[top]}"]
        if len(state.stack) > 1:
            found.append(f"s1 {tags[state.stack[-2]]}")
        found.append(f"si {tags[top]} {tags[state.at]} {min(state.at - top, 4)}")
    found += [f"iw {forms[state.at]}", f"ip {tags[state.at]}"]
    if state.at + 1 < state.size:
        found += [f"i1 {tags[state.at + 1]}", f"i2 {tags[state.at]} {tags[state.at + 1]}"]
    return [zlib.crc32(f.encode()) % WEIGHTS for f in found]


def best(weights, state, at):
    sums = weights[at].sum(axis=0)
    return max((a for a in range(4) if state.possible(ACTIONS[a])), key=lambda a: (sums[a], -a))


def plainly_improved(weights, trees):
    own, total, steps = weights.astype(np.float64), np.zeros_like(weights, np.float64), 1
    for heads, forms, tags in trees:
        state = Automaton(len(heads))
        for action in oracle(heads):
            at, right = features(state, forms, tags), ACTIONS.index(action)
            got = best(own, state, at)
            if got != right:
                for row in at:
                    own[row, right] += 1
                    own[row, got] -= 1
                    total[row, right] += steps
                    total[row, got] -= steps
            steps += 1
            state.act(action)
    return own - total / steps, steps - 1


def test_batches_learn_and_parse_like_a_plain_loop():
    rng = random.Random(4)
    trees = []
    for k in range(300):
        n = rng.choice([0, 1, 2, 3, 9, 25])
        heads = [rng.randint(-2, n + 1) for _ in range(n)] if k % 3 else [h for _, h in sorted(projective(rng, 0, n, -1).items())]
        trees.append((heads, [rng.choice("abcdefgh") * 2 for _ in range(n)], [rng.choice(["D", "N N", "V", "_"]) for _ in range(n)]))

    def whole(some):
        sizes = np.array([len(h) for h, _, _ in some], np.int64)
        null = lambda c: [None if v == "_" else v for v in c]
        return np.cumsum(sizes) - sizes, sizes, pa.array([x for h, _, _ in some for x in h], pa.int32()), *[pa.array(null([x for t in some for x in t[k]]), pa.string()) for k in (1, 2)]

    weights = np.zeros((WEIGHTS, 4))
    for _ in range(3):
        # one state at a time, and all batches with stretches of states tried ahead
        wanted, n = plainly_improved(weights, trees)
        got, m = transitions.improved(weights, (transitions.states_of(*whole(some)) for some in (trees[:1], trees[1:50], [], trees[50:])))
        assert n == m and (got == wanted).all() and wanted.any()
        weights = wanted.astype(np.float32)
    starts, sizes, _, forms, tags = whole(trees)
    found = transitions.found_heads(weights, starts, sizes, forms, tags).tolist()
    for heads, words, kinds in trees:
        state = Automaton(len(heads))
        while state.at < state.size:
            state.act(ACTIONS[best(weights, state, features(state, words, kinds))])
        assert state.heads == found[: len(heads)]
        found = found[len(heads) :]


def test_rows_of_sentences_are_learned_like_words(spark):
    words = [(1, 0, "a", "D", 1), (1, 1, "b", "N", -1), (2, 0, "b", None, -1), (2, 1, None, "N", 0), (2, 2, "c", "V", None)]
    words = spark.createDataFrame(words, "sent_id long, idx int, form string, pos string, head int").coalesce(1)
    rows = forest.sentences(words, "head", "form", "pos").coalesce(1).orderBy("sent_id").coalesce(1)
    weights = transitions.trained(rows)
    assert weights.any()
    found = transitions.compared(rows, weights)
    assert found.columns == ["sent_id", "idx", "pos", "head", "found"]
    assert [tuple(r)[:4] for r in found.orderBy("sent_id", "idx").collect()] == [(s, i, p, h) for s, i, _, p, h in words.orderBy("sent_id", "idx").collect()]
    assert transitions.parsed(words, weights).exceptAll(found.select("sent_id", "idx", F.col("found").alias("head"))).count() == 0
    assert transitions.parsed(words.drop("head"), weights).count() == 5
    # rows that don't leave their task
    assert (transitions.trained(rows.mapInArrow) == weights).all() and transitions.compared(rows.mapInArrow, weights).exceptAll(found).count() == 0


def test_words_end_with_their_last_character_that_is_no_mark(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice('ab.,!?":; \n\té😀') for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["." * 3000, "a" * 50_000 + "!?", '"a".b."', "  . "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = annotated_rows(docs, "forms").select("sent_id", F.posexplode("forms").alias("idx", "form"))
    wanted = tokens(docs).select("sent_id", "idx", "form")
    assert rows.count() == wanted.count() and rows.exceptAll(wanted).count() == 0
