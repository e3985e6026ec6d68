"""Running sums, score statistics, posteriors and frames against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from treemill.operators import frames, running, stats


@pytest.mark.parametrize("ranges", [1, 4, 16])
def test_sums_before(spark, ranges):
    rng = random.Random(ranges)
    rows = [(rng.choice("ab") if i % 7 else None, i * 3 - 50, rng.randint(-5, 5)) for i in range(200)]
    rng.shuffle(rows)
    found = running.summed_before(spark.createDataFrame(rows, "k string, o long, v int"), "o", ["k"], ranges, s=F.col("v"), n=F.lit(1)).collect()
    assert {(r.k, r.o): (r.s, r.n) for r in found} == {(k, o): (sum(v2 for k2, o2, v2 in rows if k2 == k and o2 < o), sum(k2 == k and o2 < o for k2, o2, _ in rows)) for k, o, _ in rows}


def test_equal_error_rate(spark):
    rng = random.Random(2)
    rows = [(round(rng.gauss(1 if good else 0, 1), 2), good) for good in (rng.random() < 0.4 for _ in range(500))]
    points = {}
    for s in {s for s, _ in rows}:
        goods, bads = sum(g for _, g in rows), sum(not g for _, g in rows)
        points[s] = (sum(not g for x, g in rows if x >= s) / bads, sum(g for x, g in rows if x < s) / goods)
    df = spark.createDataFrame(rows, "score double, truth boolean")
    found = stats.operating_points(df)
    assert {r.score: (pytest.approx(r.false_accept), pytest.approx(r.false_reject)) for r in found.collect()} == points
    s = min(s for s, (fa, fr) in points.items() if fr >= fa)
    row = stats.equal_error_rate(found).first()
    assert row.score == s and row.eer == pytest.approx(sum(points[s]) / 2)
    assert stats.equal_error_rate(stats.operating_points(df.limit(0))).count() == 0


def test_f_interval(spark):
    row = spark.range(1).select(*stats.f_interval(F.lit(0.5), F.lit(0.1), F.lit(0.95), F.lit(0.1)), *stats.f_interval(F.lit(0.05), F.lit(0.1), F.lit(0.05), F.lit(0.1))).first()
    grid = [2 * p * r / (p + r) for p in (0.4, 0.5, 0.6) for r in (0.85, 0.95, 1.0)]
    assert tuple(row) == (pytest.approx(min(grid)), pytest.approx(max(grid)), 0, pytest.approx(0.15))


def test_posterior_sums_to_the_closed_form(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([1, 1, 1, 2, 3])) for i in range(300)]
    found = stats.sequential_posterior(spark.createDataFrame(rows, "ord long, context string, outcome int"), 0.3, 4)
    counts, total = {}, {}
    for o, c, d in rows:
        want = math.log(0.3 + counts.get((c, d), 0)) - math.log(1.2 + total.get(c, 0))
        counts[c, d], total[c] = counts.get((c, d), 0) + 1, total.get(c, 0) + 1
        rows[o] = (o, c, d, want)
    got = {r.ord: r.log_p for r in found.collect()}
    assert got == {o: pytest.approx(w) for o, _, _, w in rows}
    closed = sum(math.lgamma(1.2) - math.lgamma(1.2 + n) for n in total.values()) + sum(math.lgamma(0.3 + n) - math.lgamma(0.3) for n in counts.values())
    assert sum(got.values()) == pytest.approx(closed)


def test_frames_fit_by_containment(spark):
    rng = random.Random(4)
    labels = ["S", "O", "A", "P", ""]
    seen = [(0, i, rng.choice("xyz"), sorted(set(rng.choices(labels, k=rng.randint(0, 4))))) for i in range(200)]
    lexicon = [(rng.choice("xyw"), f"f{i}", rng.choices(labels[:4], k=rng.randint(0, 3))) for i in range(40)]
    a, b = spark.createDataFrame(seen, "sent_id long, idx int, lemma string, args array<string>"), spark.createDataFrame(lexicon, "lemma string, frame string, args array<string>")
    fits = frames.fitting(a, b)
    want = {(i, f) for _, i, lemma, args in seen for w, f, need in lexicon if w == lemma and set(need) <= set(args)}
    rows = fits.collect()
    assert {(r.idx, r.frame) for r in rows} == want and len(rows) == len(want) > 200
    sizes = {f: len(set(need)) for _, f, need in lexicon}
    best = {i: min((-sizes[f], f) for j, f in want if j == i) for i in {i for i, _ in want}}
    assert {r.idx: (-r["size"], r.frame) for r in frames.best(fits).collect()} == best
    assert {r.idx for r in frames.unmatched(a, fits).collect()} == {i for _, i, _, _ in seen} - set(best)


def test_observed_and_fused_frames(spark):
    words = spark.createDataFrame([(1, 0, "a", 1, "S"), (1, 1, "go", -1, "ROOT"), (1, 2, "b", 1, "O"), (1, 3, "c", 1, "S"), (1, 4, "go", -1, "ROOT")], "sent_id long, idx int, lemma string, head int, label string")
    assert {(r.idx, tuple(r.args)) for r in frames.observed(words, F.col("lemma") == "go").collect()} == {(1, ("O", "S")), (4, ())}
    one = spark.createDataFrame([("go", "f2", ["O", "S"]), ("go", "f3", [])], "lemma string, frame string, args array<string>")
    two = spark.createDataFrame([("go", "f1", ["S", "O", "S"]), ("do", "f9", ["S"])], "lemma string, frame string, args array<string>")
    assert {(r.lemma, r.frame, tuple(r.args)) for r in frames.fused(one, two).collect()} == {("go", "f1", ("O", "S")), ("go", "f3", ()), ("do", "f9", ("S",))}


@pytest.mark.parametrize("part", [12, 4096])
def test_moving_average_over_parts(spark, part):
    rng = random.Random(part)
    rows = [(rng.choice("ab"), i * 7, rng.random()) for i in range(150)]
    found = stats.moving_average(spark.createDataFrame(rows, "key string, o long, v double"), "o", "v", 10, part).collect()
    want = {}
    for key in "ab":
        own = [(o, v) for k, o, v in rows if k == key]
        want |= {o: sum(v for _, v in own[i - 9 : i + 1]) / 10 for i, (o, _) in enumerate(own) if i >= 9}
    assert {r.o: r["mean"] for r in found} == {o: pytest.approx(m) for o, m in want.items()} and len(found) == len(want)


def test_scores_by_label_in_one_row_or_two(spark):
    from treemill.operators import evaluate

    rng = random.Random(5)
    rows = [(1, i, *((rng.choice([0, 1]), rng.choice("XY")) if rng.random() < 0.8 else (None, None)), *((rng.choice([0, 1]), rng.choice("XYZ")) if rng.random() < 0.8 else (None, None))) for i in range(100)]
    words = spark.createDataFrame(rows, "sent_id long, idx int, gold_head int, gold_label string, sys_head int, sys_label string")
    side = lambda k: words.where(f"{k}_head is not null").selectExpr("sent_id", "idx as gov", f"{k}_head as head", f"{k}_label as label")
    assert {tuple(r) for r in evaluate.by_label_of(words).collect()} == {tuple(r) for r in evaluate.by_label(side("gold"), side("sys")).collect()}


def test_faults_and_equal_graphs(spark):
    from treemill.operators import rewrite, tree

    words = spark.createDataFrame([(1, 0, "A", 2, "X"), (1, 1, "PUN", 3, "X"), (1, 2, "B", -1, None), (1, 3, "C", 1, "X"), (2, 0, "A", -1, None)], "sent_id long, idx int, pos string, head int, label string")
    assert {tuple(r) for r in tree.faults(words).select("sent_id", "roots", "in_cycles", "crossing", "under_marks").collect()} == {(1, 1, 2, 3, 1), (2, 1, 0, 0, 0)}
    changed = words.withColumn("label", F.when(F.col("idx") == 3, "Y").otherwise(F.col("label")))
    assert [r.sent_id for r in tree.same_graphs(words, changed).collect()] == [2]
    arcs = spark.createDataFrame([(1, 2, 0, "A"), (1, 2, 4, "B"), (1, 2, 3, "GRPX"), (1, 5, 1, "C")], "sent_id long, gov int, head int, label string")
    assert {tuple(r) for r in rewrite.single_heads(arcs).collect()} == {(1, 2, 0, "A"), (1, 5, 1, "C")}
    shares = tree.shares_of_trees(spark.createDataFrame([("V(O:N S:D)", 3), ("D(O:V(S:N))", 1), ("V", 9)], "tree string, n long"))
    assert {(r.tree, r.bag, r.share) for r in shares.collect()} == {("V(O:N S:D)", "D N V", 0.75), ("D(O:V(S:N))", "D N V", 0.25), ("V", "V", 1.0)}
