"""Measures of dependency trees.

Ancestors, depths and yields come from ``forest``: one row a sentence, no walk cut short.  Functions
take ``deps`` or, without it, words that have their head already.
"""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treemill.operators import forest


def ancestors(tokens: DataFrame, deps: DataFrame | None = None) -> DataFrame:
    """sent_id, idx and chain, the ancestors of each word, nearest first; in a cycle up to the word itself."""

    def one(sent, heads):
        chains = []
        for i in range(len(heads)):
            chain, at = [], heads[i]
            while 0 <= at < len(heads) and at not in chain:
                chain.append(at)
                at = heads[at]
            chains.append((sent, i, chain))
        return chains

    words = forest.with_heads(tokens, deps).select("sent_id", "idx", "head")
    return forest.per_sentence(forest.sentences(words, "head"), one, "sent_id long, idx int, chain array<int>")


def roots(tokens: DataFrame, deps: DataFrame) -> DataFrame:
    return tokens.select("sent_id", "idx").join(deps.select("sent_id", F.col("gov").alias("idx")), ["sent_id", "idx"], "left_anti")


def root_of(tokens: DataFrame, deps: DataFrame | None = None) -> DataFrame:
    """The root of each word's tree: its last ancestor or itself; null in or under a cycle."""
    return forest.measures(tokens, deps).select("sent_id", "idx", "root")


def depths(tokens: DataFrame, deps: DataFrame | None = None) -> DataFrame:
    """The number of arcs from each word to its root; null in or under a cycle."""
    return forest.measures(tokens, deps).select("sent_id", "idx", "depth")


def cyclic(tokens: DataFrame, deps: DataFrame | None = None) -> DataFrame:
    """Words that are their own ancestors."""
    return forest.measures(tokens, deps).where("cyclic").select("sent_id", "idx")


def yields(tokens: DataFrame, deps: DataFrame | None = None) -> DataFrame:
    """sent_id, idx, and the leftmost and rightmost word below each word, itself included."""
    return forest.measures(tokens, deps).select("sent_id", "idx", "leftmost", "rightmost", "size")


def crossings(deps: DataFrame) -> DataFrame:
    """Pairs of arcs of a sentence that cross, each once, as gov_a < gov_b."""
    a = deps.select("sent_id", F.col("gov").alias("gov_a"), F.least("gov", "head").alias("l_a"), F.greatest("gov", "head").alias("r_a"))
    b = a.toDF("sent_id", "gov_b", "l_b", "r_b")
    crossing = ((F.col("l_a") < F.col("l_b")) & (F.col("l_b") < F.col("r_a")) & (F.col("r_a") < F.col("r_b"))) | ((F.col("l_b") < F.col("l_a")) & (F.col("l_a") < F.col("r_b")) & (F.col("r_b") < F.col("r_a")))
    return a.join(b, "sent_id").where((F.col("gov_a") < F.col("gov_b")) & crossing).select("sent_id", "gov_a", "gov_b")


def broken(sents, starts, sizes, heads):
    """For sentences laid end to end the arcs over words whose head lies outside, and the number of these words."""
    own, base = heads.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(starts, sizes)
    word = np.arange(len(own)) - base
    low, high, count = np.minimum(word, own), np.maximum(word, own), np.zeros(len(own), np.int64)
    arcs, step = np.flatnonzero((own >= 0) & (own < np.repeat(sizes, sizes))), 1
    while len(arcs := arcs[high[arcs] - low[arcs] > step]):
        over = own[base[arcs] + low[arcs] + step]
        count[arcs] += (over < low[arcs]) | (over > high[arcs])
        step += 1
    found = np.flatnonzero(count)
    return np.repeat(sents, sizes)[found], word[found], count[found]


def faulty(sents, starts, sizes, heads, tags):
    """For sentences laid end to end: sent_id, roots, words in cycles, arcs that cross another, arcs to punctuation."""
    own, base = heads.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(starts, sizes)
    word, row = np.arange(len(own)) - base, np.repeat(np.arange(len(sizes)), sizes)
    known = (own >= 0) & (own < np.repeat(sizes, sizes))
    up = np.where(known, own + base, -1)
    to, _, _ = forest.climbed(up, int(max(sizes, default=1)).bit_length())
    cyclic = np.zeros(len(up), bool)
    cyclic[to[up[to] >= 0]] = True
    arcs = np.flatnonzero(own >= 0)
    low, high, of = np.minimum(word, own)[arcs], np.maximum(word, own)[arcs], row[arcs]
    crossed, step = np.zeros(len(arcs), bool), 1
    a = np.arange(len(arcs))
    while len(a := a[a + step < len(arcs)]) and len(a := a[of[a] == of[a + step]]):
        b = a + step
        cross = ((low[a] < low[b]) & (low[b] < high[a]) & (high[a] < high[b])) | ((low[b] < low[a]) & (low[a] < high[b]) & (high[b] < high[a]))
        crossed[a[cross]] = crossed[b[cross]] = True
        step += 1
    marks = pc.fill_null(pc.equal(tags, "PUN"), False).to_numpy(zero_copy_only=False)
    n = lambda rows: np.bincount(rows, minlength=len(sizes))
    return sents, n(row[own < 0]), n(row[cyclic]), n(of[crossed]), n(row[known & marks[np.maximum(up, 0)]])


def unprojective(tokens: DataFrame, deps: DataFrame | None = None) -> DataFrame:
    """Arcs over a word whose own head lies outside the arc, or that has none; with their number.

    ``tokens`` alone may be rows of sentences with the arrays of their heads.
    """
    if deps is None:
        return forest.flat(forest.sentences(tokens, "head"), broken, "sent_id long, gov int, breaks long")
    heads = tokens.select("sent_id", "idx").join(deps.select("sent_id", F.col("gov").alias("idx"), "head"), ["sent_id", "idx"], "left").select("sent_id", F.col("idx").alias("word"), F.coalesce("head", F.lit(-1)).alias("over"))
    low, high = F.least("gov", "head"), F.greatest("gov", "head")
    joined = deps.select("sent_id", "gov", low.alias("low"), high.alias("high")).join(heads, "sent_id")
    found = joined.where("word > low and word < high and (over < low or over > high)")
    return found.groupBy("sent_id", "gov").agg(F.count("*").alias("breaks"))


def shapes(tokens: DataFrame, deps: DataFrame | None = None) -> DataFrame:
    """How often each shape of depth two occurs: a word's tag with its children's labels, sorted.

    ``tokens`` alone may be rows of sentences with arrays of tags, heads and labels.
    """
    if deps is None:

        def one(tags, heads, labels):
            found = [""] * len(tags)
            for word, kids in enumerate(forest.children_of(heads)):
                if kids:
                    found[word] = " ".join(sorted([labels[c] for c in kids]))
            return zip(tags, found, strict=True)

        return forest.counted(forest.sentences(tokens, "pos", "head", "label"), one, "pos string, children string")
    children = deps.groupBy("sent_id", F.col("head").alias("idx")).agg(F.array_join(F.array_sort(F.collect_list("label")), " ").alias("children"))
    found = tokens.select("sent_id", "idx", "pos").join(children, ["sent_id", "idx"], "left")
    return found.groupBy("pos", F.coalesce("children", F.lit("")).alias("children")).agg(F.count("*").alias("n"))


def sub_sentence(tokens: DataFrame, deps: DataFrame, first: int, last: int) -> tuple[DataFrame, DataFrame]:
    """Words first..last of every sentence, numbered anew, and the arcs inside."""
    kept = tokens.where(F.col("idx").between(first, last)).withColumn("idx", F.col("idx") - first)
    inside = deps.where(F.col("gov").between(first, last) & F.col("head").between(first, last))
    return kept, inside.withColumn("gov", F.col("gov") - first).withColumn("head", F.col("head") - first)


def sub_groups(groups: DataFrame, first: int, last: int) -> DataFrame:
    """The groups that lie whole in words first..last, numbered like ``sub_sentence``."""
    inside = groups.where((F.col("first_idx") >= first) & (F.col("last_idx") <= last))
    return inside.withColumn("first_idx", F.col("first_idx") - first).withColumn("last_idx", F.col("last_idx") - first)


def branches(words: DataFrame, at: DataFrame) -> DataFrame:
    """The whole branch that holds each word of ``at`` (sent_id, idx): what hangs on the child of the root above it, as
    ``forest.subtree`` gives it; words in or under cycles have none.
    """
    chains = ancestors(words).join(at, ["sent_id", "idx"], "left_semi").join(forest.measures(words).select("sent_id", "idx", "root"), ["sent_id", "idx"]).where("root is not null")
    tops = chains.select("sent_id", F.when(F.size("chain") >= 2, F.get("chain", F.size("chain") - 2)).otherwise(F.col("idx")).alias("idx")).distinct()
    most = words.groupBy("sent_id").count().agg(F.max("count")).first()[0] or 1
    return forest.subtree(words, tops, most)


def topology(sents, starts, sizes, heads):
    """For sentences laid end to end: sent_id, words, roots, arc length, largest number of children, and their weighted sum."""
    own, base = heads.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(starts, sizes)
    row, word = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(own)) - base
    has = own >= 0
    n = lambda rows: np.bincount(rows, minlength=len(sizes))
    length, fan = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    np.add.at(length, row[has], np.abs(word - own)[has])
    pairs, children = np.unique(row[has] * (own.max(initial=0) + 1) + own[has], return_counts=True)
    np.maximum.at(fan, pairs // (own.max(initial=0) + 1), children)
    roots = n(row[~has])
    return sents, sizes, roots, length, fan, 1000 * np.maximum(roots - 1, 0) + 10 * np.maximum(fan - 4, 0) + length


def penalties(tokens: DataFrame, deps: DataFrame | None = None) -> DataFrame:
    """Topology of each sentence: roots, arc length, largest number of children, and their weighted sum.

    Without ``deps``, ``tokens`` are rows of sentences with heads (-1: none), each its own sentence.
    """
    if deps is None:
        return forest.flat(forest.sentences(tokens, "head"), topology, "sent_id long, words long, roots long, length long, fan long, penalty long")
    per_root = roots(tokens, deps).groupBy("sent_id").agg(F.count("*").alias("roots"))
    length = deps.groupBy("sent_id").agg(F.sum(F.abs(F.col("gov") - F.col("head"))).alias("length"))
    fan = deps.groupBy("sent_id", "head").agg(F.count("*").alias("n")).groupBy("sent_id").agg(F.max("n").alias("fan"))
    found = tokens.groupBy("sent_id").agg(F.count("*").alias("words")).join(per_root, "sent_id", "left").join(length, "sent_id", "left").join(fan, "sent_id", "left").fillna(0)
    return found.withColumn("penalty", 1000 * F.greatest(F.col("roots") - 1, F.lit(0)) + 10 * F.greatest(F.col("fan") - 4, F.lit(0)) + F.col("length"))


def faults(words: DataFrame) -> DataFrame:
    """What speaks against the tree of each sentence: sent_id, roots, in_cycles (words in cycles), crossing (arcs that cross
    another) and under_marks (arcs to punctuation, ``pos`` PUN).  ``words`` may be rows of sentences.
    """
    if forest.gathered(words, "head", "pos"):
        return forest.flat(forest.sentences(words, "head", "pos"), faulty, "sent_id long, roots long, in_cycles long, crossing long, under_marks long")
    seen = forest.measures(words).groupBy("sent_id").agg(F.sum(F.col("cyclic").cast("int")).alias("in_cycles"))
    arcs = words.where("head >= 0").select("sent_id", F.col("idx").alias("gov"), "head", "label")
    crossed = crossings(arcs).select("sent_id", F.explode(F.array("gov_a", "gov_b")).alias("gov")).distinct().groupBy("sent_id").agg(F.count("*").alias("crossing"))
    marks = words.where("pos = 'PUN'").select("sent_id", F.col("idx").alias("head"))
    wrong = arcs.join(marks, ["sent_id", "head"], "left_semi").groupBy("sent_id").agg(F.count("*").alias("under_marks"))
    base = words.groupBy("sent_id").agg(F.sum((F.col("head") < 0).cast("int")).alias("roots"))
    return base.join(seen, "sent_id").join(crossed, "sent_id", "left").join(wrong, "sent_id", "left").fillna(0)


def shares_of_trees(counts: DataFrame, floor: float = 1e-5) -> DataFrame:
    """``counts`` (tree, n, as ``forest.frequent_subtrees`` names them) with bag, the tree's sorted tags, and share: how
    many of the trees with the same tags are this one, ``floor`` at least.
    """
    bag = F.array_join(F.array_sort(F.regexp_extract_all(F.regexp_replace("tree", "[^ ():]+:", ""), F.lit("([^ ()]+)"))), " ")
    found = counts.withColumn("bag", bag)
    totals = found.groupBy("bag").agg(F.sum("n").alias("_all"))
    return found.join(totals, "bag").withColumn("share", F.greatest(F.col("n") / F.col("_all"), F.lit(floor))).drop("_all")


def same_graphs(a: DataFrame, b: DataFrame | None = None) -> DataFrame:
    """sent_id of the sentences that have equal tags, heads and labels, word by word, in two versions (words with head and label).

    Rows of sentences with the heads and labels of both annotations stay as they are.
    """
    if b is None:
        return a.where("gold_heads = sys_heads and gold_labels = sys_labels")
    plain = lambda df, n: forest.sentences(df.select("sent_id", "idx", "pos", "head", F.coalesce("label", F.lit("")).alias("label")), "pos", "head", "label").select("sent_id", F.struct("poss", "heads", "labels").alias(n))
    return plain(a, "_a").join(plain(b, "_b"), "sent_id").where("_a = _b").select("sent_id")
