"""Counts over corpora."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treemill.operators.forest import children_of, counted, gathered, sentences
from treemill.operators.running import summed_before
from treemill.operators.tree import roots


def by_pos_label(tokens: DataFrame, deps: DataFrame) -> DataFrame:
    joined = deps.join(tokens.select("sent_id", F.col("idx").alias("gov"), "pos"), ["sent_id", "gov"])
    return joined.groupBy("pos", "label").agg(F.count("*").alias("n"))


def by_label_head_pos(tokens: DataFrame, deps: DataFrame) -> DataFrame:
    joined = deps.join(tokens.select("sent_id", F.col("idx").alias("head"), F.col("pos").alias("head_pos")), ["sent_id", "head"])
    return joined.groupBy("label", "head_pos").agg(F.count("*").alias("n"))


def roots_histogram(tokens: DataFrame, deps: DataFrame) -> DataFrame:
    """How many sentences have each number of roots, none included."""
    counts = tokens.select("sent_id").distinct().join(roots(tokens, deps).groupBy("sent_id").agg(F.count("*").alias("roots")), "sent_id", "left")
    return counts.groupBy(F.coalesce("roots", F.lit(0)).alias("roots")).agg(F.count("*").alias("sentences"))


def vocabulary(tokens: DataFrame, least: int = 5) -> DataFrame:
    """Lower-case forms seen often enough, and the tags as back-off."""
    forms = tokens.groupBy(F.lower("form").alias("item")).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(F.lit("form").alias("kind"), "item", "n")
    return forms.unionByName(tokens.groupBy(F.col("pos").alias("item")).agg(F.count("*").alias("n")).select(F.lit("pos").alias("kind"), "item", "n"))


def dirichlet(counts: DataFrame, context: str, outcome: str, alpha: float = 0.001) -> DataFrame:
    """Log posteriors ln(alpha + n) - ln(N + S alpha) of outcomes in contexts; S outcomes in all."""
    space = counts.select(outcome).distinct().agg(F.count("*").alias("s"))
    found = counts.groupBy(context, outcome).agg(F.sum("n").alias("n")).crossJoin(F.broadcast(space))
    total = F.sum("n").over(Window.partitionBy(context))
    return found.select(context, outcome, "n", (F.log(alpha + F.col("n")) - F.log(total + F.col("s") * alpha)).alias("log_posterior"))


def entropy(counts: DataFrame) -> DataFrame:
    p = F.col("n") / F.sum("n").over(Window.partitionBy())
    return counts.select((-p * F.log(p)).alias("part")).agg(F.sum("part").alias("entropy"))


def label_bigrams(deps: DataFrame) -> DataFrame:
    """Labels of neighbouring children of a word."""
    order = Window.partitionBy("sent_id", "head").orderBy("gov")
    return deps.withColumn("next_label", F.lead("label").over(order)).where("next_label is not null").groupBy("label", "next_label").agg(F.count("*").alias("n"))


def preferences(tokens: DataFrame, deps: DataFrame | None = None, least: int = 2) -> DataFrame:
    """Lemmas that occur as dependents of lemmas with a label, and how often.

    ``tokens`` alone are words with head, label and head_lemma.
    """
    if deps is None:
        found = tokens.where("head >= 0").groupBy("head_lemma", "label", F.col("lemma").alias("dep_lemma")).agg(F.count("*").alias("n"))
        return found.where(F.col("n") >= least)
    dep = tokens.select("sent_id", F.col("idx").alias("gov"), F.col("lemma").alias("dep_lemma"))
    head = tokens.select("sent_id", F.col("idx").alias("head"), F.col("lemma").alias("head_lemma"))
    return deps.join(dep, ["sent_id", "gov"]).join(head, ["sent_id", "head"]).groupBy("head_lemma", "label", "dep_lemma").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def moving_average(rows: DataFrame, order: str, value: str, size: int = 10, part: int = 4096) -> DataFrame:
    """The mean of the last ``size`` rows, where there are so many; by group column ``key``.

    Rows of a key are dealt into parts of ``part`` rows in their order (a number that tells them apart), each with the last
    rows of the part before it, so no key is in one task.
    """
    ranked = summed_before(rows, order, ["key"], _n=F.lit(1)).withColumn("_part", F.floor(F.col("_n") / part))
    again = F.when(F.col("_n") % part >= part - size + 1, F.array("_part", F.col("_part") + 1)).otherwise(F.array("_part"))
    dealt = ranked.withColumn("_in", F.explode(again))
    frame = Window.partitionBy("key", "_in").orderBy("_n").rowsBetween(1 - size, 0)
    found = dealt.withColumn("mean", F.avg(value).over(frame))
    return found.where((F.col("_in") == F.col("_part")) & (F.col("_n") >= size - 1)).drop("_n", "_part", "_in")


def log_likelihood(counts: DataFrame, context: str, outcome: str) -> DataFrame:
    """Per context: n, and the log likelihood of its outcomes under their own shares."""
    cell = counts.groupBy(context, outcome).agg(F.sum("n").alias("k"))
    total = cell.groupBy(context).agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.log("k")).alias("own"))
    return total.select(context, "n", (F.col("own") - F.col("n") * F.log("n")).alias("log_likelihood"))


def operating_points(scored: DataFrame, score: str = "score", truth: str = "truth") -> DataFrame:
    """False accepts and false rejects at each distinct score, summed per score before the running sums."""
    per = scored.groupBy(score).agg(F.sum(F.col(truth).cast("int")).alias("good"), F.sum(1 - F.col(truth).cast("int")).alias("bad"))
    everything = per.agg(F.sum("good").alias("_goods"), F.sum("bad").alias("_bads"))
    found = summed_before(per, score, rejected=F.col("good"), passed=F.col("bad")).crossJoin(F.broadcast(everything))
    return found.select(score, (1 - F.try_divide("passed", "_bads")).alias("false_accept"), F.try_divide("rejected", "_goods").alias("false_reject"))


def equal_error_rate(points: DataFrame, score: str = "score") -> DataFrame:
    """The least score of ``operating_points`` at which as many are wrongly rejected as accepted, or more, and the mean of
    the two shares there; no row if there is none.
    """
    found = points.where(F.col("false_reject") >= F.col("false_accept")).agg(F.min(F.struct(score, "false_accept", "false_reject")).alias("p")).where("p is not null")
    return found.select(f"p.{score}", ((F.col("p.false_accept") + F.col("p.false_reject")) / 2).alias("eer"))


def f_interval(p: Column, p_half: Column, r: Column, r_half: Column) -> tuple[Column, Column]:
    """The least and the greatest F for a precision and a recall within their intervals (cut to [0, 1])."""
    f = lambda x, y: F.try_divide(2 * x * y, x + y)
    low = f(F.greatest(p - p_half, F.lit(0.0)), F.greatest(r - r_half, F.lit(0.0)))
    return F.coalesce(low, F.lit(0.0)), F.coalesce(f(F.least(p + p_half, F.lit(1.0)), F.least(r + r_half, F.lit(1.0))), F.lit(0.0))


def posterior_sums(counts: DataFrame, alpha: float, outcomes: int) -> DataFrame:
    """context, n and log_p: the sums of ``sequential_posterior`` over all events of each context, from ``counts`` (context,
    outcome, n).  What the events add in turn depends on how many there were before only, so the sums need no order.
    """
    from math import lgamma

    @F.pandas_udf("double")
    def rising(start: pd.Series, n: pd.Series) -> pd.Series:
        """ln(start) + ln(start + 1) + ..., n terms."""
        return pd.Series([lgamma(s + k) - lgamma(s) for s, k in zip(start, n, strict=True)], dtype="float64")

    cells = counts.withColumn("_own", rising(F.lit(alpha), F.col("n")))
    found = cells.groupBy("context").agg(F.sum("n").alias("n"), F.sum("_own").alias("_own"))
    return found.select("context", "n", (F.col("_own") - rising(F.lit(alpha * outcomes), F.col("n"))).alias("log_p"))


def sequential_posterior(events: DataFrame, alpha: float, outcomes: int, order: str = "ord") -> DataFrame:
    """``events`` (a numeric order, context, outcome) with log_p: the log probability of each outcome in its context, given the
    events before it, under a symmetric Dirichlet prior over ``outcomes`` outcomes.

    The order must tell events apart.  Counts so far are made in ranges of the order, so no context is counted in
    one task; the sum over all events is the log of a closed form, whatever the order.
    """
    seen = summed_before(events, order, ["context"], _n=F.lit(1))
    seen = summed_before(seen, order, ["context", "outcome"], _k=F.lit(1))
    return seen.withColumn("log_p", F.log(alpha + F.col("_k")) - F.log(F.lit(alpha * outcomes) + F.col("_n"))).drop("_n", "_k")


def frames_in_order(words: DataFrame) -> DataFrame:
    """How often each head's tag occurs with each frame: the labels of its children in word order, ``_`` in its own place.

    ``words`` have head, label and pos, or are rows of sentences with their arrays.
    """
    if gathered(words, "pos", "head", "label"):

        def one(tags, heads, labels):
            found = ["_"] * len(tags)
            for word, kids in enumerate(children_of(heads)):
                if kids:
                    found[word] = " ".join([labels[c] for c in kids if c < word] + ["_"] + [labels[c] for c in kids if c > word])
            return zip(tags, found, strict=True)

        return counted(sentences(words, "pos", "head", "label"), one, "pos string, frame string")
    arcs = words.where("head >= 0").select("sent_id", F.col("head").alias("idx"), F.col("idx").alias("at"), "label")
    own = words.select("sent_id", "idx", F.col("idx").alias("at"), F.lit("_").alias("label"))
    frames = arcs.unionByName(own).groupBy("sent_id", "idx").agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", "label")))["label"], " ").alias("frame"))
    return frames.join(words.select("sent_id", "idx", "pos"), ["sent_id", "idx"]).groupBy("pos", "frame").agg(F.count("*").alias("n"))


def arc_lengths(deps: DataFrame) -> DataFrame:
    """How often arcs of each label have each length and direction (positive: the head stands behind)."""
    return deps.groupBy("label", (F.col("head") - F.col("gov")).alias("length")).agg(F.count("*").alias("n"))
