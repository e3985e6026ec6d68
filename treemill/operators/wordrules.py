"""Rules that look from a word X for a word Y, many of them in one pass.

A rule tests X, finds Y (the nearest word after or before X at which the search halts, or the word at an offset),
tests what it found without looking further, and attaches X, or X's head Z, to Y.  The tests of all rules
are columns of the words; one window over the sentence finds the Ys of all rules and one array of its words
answers what is asked of Y and Z, so a list of rules costs one exchange, however long.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treemill.operators import forest
from treemill.sources.adapter import after, before

#: Tests in a number.
BITS = 60
AFTER, BEFORE = "after", "before"


@dataclass(frozen=True)
class WordRule:
    """Tests in SQL over a word's columns: idx, form, lemma, pos, head (-1: none), label and sons, the labels of
    the arcs into it.

    ``place``: after, before or an offset.  ``halt`` is tested on each word on the way (with an offset on the one word),
    ``found`` on the word where the search halted.  With ``of_head`` X must have a head Z that meets it, and Z is
    attached in place of X.
    """

    name: str
    when: str
    place: str | int
    label: str
    halt: str = "true"
    found: str = "true"
    of_head: str | None = None


def with_sons(words: DataFrame) -> DataFrame:
    """``words`` (with head and label) and ``sons``: the labels of the arcs into each, in word order."""
    sentence = Window.partitionBy("sent_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    arcs = F.collect_list(F.struct("head", "label")).over(sentence)
    return words.withColumn("_arcs", arcs).withColumn("sons", F.transform(F.filter("_arcs", lambda a: a["head"] == F.col("idx")), lambda a: a["label"])).drop("_arcs")


def _flat_words(sents, starts, sizes, forms, tags, heads, labels):
    """The words of sentences laid end to end, with sons."""
    own, base = heads.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(starts, sizes)
    arcs = np.flatnonzero((own >= 0) & (own < np.repeat(sizes, sizes)))
    sons = forest.listed((own + base)[arcs], labels.take(pa.array(arcs)), len(own))
    return np.repeat(sents, sizes), np.arange(len(own)) - base, forms, tags, own, labels, sons


def _candidates_in(rows: DataFrame, rules: Sequence[WordRule]) -> DataFrame:
    """``candidates`` of rows of sentences: the tests of each word are bits that Spark finds where the sentence is, the Ys of the
    sentences of a batch are found in numpy.
    """
    test = lambda sql: F.coalesce(F.expr(f"({sql})"), F.lit(False))
    words = forest.flat(rows.select("sent_id", "forms", "poss", "heads", "labels"), _flat_words, "sent_id long, idx int, form string, pos string, head int, label string, sons array<string>")

    def bits(tests: list[str]) -> Column:
        """``BITS`` tests in a number."""
        some = [tests[k : k + BITS] for k in range(0, len(tests), BITS)]
        one = lambda ts: reduce(lambda x, y: x.bitwiseOR(y), [F.when(test(t), F.lit(1 << n).cast("long")).otherwise(F.lit(0).cast("long")) for n, t in enumerate(ts)])
        return F.array(*map(one, some)).cast("array<long>")

    kinds = [[r.when for r in rules], [r.halt for r in rules], [r.found for r in rules], [r.of_head or "true" for r in rules]]
    tested = words.withColumn("lemma", F.lower("form")).select("sent_id", "idx", "head", *[bits(k).alias(f"_{n}") for n, k in enumerate(kinds)])
    names, labels, many = pa.array([r.name for r in rules], pa.string()), pa.array([r.label for r in rules], pa.string()), -(-len(rules) // BITS)

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        sent, idx, head = (c.to_numpy().astype(np.int64) for c in batch.columns[:3])
        when, halt, fits, of = (c.flatten().to_numpy().reshape(-1, many) for c in batch.columns[3:])
        bit = lambda column, n: (column[:, n // BITS] >> (n % BITS)) & 1 > 0
        at, starts = np.arange(len(idx)), np.flatnonzero(idx == 0)
        first = at - idx
        end = np.repeat(np.append(starts[1:], len(idx)), np.diff(np.append(starts, len(idx))))
        up = np.where((head >= 0) & (head + first < end), head + first, -1)
        made = []
        for n, rule in enumerate(rules):
            halts = bit(halt, n)
            if rule.place in (AFTER, BEFORE):
                y = after(halts, end) if rule.place == AFTER else before(halts, first)
            else:
                y = at + rule.place
                y = np.where((y >= first) & (y < end) & halts.take(y, mode="clip"), y, -1)
            ok = bit(when, n) & (y >= 0) & bit(fits, n)[y]
            if rule.of_head is not None:
                ok = ok & (up >= 0) & bit(of, n)[up] & (up != y)
            x = np.flatnonzero(ok)
            made.append((np.full(len(x), n), sent[x], (up if rule.of_head else at)[x] - first[x], y[x] - first[x]))
        n, sents, gov, to = (np.concatenate(c) for c in zip(*made, strict=True))
        return pa.RecordBatch.from_arrays([names.take(pa.array(n)), pa.array(sents), pa.array(gov.astype(np.int32)), pa.array(to.astype(np.int32)), labels.take(pa.array(n))], names=["rule", "sent_id", "gov", "head", "label"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # from the beginning of a sentence on
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= forest.WORDS:
                words = whole(held)
                to = int(np.flatnonzero(words.column(1).to_numpy() == 0)[-1])
                if to:
                    yield found(words.slice(0, to))
                held = [words.slice(to)]
        if sum(b.num_rows for b in held):
            yield found(whole(held))

    whole = lambda some: pa.Table.from_batches(some).combine_chunks().to_batches()[0]
    if not rules:
        return tested.limit(0).selectExpr("'' as rule", "sent_id", "idx as gov", "head", "'' as label")
    return tested.mapInArrow(run, "rule string, sent_id long, gov int, head int, label string")


def candidates(words: DataFrame, rules: Sequence[WordRule]) -> DataFrame:
    """rule, sent_id, gov, head and label: the arcs that each rule makes from the words as they are.

    Null tests count as false.  An arc from a word to itself (Z found as Y) is none.  ``words`` may be rows of sentences with
    arrays of forms, poss, heads and labels; then nothing is shuffled.
    """
    if "heads" in words.columns:
        return _candidates_in(words, rules)
    test = lambda sql: F.coalesce(F.expr(f"({sql})"), F.lit(False))
    tests = [F.array(*[test(r.when) for r in rules]).alias("_when"), F.array(*[test(r.halt) for r in rules]).alias("_halt")]
    tests += [F.array(*[test(r.found) for r in rules]).alias("_found"), F.array(*[test(r.of_head or "true") for r in rules]).alias("_of")]
    tested = with_sons(words).select("sent_id", "idx", "head", *tests)
    order = Window.partitionBy("sent_id").orderBy("idx")

    def place(n: int, rule: WordRule) -> Column:
        hit = F.when(F.col("_halt")[n], F.col("idx"))
        if rule.place == AFTER:
            return F.min(hit).over(order.rowsBetween(1, Window.unboundedFollowing))
        if rule.place == BEFORE:
            return F.max(hit).over(order.rowsBetween(Window.unboundedPreceding, -1))
        return F.max(hit).over(order.rowsBetween(rule.place, rule.place))

    whole = F.collect_list(F.struct("_found", "_of")).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    placed = tested.select("*", whole.alias("_whole"), *[place(n, r).alias(f"_y{n}") for n, r in enumerate(rules)])
    made = []
    for n, rule in enumerate(rules):
        y, gov = F.col(f"_y{n}"), F.col("head") if rule.of_head else F.col("idx")
        ok = F.col("_when")[n] & y.isNotNull() & F.get(F.col("_whole")["_found"], y)[n]
        if rule.of_head:
            ok = ok & (F.col("head") >= 0) & F.get(F.col("_whole")["_of"], F.col("head"))[n] & (F.col("head") != y)
        made.append(F.when(ok, F.struct(F.lit(rule.name).alias("rule"), gov.alias("gov"), y.alias("head"), F.lit(rule.label).alias("label"))))
    arcs = placed.select("sent_id", F.array_compact(F.array(*made)).alias("_arcs"))
    return arcs.select("sent_id", F.explode("_arcs").alias("a")).select("a.rule", "sent_id", "a.gov", "a.head", "a.label")
