"""Rewriting graphs by the matches of a search, all at once (a snapshot, set by set)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treemill.operators.forest import flat, per_sentence, sentences


def delete_arcs_of(deps: DataFrame, matches: DataFrame, word: str) -> DataFrame:
    return deps.join(matches.select("sent_id", F.col(word).alias("gov")), ["sent_id", "gov"], "left_anti")


def delete_labels(deps: DataFrame, matches: DataFrame, label: str, others: bool = False) -> DataFrame:
    """Without the arcs of that label (``others``: of any other) in sentences that match."""
    hit = matches.select("sent_id").distinct().withColumn("_hit", F.lit(True))
    gone = F.col("_hit").isNotNull() & ((F.col("label") != label) if others else (F.col("label") == label))
    return deps.join(hit, "sent_id", "left").where(~gone).drop("_hit")


def add_arcs(deps: DataFrame, matches: DataFrame, gov: str, head: str, label: str, copy: bool = False) -> DataFrame:
    """An arc for each match unless it is there; a head below 0 adds none; ``copy``: label is a column."""
    new = matches.where(F.col(head) >= 0).select("sent_id", F.col(gov).alias("gov"), F.col(head).alias("head"), (F.col(label) if copy else F.lit(label)).alias("label")).distinct()
    new = new.join(deps, ["sent_id", "gov", "head", "label"], "left_anti")
    return deps.select("sent_id", "gov", "head", "label").unionByName(new)


def would_add(deps: DataFrame, matches: DataFrame, gov: str, head: str) -> DataFrame:
    """Matches that would make a new arc; words whose label starts with ``_`` are left alone."""
    fixed = deps.where(F.col("label").startswith("_")).select("sent_id", F.col("gov").alias(gov))
    there = deps.select("sent_id", F.col("gov").alias(gov), F.col("head").alias(head))
    return matches.where(F.col(head) >= 0).join(fixed, ["sent_id", gov], "left_anti").join(there, ["sent_id", gov, head], "left_anti")


def delete_groups(groups: DataFrame, matches: DataFrame, first: str, last: str | None = None) -> DataFrame:
    key = ["sent_id", "first_idx"] + ["last_idx"] * bool(last)
    gone = matches.select("sent_id", F.col(first).alias("first_idx"), *([F.col(last).alias("last_idx")] if last else []))
    return groups.join(gone, key, "left_anti")


def add_groups(groups: DataFrame, matches: DataFrame, a: str, b: str, name: str) -> DataFrame:
    new = matches.select("sent_id", F.lit(name).alias("name"), F.least(a, b).alias("first_idx"), F.greatest(a, b).alias("last_idx"))
    return groups.select("sent_id", "name", "first_idx", "last_idx").unionByName(new).distinct()


def regrouped(rows: DataFrame, gone: str, added: str, name: str) -> DataFrame:
    """sent_id and groups (name, first_idx, last_idx) of rows of sentences without the groups that begin with a word that meets
    ``gone``, and with one of that name from each word that meets ``added`` to its head; SQL over pos and label.

    The groups of a sentence are a set, and none leaves its row.
    """
    test = lambda sql, i: reduce(lambda s, c: re.sub(rf"\b{c}\b", f"get({c}s, {i})", s), ("pos", "label"), sql)
    old = f"filter(arrays_zip(names, firsts, lasts), g -> NOT ({test(gone, 'g.firsts')}))"
    old = f"transform({old}, g -> named_struct('name', g.names, 'first_idx', g.firsts, 'last_idx', g.lasts))"
    words = f"filter(sequence(0, size(heads) - 1), i -> get(heads, i) >= 0 AND ({test(added, 'i')}))"
    new = f"transform({words}, i -> named_struct('name', '{name}', 'first_idx', least(i, get(heads, i)), 'last_idx', greatest(i, get(heads, i))))"
    return rows.select("sent_id", F.expr(f"array_distinct(concat({old}, {new}))").alias("groups"))


def renumbered(rows: DataFrame) -> DataFrame:
    """sent_id, gov, head and label of the arcs between words that stay, numbered anew: of rows of sentences with heads,
    labels and ``gones``, whether each word goes.
    """

    def many(sents, starts, sizes, heads, labels, away):
        kept = ~away.to_numpy(zero_copy_only=False)
        own, base = heads.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(starts, sizes)
        before = np.cumsum(kept) - kept
        place = before - before[base] if len(before) else before
        at = np.where((own >= 0) & (own < np.repeat(sizes, sizes)), own + base, -1)
        found = np.flatnonzero(kept & (at >= 0) & kept[np.maximum(at, 0)])
        return np.repeat(sents, sizes)[found], place[found], place[at[found]], labels.take(pa.array(found))

    return flat(sentences(rows, "head", "label", "gone"), many, "sent_id long, gov int, head int, label string")


def delete_words(tokens: DataFrame, deps: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the words in ``gone`` (sent_id, idx): the rest numbered anew, arcs to them dropped."""
    from pyspark.sql import Window

    kept = tokens.join(gone.select("sent_id", "idx"), ["sent_id", "idx"], "left_anti")
    numbered = kept.withColumn("_new", F.row_number().over(Window.partitionBy("sent_id").orderBy("idx")) - 1)
    place = numbered.select("sent_id", "idx", "_new")
    moved = deps.join(place.select("sent_id", F.col("idx").alias("gov"), F.col("_new").alias("_gov")), ["sent_id", "gov"]).join(place.select("sent_id", F.col("idx").alias("head"), F.col("_new").alias("_head")), ["sent_id", "head"])
    return numbered.drop("idx").withColumnRenamed("_new", "idx"), moved.select("sent_id", F.col("_gov").alias("gov"), F.col("_head").alias("head"), "label")


def lifted(heads: list[int], away: list[bool]) -> Iterator[tuple[int, int, int]]:
    """Old place, new place and new head (-1: none) of each word that stays when some go."""
    place, n = [], 0
    for out in away:
        place.append(-1 if out else n)
        n += not out
    for i, out in enumerate(away):
        if not out:
            at, seen = heads[i], set()
            while 0 <= at < len(heads) and away[at] and at not in seen:
                seen.add(at)
                at = heads[at]
            kept = 0 <= at < len(heads) and not away[at] and at != i
            yield i, place[i], place[at] if kept else -1


def reattached(words: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words and arcs without the words in ``gone`` (sent_id, idx), the rest numbered anew; a word whose head goes hangs on
    the nearest word above that stays, and has no arc if there is none.  ``words`` have head (-1: none) and label.
    """
    marked = words.join(gone.select("sent_id", "idx", F.lit(True).alias("_gone")).distinct(), ["sent_id", "idx"], "left").withColumn("_gone", F.col("_gone").isNotNull())

    def one(sent, heads, away):
        return [(sent, *step) for step in lifted(heads, away)]

    rows = sentences(marked.select("sent_id", "idx", "head", "_gone"), "head", "_gone")
    placed = per_sentence(rows, one, "sent_id long, idx int, _new int, _head int")
    found = words.drop("head").join(placed, ["sent_id", "idx"]).drop("idx").withColumnsRenamed({"_new": "idx", "_head": "head"})
    arcs = found.where("head >= 0").select("sent_id", F.col("idx").alias("gov"), "head", "label")
    return found.drop("head", "label"), arcs


def reattached_arcs(rows: DataFrame) -> DataFrame:
    """The arcs of ``reattached``: of rows of sentences with heads, labels and ``gones``, whether each word goes."""
    one = lambda sent, heads, labels, away: [(sent, new, head, labels[i]) for i, new, head in lifted(heads, away) if head >= 0]
    return per_sentence(sentences(rows, "head", "label", "gone"), one, "sent_id long, gov int, head int, label string")


def single_heads(deps: DataFrame, dropped: str = "GRP") -> DataFrame:
    """One arc a word, for formats that have no more: of several the nearest head, of equally near ones the left; arcs whose
    label begins with ``dropped`` go first.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("sent_id", "gov").orderBy(F.abs(F.col("head") - F.col("gov")), "head", "label")
    ranked = deps.where(~F.col("label").startswith(dropped)).withColumn("_n", F.row_number().over(order))
    return ranked.where("_n = 1").select("sent_id", "gov", "head", "label")
