"""Multiword units: finding them by a lexicon, merging their words and splitting words again.

Words, arcs and groups are numbered anew together.  Units are found by an equi-join of word sequences
with the lexicon, and chosen from left to right, the longest first, in one fold a sentence.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treemill.operators import forest
from treemill.operators.forest import per_sentence

#: Between the words of a unit.
JOINT = "_"
#: Forms of a lexicon that is sent to the tasks.
SENT = 100_000


def _entries(lexicon: DataFrame) -> DataFrame:
    entries = lexicon.groupBy("form").agg(F.min(F.struct("lemma", "pos")).alias("e")).withColumn("k", F.size(F.split("form", JOINT))).where("k > 1")
    return entries.select("form", "k", "e.lemma", "e.pos")


class Units:
    """A small lexicon in a task: the units of a sentence, from left to right, the longest first."""

    def __init__(self, entries: list):
        self.known = {(e.form, e.k): (e.lemma, e.pos) for e in entries}
        self.lengths = sorted({e.k for e in entries}, reverse=True)
        #: what stands before a joint in any form, so the first word of every unit
        self.firsts = {e.form[: m.start()] for e in entries for m in re.finditer(JOINT, e.form)}

    def of(self, forms: list[str]) -> Iterator[tuple[int, int, str, str, str]]:
        at = 0
        while at < len(forms):
            if forms[at] in self.firsts:
                for k in self.lengths:
                    form = JOINT.join(forms[at : at + k])
                    if at + k <= len(forms) and (form, k) in self.known:
                        yield at, at + k - 1, form, *self.known[form, k]
                        at += k - 1
                        break
            at += 1

    def of_all(self, ends: np.ndarray, forms: pa.Array) -> list[tuple[int, int, str, str, str]]:
        """``of`` for sentences laid end to end (``ends``: of each word's sentence), by places in the whole; only words that a unit begins with are looked at."""
        coded = forms.dictionary_encode()
        begins = np.array([f in self.firsts for f in coded.dictionary.to_pylist()], bool)[coded.indices.to_numpy()]
        free, found = 0, []
        places = np.flatnonzero(begins)
        for at, end in zip(places.tolist(), ends[places].tolist(), strict=True):
            if at >= free:
                words = forms[at : min(end, at + self.lengths[0])].to_pylist()
                for k in self.lengths:
                    if k <= len(words) and (known := self.known.get((form := JOINT.join(words[:k]), k))):
                        found.append((at, at + k - 1, form, *known))
                        free = at + k
                        break
        return found


def pairs(rows: DataFrame) -> DataFrame:
    """form (``a_b``) and n of words that stand side by side, for rows of sentences with forms; a pair has a row for each batch it is in."""

    def many(sents, starts, sizes, forms):
        first = np.ones(len(forms), bool)
        first[(starts + sizes - 1)[sizes > 0]] = False
        at = np.flatnonzero(first)
        coded = forms.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        keys, n = np.unique(codes[at] * len(coded.dictionary) + codes[at + 1], return_counts=True)
        a, b = np.divmod(keys, max(1, len(coded.dictionary)))
        return pc.binary_join_element_wise(coded.dictionary.take(pa.array(a)), coded.dictionary.take(pa.array(b)), JOINT), n

    return forest.flat(rows.select("sent_id", "forms"), many, "form string, n long")


def merged_rows(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Words and arcs of ``merged`` as rows of sentences: forms, poss, heads (-1: none) and labels (null without an arc), of rows
    that have these arrays; lexicons of ``SENT`` forms at most.
    """
    found = _entries(lexicon).limit(SENT + 1).collect()
    if len(found) > SENT:
        raise ValueError(f"over {SENT} units: use merged")
    units = Units(found)

    def some(part: pa.RecordBatch) -> pa.RecordBatch:
        sizes = part.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        base, end = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)
        forms, tags, heads, labels = (c.flatten() for c in part.columns[1:])
        given = units.of_all(end, forms)
        begins = np.ones(len(forms), bool)
        for a, b, *_ in given:
            begins[a + 1 : b + 1] = False
        olds = np.flatnonzero(begins)
        new = np.cumsum(begins) - 1  # places of the words left, in the whole
        edges = np.append(np.searchsorted(olds, starts), len(olds)).astype(np.int32)
        at = new[np.array([u[0] for u in given], np.int64)]
        put = np.zeros(len(olds), bool)
        put[at] = True
        in_unit = lambda column, k: pc.replace_with_mask(column.take(pa.array(olds)), pa.array(put), pa.array([u[k] for u in given], pa.string()))
        own = heads.to_numpy(zero_copy_only=False).astype(np.int64)
        known = (own >= 0) & (own < end - base)
        to = np.where(known, new[np.where(known, own + base, 0)], -1)
        out = np.flatnonzero(known & (to != new))[::-1]  # so that the first word of a unit that leads out of it counts
        via = np.full(len(olds), -1)
        via[new[out]] = out
        head = np.where(via >= 0, to[via] - np.repeat(edges[:-1], np.diff(edges)), -1) if len(olds) else via
        label = labels.take(pa.array(via, mask=via < 0))
        columns = [in_unit(forms, 2), in_unit(tags, 4), pa.array(head.astype(np.int32)), label]
        return pa.RecordBatch.from_arrays([part.column(0), *[pa.ListArray.from_arrays(pa.array(edges), c) for c in columns]], names=["sent_id", "forms", "poss", "heads", "labels"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(some, forest.parts(batch, 1))

    return rows.select("sent_id", "forms", "poss", "heads", "labels").mapInArrow(run, "sent_id long, forms array<string>, poss array<string>, heads array<int>, labels array<string>")


def regrouped(rows: DataFrame) -> DataFrame:
    """The groups of ``cut`` for rows of sentences with groups (names, firsts, lasts) and ``ns``, the number of parts of each word."""

    def one(sent, ns, names, firsts, lasts):
        ends = list(accumulate(ns))
        found = {(name, ends[a] - ns[a], ends[b] - 1) for name, a, b in zip(names, firsts, lasts, strict=True)}
        return [(sent, *g) for g in found if g[1] <= g[2]]

    return per_sentence(rows.select("sent_id", "ns", "names", "firsts", "lasts"), one, "sent_id long, name string, first_idx int, last_idx int")


def found_units(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """sent_id, first_idx, last_idx, form, lemma and pos of the units of ``lexicon`` (form as ``a_b_c``, lemma, pos).

    From left to right, the longest at each word; a unit never begins inside another.  Forms of one word
    are no units; of equal forms in the lexicon the least (lemma, pos) counts.  ``tokens`` may be rows of sentences with
    forms; then a lexicon of ``SENT`` forms at most is sent to the tasks, and a larger one joined as always.
    """
    entries = _entries(lexicon)
    if "forms" in tokens.columns:
        found = entries.limit(SENT + 1).collect()
        if len(found) <= SENT:
            units = Units(found)

            def many(sents, starts, sizes, forms):
                given, base = units.of_all(np.repeat(starts + sizes, sizes), forms), np.repeat(starts, sizes)
                at = np.array([u[0] for u in given], np.int64)
                last = np.array([u[1] for u in given], np.int64)
                return np.repeat(sents, sizes)[at], at - base[at], last - base[at], *[pa.array([u[k] for u in given], pa.string()) for k in (2, 3, 4)]

            return forest.flat(tokens.select("sent_id", "forms"), many, "sent_id long, first_idx int, last_idx int, form string, lemma string, pos string")
        tokens = tokens.select("sent_id", F.posexplode("forms").alias("idx", "form"), F.lit(None).cast("string").alias("lemma"), F.lit(None).cast("string").alias("pos"))
    lengths = sorted(r.k for r in entries.select("k").distinct().collect())
    if not lengths:
        return tokens.select("sent_id", F.col("idx").alias("first_idx"), F.col("idx").alias("last_idx"), "form", "lemma", "pos").limit(0)
    order = Window.partitionBy("sent_id").orderBy("idx")
    spans = [F.when(F.lead("idx", k - 1).over(order).isNotNull(), F.struct(F.lit(k).alias("k"), F.concat_ws(JOINT, *[F.lead("form", i).over(order) for i in range(k)]).alias("form"))) for k in lengths]
    grams = tokens.select("sent_id", "idx", F.array_compact(F.array(*spans)).alias("gs")).select("sent_id", "idx", F.explode("gs").alias("g")).select("sent_id", "idx", "g.k", "g.form")
    hits = grams.join(entries, ["form", "k"])
    one = F.struct("idx", (-F.col("k")).alias("minus_k"), "form", "lemma", "pos")
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<idx:int,minus_k:int,form:string,lemma:string,pos:string>>").alias("kept"))

    def step(state: Column, hit: Column) -> Column:
        taken = F.struct((hit["idx"] - hit["minus_k"]).alias("end"), F.concat(state["kept"], F.array(hit)).alias("kept"))
        return F.when(hit["idx"] >= state["end"], taken).otherwise(state)

    kept = hits.groupBy("sent_id").agg(F.array_sort(F.collect_list(one)).alias("hits")).select("sent_id", F.explode(F.aggregate("hits", start, step)["kept"]).alias("u"))
    return kept.select("sent_id", F.col("u.idx").alias("first_idx"), (F.col("u.idx") - F.col("u.minus_k") - 1).alias("last_idx"), "u.form", "u.lemma", "u.pos")


def _moved(deps: DataFrame, groups: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Arcs and groups by ``places``: sent_id, idx and to_first, to_last, the new places of its parts.

    Arcs go from and to the first part; those inside one new word go.  Of words that became one, the first that has
    an arc to the outside keeps its arcs.
    """
    end = lambda old, new, part: places.select("sent_id", F.col("idx").alias(old), F.col(part).alias(new))
    moved = deps.join(end("gov", "_gov", "to_first"), ["sent_id", "gov"]).join(end("head", "_head", "to_first"), ["sent_id", "head"]).where("_gov <> _head")
    moved = moved.withColumn("_least", F.min("gov").over(Window.partitionBy("sent_id", "_gov"))).where("gov = _least")
    arcs = moved.select("sent_id", F.col("_gov").alias("gov"), F.col("_head").alias("head"), "label")
    spans = groups.join(end("first_idx", "_first", "to_first"), ["sent_id", "first_idx"]).join(end("last_idx", "_last", "to_last"), ["sent_id", "last_idx"])
    return arcs, spans.select("sent_id", "name", F.col("_first").alias("first_idx"), F.col("_last").alias("last_idx")).distinct()


def merged(tokens: DataFrame, deps: DataFrame, groups: DataFrame, lexicon: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words, arcs and groups with each unit of ``lexicon`` as one word that has its form, lemma and pos."""
    units = found_units(tokens, lexicon)
    covered = units.select("sent_id", F.explode(F.sequence("first_idx", "last_idx")).alias("idx"), F.struct("first_idx", "form", "lemma", "pos").alias("_unit"))
    joined = tokens.select("sent_id", "idx", "form", "lemma", "pos").join(covered, ["sent_id", "idx"], "left")
    begins = F.col("_unit").isNull() | (F.col("_unit.first_idx") == F.col("idx"))
    order = Window.partitionBy("sent_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    placed = joined.withColumn("_new", (F.sum(begins.cast("int")).over(order) - 1).cast("int"))
    of = lambda c: F.when(F.col("_unit").isNotNull(), F.col(f"_unit.{c}")).otherwise(F.col(c)).alias(c)
    words = placed.where(begins).select("sent_id", F.col("_new").alias("idx"), of("form"), of("lemma"), of("pos"))
    return words, *_moved(deps, groups, placed.select("sent_id", "idx", F.col("_new").alias("to_first"), F.col("_new").alias("to_last")))


def cut(tokens: DataFrame, deps: DataFrame, groups: DataFrame, parts: Column, pos: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words, arcs and groups with each word replaced by its ``parts``, an array of forms.

    A part that differs from the word is its own lemma; parts after the first have ``pos``, or else the
    word's.  A word without parts goes, with its arcs; groups that begin or end with it end at the
    nearest word left, and go with their last word.
    """
    spread = tokens.select("sent_id", "idx", "form", "lemma", "pos", parts.alias("_parts"))
    spread = spread.select("*", F.posexplode_outer("_parts").alias("_at", "_part"))
    order = Window.partitionBy("sent_id").orderBy("idx", "_at")
    there = F.col("_part").isNotNull()
    spread = spread.withColumn("_new", (F.sum(there.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    words = spread.where(there).select(
        "sent_id", F.col("_new").alias("idx"), F.col("_part").alias("form"),
        F.when(F.col("_part") == F.col("form"), F.col("lemma")).otherwise(F.col("_part")).alias("lemma"),
        (F.when(F.col("_at") == 0, F.col("pos")).otherwise(pos) if pos is not None else F.col("pos")).alias("pos"),
    )
    places = spread.groupBy("sent_id", "idx").agg(F.min("_new").alias("_low"), F.max("_new").alias("to_last"), F.max(there).alias("_there"))
    places = places.withColumn("to_first", F.when(F.col("_there"), F.col("_low")).otherwise(F.col("_low") + 1))
    arcs, _ = _moved(deps, groups, places.where("_there"))
    _, spans = _moved(deps, groups, places)
    return words, arcs, spans.where("first_idx <= last_idx")


def split(tokens: DataFrame, deps: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words cut at underscores; the parts after the first have the tag ``unk``."""
    pieces = F.filter(F.split("form", JOINT), lambda x: x != "")
    return cut(tokens, deps, groups, F.when(F.size(pieces) > 0, pieces).otherwise(F.array("form")), F.lit("unk"))


def retokenized_parts(form: Column) -> Column:
    """The parts of a form in ``retokenized``."""
    return F.regexp_extract_all(F.translate(form, "_()*", " "), F.lit("(aujourd'hui|[^ ']*'|[^ ']+)"))


def retokenized(tokens: DataFrame, deps: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words without brackets and asterisks, cut at underscores and after apostrophes (but for ``aujourd'hui``);
    what is empty then goes.
    """
    return cut(tokens, deps, groups, retokenized_parts(F.col("form")))
