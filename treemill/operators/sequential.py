"""Rewriting in place: rules are tried word by word, and each match sees what earlier ones have changed.

A sentence is one row with arrays of its words, heads and labels.  A rule is an ordered fold over the
words: at each one its tests are evaluated on the arrays as they are then, and its actions make the
arrays that the next word sees.  The next rule starts from what the last one left.  All of it is one
expression of Spark's SQL, so nothing leaves the JVM and no sentence meets another.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treemill.operators.forest import with_heads

FIELDS = ("form", "lemma", "pos")
STATE = "struct<head: array<int>, label: array<string>>"


@dataclass(frozen=True)
class Rule:
    """One rule of a program, in SQL over the structs ``w0`` and ``w1``: idx, form, lemma, pos, head (-1: none),
    label, head_form, head_lemma, head_pos.

    ``when`` is tested on every word w0, first to last.  With ``other``, w1 is the first other word that meets
    it (a test of w0 and w1); without such a word nothing happens.  ``drop`` names words whose arc goes,
    then ``attach`` gives arcs (word, head, label as SQL); a head below 0 gives none, and a
    label that starts with ``_`` is never replaced.
    """

    when: str = "true"
    other: str | None = None
    drop: tuple[str, ...] = ()
    attach: tuple[tuple[str, str, str], ...] = ()


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _word(state: str, idx: str) -> str:
    own = "".join(f", '{c}', get(_words, {idx}).{c}" for c in FIELDS)
    over = "".join(f", 'head_{c}', CASE WHEN get({state}.head, {idx}) >= 0 THEN get(_words, get({state}.head, {idx})).{c} END" for c in FIELDS)
    return f"named_struct('idx', {idx}, 'head', get({state}.head, {idx}), 'label', get({state}.label, {idx}){own}{over})"


def _set(state: str, idx: str, head: str, label: str) -> str:
    """``state`` with one word's arc replaced, unless its label is a fixed one."""
    free = f"k = ({idx}) AND NOT coalesce(startswith(get({state}.label, k), '_'), false)"
    heads = f"transform({state}.head, (h, k) -> CASE WHEN {free} THEN CAST({head} AS INT) ELSE h END)"
    labels = f"transform({state}.label, (l, k) -> CASE WHEN {free} THEN CAST({label} AS STRING) ELSE l END)"
    return f"CAST(named_struct('head', {heads}, 'label', {labels}) AS {STATE})"


def _fold(rule: Rule, state: str) -> str:
    made, names = "s0", ["s0"]
    steps: list[tuple[str, str]] = []

    def then(value: str) -> None:
        nonlocal made
        made = f"s{len(names)}"
        names.append(made)
        steps.append((made, value))

    for word in rule.drop:
        then(_set(made, f"{word}.idx", "-1", "CAST(NULL AS STRING)"))
    for word, head, label in rule.attach:
        then(f"CASE WHEN ({head}) >= 0 AND ({head}) < size(_words) THEN {_set(made, word, head, label)} ELSE {made} END")
    body = made
    for name, value in reversed(steps):
        body = _let(name, value, body)
    if rule.other is not None:
        # a sentence's words are few: all of them are tried, and the first that fits is w1
        fits = f"filter(transform(sequence(0, size(_words) - 1), j -> {_word('s0', 'j')}), w1 -> w1.idx <> w0.idx AND ({rule.other}))"
        body = _let("w1", f"get({fits}, 0)", f"CASE WHEN w1 IS NULL THEN s0 ELSE {body} END")
    body = _let("w0", _word("s0", "i"), f"CASE WHEN {rule.when} THEN {body} ELSE s0 END")
    return f"aggregate(sequence(0, size(_words) - 1), {state}, (s0, i) -> {body})"


def rewritten(tokens: DataFrame, program: list[Rule], deps: DataFrame | None = None) -> DataFrame:
    """sent_id, idx, head (-1: none) and label of every word after all rules of ``program``, in turn.

    The first arc of each word is rewritten.  Words with no arc have no label; an arc whose head is no word of the
    sentence counts as none.
    """
    words = with_heads(tokens, deps)
    rows = words.groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("idx", *FIELDS, "head", "label"))).alias("_words"))
    known = "transform(_words, w -> w.head >= 0 AND w.head < size(_words))"
    start = f"CAST(named_struct('head', transform(_words, (w, k) -> CASE WHEN get({known}, k) THEN CAST(w.head AS INT) ELSE -1 END), 'label', transform(_words, (w, k) -> CASE WHEN get({known}, k) THEN w.label END)) AS {STATE})"
    found = rows.withColumn("_state", F.expr(start))
    for n, rule in enumerate(program):
        found = found.withColumn(f"_state{n}", F.expr(_fold(rule, "_state"))).drop("_state").withColumnRenamed(f"_state{n}", "_state")
    zipped = F.arrays_zip(F.col("_state.head").alias("head"), F.col("_state.label").alias("label"))
    return found.select("sent_id", F.posexplode(zipped).alias("idx", "_arc")).select("sent_id", "idx", "_arc.head", "_arc.label")
