"""Searching dependency graphs: triplets, constraints and match modes as joins and windows.

A triplet is a dependent with its head and label.  A word without an arc has no head and the label
``ROOT``; tests on the head hold for it.  Triplets of one search are joined within the sentence,
no word is bound twice, and all conditions are plain columns, so they reach the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROOT = "ROOT"


def full(column: str | Column, pattern: str) -> Column:
    """Whether the whole string matches a pattern."""
    return (F.col(column) if isinstance(column, str) else column).rlike(f"^(?:{pattern})$")


@dataclass(frozen=True)
class Triplet:
    """Tests of one triplet: SQL conditions on form, lemma, pos of the dependent, on the same of
    the head (named head_form ...), and the labels wanted or, with ``others``, not wanted.
    """

    dep: str = "true"
    head: str = "true"
    labels: tuple[str, ...] = ()
    others: bool = False


def first_arcs(deps: DataFrame) -> DataFrame:
    """The first arc of each word; ``dep_ord`` tells the order where there is one."""
    if "dep_ord" not in deps.columns:
        return deps
    order = Window.partitionBy("sent_id", "gov").orderBy("dep_ord")
    return deps.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def linked(tokens: DataFrame, deps: DataFrame, columns: tuple[str, ...] = ("form", "lemma", "pos")) -> DataFrame:
    """Words with their first arc and the head's columns; head -1 and label ROOT if there is none."""
    heads = tokens.select("sent_id", F.col("idx").alias("head"), *[F.col(c).alias(f"head_{c}") for c in columns])
    found = tokens.join(first_arcs(deps).select("sent_id", F.col("gov").alias("idx"), "head", "label"), ["sent_id", "idx"], "left").join(heads, ["sent_id", "head"], "left")
    return found.select("sent_id", "idx", *columns, F.coalesce("head", F.lit(-1)).alias("head"), F.coalesce("label", F.lit(ROOT)).alias("label"), *[f"head_{c}" for c in columns])


#: What ``enriched`` adds to words; tests of a search may use it, and its condition with the triplet's number.
ADDED = ("children", "size", "root", "starts", "inside", "note")


def enriched(words: DataFrame, groups: DataFrame | None = None, notes: DataFrame | None = None) -> DataFrame:
    """``words`` (with head and label) for searches that ask for more than the word: children (the number of arcs into it),
    size (words of its sentence), root (of its tree; null in a cycle), starts and inside (names of the groups that begin
    with it and that it is in) and note (of its sentence; null without ``notes``, which has sent_id and note).
    """
    from treemill.operators.forest import measures

    if "heads" in words.columns:
        return _enriched_rows(words)
    counts = words.where("head >= 0").groupBy("sent_id", F.col("head").alias("idx")).agg(F.count("*").cast("int").alias("children"))
    found = words.join(counts, ["sent_id", "idx"], "left").withColumn("children", F.coalesce("children", F.lit(0)))
    found = found.join(words.groupBy("sent_id").agg(F.count("*").cast("int").alias("size")), "sent_id").join(measures(words).select("sent_id", "idx", "root"), ["sent_id", "idx"])
    none = F.array().cast("array<string>")
    if groups is None:
        found = found.withColumn("starts", none).withColumn("inside", none)
    else:
        spread = groups.select("sent_id", F.explode(F.sequence("first_idx", "last_idx")).alias("idx"), "name", "first_idx")
        named = spread.groupBy("sent_id", "idx").agg(F.collect_set(F.when(F.col("idx") == F.col("first_idx"), F.col("name"))).alias("starts"), F.collect_set("name").alias("inside"))
        found = found.join(named, ["sent_id", "idx"], "left").withColumn("starts", F.coalesce("starts", none)).withColumn("inside", F.coalesce("inside", none))
    return found.withColumn("note", F.lit(None).cast("string")) if notes is None else found.join(notes.select("sent_id", "note"), "sent_id", "left")


def _enriched_rows(rows: DataFrame) -> DataFrame:
    """``enriched`` for rows of sentences: childrens, roots, startss and insides for each word and size; groups are those in
    names, firsts and lasts if there are, and a column note stays.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    from treemill.operators.forest import listed, measured, parts

    grouped = "names" in rows.columns
    kept = [c for c in rows.columns if c not in ("sent_id", "heads", "names", "firsts", "lasts")]
    kinds = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    schema = f"sent_id long, heads array<int>{kinds}, childrens array<int>, roots array<int>, size int, startss array<array<string>>, insides array<array<string>>"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def some(part: pa.RecordBatch) -> pa.RecordBatch:
        sizes = part.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        edges = np.append(0, np.cumsum(sizes))
        heads, base, words = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(edges[:-1], sizes), edges[-1]
        known = (heads >= 0) & (heads < np.repeat(sizes, sizes))
        children = np.bincount((heads + base)[known], minlength=words)
        root = measured(np.where(known, heads, -1), edges[:-1])["root"]
        in_row = lambda values: pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), values)
        if grouped:
            names, (first, last) = part.column(part.num_columns - 3).flatten(), (c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in part.columns[-2:])
            of = np.repeat(edges[:-1], part.column(part.num_columns - 3).value_lengths().to_numpy(zero_copy_only=False))
            long = np.maximum(last - first + 1, 0)
            group = np.repeat(np.arange(len(first)), long)
            inside = np.arange(len(group)) - np.repeat(np.cumsum(long) - long, long) + (first + of)[group]
            starts, insides = listed(first + of, names, words), listed(inside, names.take(pa.array(group)), words)
        else:
            starts = insides = listed(np.zeros(0, np.int64), pa.array([], pa.string()), words)
        more = [in_row(pa.array(children)), in_row(pa.array(root, mask=root < 0)), pa.array(sizes), in_row(starts), in_row(insides)]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*part.columns[: 2 + len(kept)], *more], arrow, strict=True)], schema=arrow)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(some, parts(batch, 1))

    found = rows.select("sent_id", "heads", *kept, *(["names", "firsts", "lasts"] if grouped else [])).mapInArrow(run, schema)
    return found if "note" in kept else found.withColumn("note", F.lit(None).cast("string"))


def bound(words: DataFrame, triplet: Triplet, n: int) -> DataFrame:
    """The words that fit one triplet, as dep<n>, head<n>, rel<n> and the columns form<n> ..."""
    found = words.where(triplet.dep)
    if triplet.head != "true":
        found = found.where((F.col("head") < 0) | F.expr(triplet.head))
    if triplet.labels:
        fits = F.col("label").isin(*triplet.labels)
        found = found.where(~fits if triplet.others else fits)
    return found.select("sent_id", F.col("idx").alias(f"dep{n}"), F.col("head").alias(f"head{n}"), F.col("label").alias(f"rel{n}"), *[F.col(c).alias(f"{c}{n}") for c in ("form", "lemma", "pos", *[c for c in ADDED if c in words.columns])])


def _bound_in(rows: DataFrame, triplet: Triplet, n: int) -> DataFrame:
    """``rows`` (sentences, with arrays and the triplets bound so far) with each word of the sentence that fits a triplet."""
    at = F.col(f"dep{n}")
    of = lambda c, i: F.lower(F.get("forms", i)) if c == "lemma" else F.get(f"{c}s", i)
    own = ["form", "lemma", "pos"] if "forms" in rows.columns else ["pos"]
    more = [c for c in ADDED if f"{c}s" in rows.columns or c in rows.columns]
    found = rows.select("*", F.explode(F.sequence(F.lit(0), F.size("heads") - 1)).alias(f"dep{n}"))
    found = found.withColumns({"idx": at, "head": F.get("heads", at), "label": F.get("labels", at)} | {c: of(c, at) for c in own} | {c: of(c, at) for c in more if f"{c}s" in rows.columns})
    found = found.withColumns({f"head_{c}": of(c, F.col("head")) for c in own}).where(triplet.dep)
    if triplet.head != "true":
        found = found.where((F.col("head") < 0) | F.expr(triplet.head))
    if triplet.labels:
        fits = F.col("label").isin(*triplet.labels)
        found = found.where(~fits if triplet.others else fits)
    kept = {"head": f"head{n}", "label": f"rel{n}"} | {c: f"{c}{n}" for c in [*own, *more]}
    return found.select(*rows.columns, f"dep{n}", *[F.col(c).alias(new) for c, new in kept.items()])


def search(words: DataFrame, triplets: list[Triplet], where: str = "true", mode: str = "all", closest: tuple[str, str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """All bindings of the triplets that meet ``where``, a condition on dep0, head0, rel0, dep1 ...

    ``words`` may be rows of sentences with arrays of heads, labels and tags (and forms, and what ``enriched`` adds); then all
    words of a search are bound in the sentence's row, and nothing is shuffled.  Arrays in ``keep`` stay, for ``between``.

    ``mode="first"`` keeps, for each dep0, the binding with the least (dep1, dep2, ...);
    ``closest=(x, y)`` the one where x is nearest to y, the lesser x first.
    """
    rows = "heads" in words.columns
    found = _bound_in(words, triplets[0], 0) if rows else bound(words, triplets[0], 0)
    for n, triplet in enumerate(triplets[1:], 1):
        apart = F.lit(True)
        for k in range(n):
            apart = apart & (F.col(f"dep{n}") != F.col(f"dep{k}"))
        found = (_bound_in(found, triplet, n) if rows else found.join(bound(words, triplet, n), "sent_id")).where(apart)
    found = found.where(where)
    if rows:
        found = found.drop(*[c for c in words.columns if c != "sent_id" and c not in keep])
    rank = None
    if closest:
        x, y = closest
        rank = [F.abs(F.col(x) - F.col(y)), F.col(x), *[F.col(f"dep{n}") for n in range(1, len(triplets))]]
    elif mode == "first":
        rank = [F.col(f"dep{n}") for n in range(1, len(triplets))]
    if rank:
        best = Window.partitionBy("sent_id", "dep0").orderBy(*rank)
        found = found.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    return found


def between(matches: DataFrame, words: DataFrame | None, x: str, y: str, condition: Column | Callable[[Column], Column], present: bool) -> DataFrame:
    """``matches`` with x < y where some (``present``) or no word strictly between meets a condition.

    Without ``words`` the matches carry their sentence's tags (``search`` with ``keep``) and the condition is a function of a
    tag; then nothing is joined.
    """
    if words is None:
        inside = F.slice("poss", F.col(x) + 2, F.greatest(F.col(y) - F.col(x) - 1, F.lit(0)))
        met = F.coalesce(F.exists(inside, condition), F.lit(False))
        return matches.where(F.col(x) < F.col(y)).where(met if present else ~met).drop("poss")
    inner = words.where(condition).select(F.col("sent_id").alias("_sent"), F.col("idx").alias("_idx"))
    on = (F.col("sent_id") == F.col("_sent")) & (F.col("_idx") > F.col(x)) & (F.col("_idx") < F.col(y))
    return matches.where(F.col(x) < F.col(y)).join(inner, on, "left_semi" if present else "left_anti")


def projecting(matches: DataFrame, words: DataFrame, x: str, y: str) -> DataFrame:
    """``matches`` with x < y where every word strictly between has its head within [x, y]."""
    inner = words.select(F.col("sent_id").alias("_sent"), F.col("idx").alias("_idx"), F.col("head").alias("_head"))
    on = (F.col("sent_id") == F.col("_sent")) & (F.col("_idx") > F.col(x)) & (F.col("_idx") < F.col(y)) & ((F.col("_head") < F.col(x)) | (F.col("_head") > F.col(y)))
    return matches.where(F.col(x) < F.col(y)).join(inner, on, "left_anti")


def in_group(matches: DataFrame, groups: DataFrame, x: str, name: str, inside: bool = True) -> DataFrame:
    """``matches`` whose word x is (not) inside a group of that name."""
    spans = groups.where(F.col("name") == name).select(F.col("sent_id").alias("_sent"), "first_idx", "last_idx")
    on = (F.col("sent_id") == F.col("_sent")) & F.col(x).between(F.col("first_idx"), F.col("last_idx"))
    return matches.join(spans, on, "left_semi" if inside else "left_anti")


def group_starts(words: DataFrame, groups: DataFrame, name: str) -> DataFrame:
    """Words that begin a group of that name."""
    return words.join(groups.where(F.col("name") == name).select("sent_id", F.col("first_idx").alias("idx")), ["sent_id", "idx"], "left_semi")


def child_counts(deps: DataFrame) -> DataFrame:
    """sent_id, idx and the number of arcs into the word."""
    return deps.groupBy("sent_id", F.col("head").alias("idx")).agg(F.count("*").alias("children"))


def several_heads(deps: DataFrame) -> DataFrame:
    """Words with more than one arc."""
    return deps.groupBy("sent_id", "gov").agg(F.count("*").alias("arcs")).where("arcs > 1")


def sequence(tokens: DataFrame, items: list[str]) -> DataFrame:
    """Starts of places where each item equals the form or the tag of the next word in turn."""
    order = Window.partitionBy("sent_id").orderBy("idx")
    found = tokens
    for i in range(len(items)):
        found = found.withColumn(f"_{i}", F.struct(F.lead("form", i).over(order).alias("form"), F.lead("pos", i).over(order).alias("pos")))
    for i, item in enumerate(items):
        found = found.where((F.col(f"_{i}.form") == item) | (F.col(f"_{i}.pos") == item))
    return found.select("sent_id", "idx")


def same_errors(words: DataFrame, edited: DataFrame) -> DataFrame:
    """Arcs like an edited one: equal form, head form, distance and label."""
    key = lambda df: df.withColumn("offset", F.col("head") - F.col("idx"))
    found, wanted = key(words.where("head >= 0")), key(edited.where("head >= 0")).select("form", "head_form", "offset", "label").distinct()
    return found.join(wanted, ["form", "head_form", "offset", "label"], "left_semi").select("sent_id", "idx", "head", "label")
