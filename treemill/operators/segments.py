"""Two segmentations of the same texts, joined by the places of their words.

Words carry doc, begin and end (code points, end exclusive).  Overlaps are found by an equi-join: each
word is in the cells of ``CELL`` characters that it touches, and a pair is looked at in one cell only, the
one where the later of its words begins.  So no sentence, and no word, meets a whole document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treemill.operators.forest import per_sentence

#: Characters of a cell.
CELL = 64


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of words of a and b that share characters: doc, the other columns with ``_a`` or ``_b``, and
    shared, the number of these characters.  Words of no length pair with none.
    """

    def celled(df: DataFrame, side: str) -> DataFrame:
        cells = F.sequence(F.floor(F.col("begin") / CELL), F.floor((F.col("end") - 1) / CELL))
        names = [F.col(c).alias(f"{c}_{side}") for c in df.columns if c != "doc"]
        return df.where("end > begin").select("doc", F.explode(cells).alias("_cell"), *names)

    later = F.greatest("begin_a", "begin_b")
    shared = F.least("end_a", "end_b") - later
    met = celled(a, "a").join(celled(b, "b"), ["doc", "_cell"]).where((shared > 0) & (F.col("_cell") == F.floor(later / CELL)))
    return met.withColumn("shared", shared).drop("_cell")


def overlaps_in(docs: DataFrame, a: Callable[[str], tuple], b: Callable[[str], tuple], schema: str) -> DataFrame:
    """``overlaps`` where the whole document (doc and text) is one row: doc, the columns of ``schema`` for a's and b's words,
    and shared.  ``a`` and ``b`` give begins, ends and the arrays of these columns for the words of a text, in their order; words of
    one segmentation share nothing.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    whole = f"doc long, {schema}, shared int"
    arrow = to_arrow_schema(_parse_datatype_string(whole))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                (a_begin, a_end, *ours), (b_begin, b_end, *theirs) = a(text), b(text)
                first, last = np.searchsorted(b_end, a_begin, "right"), np.searchsorted(b_begin, a_end, "left")
                met = np.maximum(last - first, 0)
                i = np.repeat(np.arange(len(met)), met)
                j = np.arange(len(i)) + np.repeat(first - np.cumsum(met) + met, met)
                shared = np.minimum(a_end[i], b_end[j]) - np.maximum(a_begin[i], b_begin[j])
                columns = [np.full(len(i), doc), *[c[i] for c in ours], *[c[j] for c in theirs], shared]
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.mapInArrow(run, whole)


def resegmented(a: DataFrame, b: DataFrame) -> DataFrame:
    """The words of b in the sentences of a: sent_id, idx (from 0) and the columns of b.

    A sentence (sent_id of a) gets the words of b, numbered ``n`` in each doc, from the first to the last one that overlaps
    with it, those between included.  Sentences that nothing overlaps with have no row.
    """
    met = overlaps(a.select("doc", "sent_id", "begin", "end"), b.select("doc", "n", "begin", "end"))
    spans = met.groupBy("doc", F.col("sent_id_a").alias("sent_id")).agg(F.min("n_b").alias("_first"), F.max("n_b").alias("_last"))
    wanted = spans.select("doc", "sent_id", "_first", F.explode(F.sequence("_first", "_last")).alias("n"))
    return wanted.join(b, ["doc", "n"]).withColumn("idx", (F.col("n") - F.col("_first")).cast("int")).drop("_first")


def ranges(docs: DataFrame) -> DataFrame:
    """sent_id, first and last: the words ``n`` of b that ``resegmented`` gives each sentence, where the whole document is one row.

    ``docs`` have doc, base (the first sent_id), counts (words of a in each sentence) and for a and b the lengths of the
    pieces that cover the text, as ``a`` and ``b``; those below zero are gaps.
    """

    def places(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
        at = np.asarray(lengths, np.int64)
        end = np.cumsum(np.abs(at))
        return (end - np.abs(at))[at > 0], end[at > 0]

    def one(base, counts, a, b):
        (a_begin, a_end), (b_begin, b_end) = places(a), places(b)
        first, last = np.searchsorted(b_end, a_begin, "right"), np.searchsorted(b_begin, a_end, "left") - 1
        met = first <= last
        starts = np.cumsum(counts) - counts
        low = np.minimum.reduceat(np.where(met, first, len(b_end)), starts)
        high = np.maximum.reduceat(np.where(met, last, -1), starts)
        return [(base + k, int(x), int(y)) for k, (x, y) in enumerate(zip(low, high, strict=True)) if x <= y]

    return per_sentence(docs.where("size(counts) > 0").select("base", "counts", "a", "b"), one, "sent_id long, first long, last long")


def carried_arcs(deps: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Arcs of a's words on the words of ``resegmented``: each end goes to the word of b that shares most characters with
    it, the first of equals; arcs inside one word go.
    """
    words = resegmented(a, b).select("doc", "sent_id", F.col("idx").alias("idx_new"), "begin", "end")
    met = overlaps(a.select("doc", "sent_id", "idx", "begin", "end"), words).where("sent_id_a = sent_id_b")
    best = met.groupBy(F.col("sent_id_a").alias("sent_id"), "idx_a").agg(F.min(F.struct(-F.col("shared"), F.col("idx_new_b").alias("to")))["to"].alias("to"))
    end = lambda n: best.select("sent_id", F.col("idx_a").alias(n), F.col("to").alias(f"_{n}"))
    moved = deps.join(end("gov"), ["sent_id", "gov"]).join(end("head"), ["sent_id", "head"]).where("_gov <> _head")
    return moved.select("sent_id", F.col("_gov").alias("gov"), F.col("_head").alias("head"), "label")
