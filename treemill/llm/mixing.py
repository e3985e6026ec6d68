"""Mixing sources to target weights by a low-discrepancy schedule.

Each source of the mix is a stream: its documents end to end in a hashed order, begun again at the
end, up to its target.  The stream is cut into blocks of equal words, at least a thousand of them (one
word each in small sources) and of ``BLOCK`` words at most; only the last one is shorter.  A slot of the mix
holds one block.  The golden-ratio point ``frac((i + 1) * phi)`` of slot ``i`` falls into one source's
share of [0, 1), so every stretch of slots is near the weights; the n-th slot of a source takes its
n-th block.  What a document is taken is what the slots hold of it.

Ranks and running sums are made in two levels (within a bounded bucket or a range, then over
these), so no source, and no list of sources, has to fit into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treemill.llm.common import WORD, bounded_batches, documents, settle, stored

WEIGHTS = (5, 2, 1)
#: Words to take, as a share of all words, and at most from a source, as a share of its words.
TOTAL, MOST = 1.5, 2
#: Largest block in words; slots that a source's share is made for, at least.
BLOCK, SLOTS = 4096, 1000
#: Slots beyond the sum of the shares, so that each source finds all of its own.
SPARE = 0.02
#: Rows of the buckets in which ranks and running sums are made.
BUCKET = 4096
#: Sources up to which their table is broadcast; beyond it is joined by a shuffle.
FEW = 10_000
#: Points are whole numbers of 1 / 2**BITS; the golden ratio as such a number.
BITS = 52
PHI = 0x9E3779B97F4A7
#: Words of a part of the mixed texts.
PART = 1 << 21


def sized(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, source and size, the number of words (null: 0)."""
    return docs.select(*more, "doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def running(df: DataFrame, order: Sequence[Column], **sums: Column) -> DataFrame:
    """``df`` with sums over the rows up to each one in ``order``: within ranges, then over these."""
    dealt = settle(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = totals.select("_part", *[F.coalesce(F.sum(n).over(parts), F.lit(0)).alias(f"_before_{n}") for n in sums])
    found = dealt.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}).join(F.broadcast(before), "_part")
    return found.select(*df.columns, *[(F.col(n) + F.col(f"_before_{n}")).alias(n) for n in sums])


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """A row per source: source, number, source_size, target, words (the target, rounded), block,
    slots, share (slots of its share) and high (shares up to its own).

    Sources by code point, null last, get the weights in turn.  A target above ``most`` times the
    source's size stops there; what is left over goes to the others by weight.  This ends with
    ``min(cap, level * weight)``: sources fill up in the order of cap / weight, so the level
    follows from running sums.
    """
    found = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running(found, [F.col("source").isNull(), F.col("source").cast("binary")], number=F.lit(1)).withColumn("number", F.col("number") - 1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.col("number") % len(weights) + 1).cast("int"))).withColumn("cap", most * F.col("source_size").cast("double"))
    filled = settle(running(ranked, [F.col("cap") / F.col("weight"), F.col("number")], full=F.col("cap"), lighter=F.col("weight")))
    everything, heavy = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(total * (everything or 0)) - (F.col("full") - F.col("cap"))) / (F.lit(float(heavy or 0)) - F.col("lighter") + F.col("weight"))
    # the level at the first source that it does not fill; later ones come out lower
    level = filled.agg(F.max(F.when(level * F.col("weight") <= F.col("cap"), level))).first()[0]
    target = F.col("cap") if level is None else F.least("cap", F.lit(level) * F.col("weight"))
    ready = filled.select("source", "number", "source_size", target.alias("target")).withColumn("words", F.round("target").cast("long"))
    ready = ready.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.expr(f"words div {SLOTS}"))).cast("long"))
    ready = ready.withColumn("slots", F.expr("(words + block - 1) div block")).withColumn("share", F.when(F.col("words") > 0, F.greatest("slots", F.lit(SLOTS))).otherwise(0))
    return running(ready, [F.col("number")], high=F.col("share"))


def laid_out(rows: DataFrame, n_rows: int, seed: int) -> DataFrame:
    """``rows`` with ``start``: words before each in its source's order.

    The order is by a hash of doc_id; equal hashes by doc_id, then size, so reruns agree.
    """
    buckets = max(1, n_rows // BUCKET)
    keyed = rows.withColumn("_key", F.xxhash64(F.lit(seed), "doc_id")).withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "size"), F.lit(buckets)))
    before = keyed.groupBy("number", "_bucket").agg(F.sum("size").alias("words"))
    before = before.select("number", "_bucket", (F.sum("words").over(Window.partitionBy("number").orderBy("_bucket")) - F.col("words")).alias("_before"))
    inside = Window.partitionBy("number", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    summed = keyed.withColumn("_inside", F.sum("size").over(inside) - F.col("size"))
    return summed.join(before, ["number", "_bucket"]).select(*rows.columns, (F.col("_before") + F.col("_inside")).alias("start"))


def point(slot: Column) -> Column:
    """The golden-ratio point of a slot (below 2**44) in units of 1 / 2**BITS, exact."""
    n, unit = slot + 1, (1 << BITS) - 1
    parts = [F.shiftright(n, 11 * k).bitwiseAND(F.lit(2047)) * F.lit((PHI << 11 * k) & unit) for k in range(4)]
    return sum((p.bitwiseAND(F.lit(unit)) for p in parts[1:]), parts[0].bitwiseAND(F.lit(unit))).bitwiseAND(F.lit(unit))


def schedule(spark: SparkSession, sources: DataFrame, n_sources: int, shares: int) -> DataFrame:
    """slot, number (of the source) and rank, the slot's place among those of its source.

    A source of fewer slots than its share (``SLOTS`` at least) has them evenly among its points;
    one that has all its slots is passed over.
    """
    cells = max(12, n_sources.bit_length() + 1)
    edge = lambda c: F.floor(c / F.lit(float(max(shares, 1))) * F.lit(float(1 << BITS)))
    spans = sources.where("share > 0").select("number", "slots", "share", edge(F.col("high") - F.col("share")).alias("_low"), edge(F.col("high")).alias("_high"))
    spans = spans.withColumn("_cell", F.explode(F.sequence(F.shiftright("_low", BITS - cells), F.shiftright(F.col("_high") - 1, BITS - cells))))
    placed = spark.range(int(shares * (1 + SPARE)) + 64 if shares else 0).select(F.col("id").alias("slot"), point(F.col("id")).alias("_point"), F.shiftright("id", 14).alias("_run"))
    placed = placed.withColumn("_cell", F.shiftright("_point", BITS - cells))
    found = placed.join(F.broadcast(spans) if n_sources <= FEW else spans, "_cell").where("_point >= _low and _point < _high").select("slot", "_run", "number", "slots", "share")
    runs = found.groupBy("number", "_run").agg(F.count("*").alias("n"))
    runs = runs.select("number", "_run", (F.sum("n").over(Window.partitionBy("number").orderBy("_run")) - F.col("n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("number", "_run").orderBy("slot")) - 1
    ranked = found.withColumn("_inside", inside).join(runs, ["number", "_run"]).select("slot", "number", "slots", "share", (F.col("_before") + F.col("_inside")).alias("n"))
    thinned = ranked.where((F.col("slots") == F.col("share")) | F.expr("(n + 1) * slots div share > n * slots div share")) if n_sources else ranked
    rank = F.when(F.col("slots") == F.col("share"), F.col("n")).otherwise(F.expr("n * slots div share"))
    return thinned.select("slot", "number", rank.alias("rank"), "slots").where("rank < slots").select("slot", "number", "rank")


def scheduled(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST, seed: int = 11, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The documents, and the pieces that the slots hold of them.

    Documents: a row per row of ``docs``: row, ``key``, doc_id, source, size, source_size, target, number,
    start (its place in its source's order).  Pieces: slot, row, ``key``, first and words: so many
    words of the document, from that one on (counted from 0).
    """
    spark = docs.sparkSession
    keys = [] if key == "doc_id" else [key]
    rows = settle(sized(docs, *keys))
    sources = settle(source_targets(rows, weights, total, most))
    n_rows, (n_sources, shares) = rows.count(), sources.agg(F.count("*"), F.max("high")).first()
    known = sources.select(F.col("source").alias("_source"), "number", "source_size", "target", F.col("words").alias("wanted"), "block")
    known = F.broadcast(known) if n_sources <= FEW else known
    numbered = rows.join(known, rows["source"].eqNullSafe(known["_source"])).drop("_source")
    spots = settle(laid_out(numbered, n_rows, seed).withColumn("row", F.monotonically_increasing_id()))
    turns = spots.where("size > 0 and start < wanted").withColumn("_turn", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(wanted - start - 1) div source_size"))))
    turns = turns.withColumn("_from", F.col("start") + F.col("_turn") * F.col("source_size")).withColumn("_to", F.least(F.col("_from") + F.col("size"), "wanted"))
    cut = turns.withColumn("rank", F.explode(F.expr("sequence(_from div block, (_to - 1) div block)")))
    begin = F.greatest("_from", F.col("rank") * F.col("block"))
    cut = cut.select("number", "rank", "row", *keys, (begin - F.col("_from")).alias("first"), (F.least("_to", (F.col("rank") + 1) * F.col("block")) - begin).alias("words"))
    return spots, schedule(spark, sources, n_sources, shares or 0).join(cut, ["number", "rank"]).select("slot", "row", *keys, "first", "words")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST, seed: int = 11) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, start.

    ``taken`` counts the words that the slots hold of the document, repeats included; a source's
    add up to its target, rounded; ``start`` is its place in its source's order.  Null and empty texts have
    no words and are taken 0 times; long texts are cut where a block ends; a null source is a source
    of its own; repeated rows and rows of equal doc_ids are each laid out (those of equal size in any order,
    which gives the same rows).  A corpus without words gives targets of 0.  Any type of doc_id will do.
    """
    spots, pieces = scheduled(docs, weights, total, most, seed)
    taken = pieces.groupBy("row").agg(F.sum("words").alias("_taken")).withColumnRenamed("row", "_row")
    found = spots.join(taken, spots["row"] == taken["_row"], "left")
    return found.select("doc_id", "source", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"), "start")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def cut_out(text: str, pieces: list[tuple[int, int]]) -> list[str]:
    """The parts of a text that begin at a word's number and have so many words, as they stand there;
    a part of all words is the whole text.
    """
    data = text.encode()
    raw = np.frombuffer(data, np.uint8)
    inside = (raw != 32) & ((raw < 9) | (raw > 13))
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    begins, ends = edges[::2], edges[1::2]
    return [text if words == len(begins) else data[begins[first] : ends[first + words - 1]].decode() for first, words in pieces]


def mixed_texts(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST, seed: int = 11) -> DataFrame:
    """The mix itself: a row for each piece of a document that a slot holds, in the order of slots.

    A piece has the words of its document as they stand there; a document inside one block stays as
    it is, longer ones are cut where blocks end, and a source that is taken twice comes twice.  All
    columns stay; ``n_chars`` follows the text.  Rows without words are in no slot; ties, nulls and repeated rows as
    in ``mix``.  ``docs`` is written once, with the number of each row, as repeated or null doc_ids can't be joined.
    """
    bounded_batches(docs.sparkSession)
    names = docs.columns
    kept = stored(docs.withColumn("_row", F.monotonically_increasing_id()))
    _, pieces = scheduled(kept, weights, total, most, seed, key="_row")
    pieces = settle(pieces)
    words, last = pieces.agg(F.sum("words"), F.max("slot")).first()
    plan = pieces.groupBy(F.col("_row").alias("_of")).agg(F.sort_array(F.collect_list(F.struct("slot", "first", "words"))).alias("_pieces"))
    found = kept.join(plan.hint("shuffle_hash"), kept["_row"] == plan["_of"])

    @F.pandas_udf("array<string>")
    def texts(text: pd.Series, first: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([cut_out(t, list(zip(f, w, strict=True))) for t, f, w in zip(text, first, words, strict=True)], dtype=object)

    cut = found.withColumn("_texts", texts("text", "_pieces.first", "_pieces.words")).drop("text")
    cut = cut.select(*[F.col(c) for c in names if c != "text"], F.explode(F.arrays_zip(F.col("_pieces.slot").alias("slot"), F.col("_pieces.first").alias("first"), F.col("_texts").alias("text"))).alias("_piece"))
    cut = cut.withColumn("text", F.col("_piece.text"))
    if "n_chars" in names:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    parts = max(1, (words or 0) // PART)
    dealt = cut.repartitionById(parts, F.floor(F.col("_piece.slot") * parts / ((last or 0) + 1)).cast("int"))
    return dealt.sortWithinPartitions("_piece.slot", "doc_id", "_piece.first").select(*names)
