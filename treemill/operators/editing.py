"""Editing corpora by sentences: joining, splitting, drawing and filtering them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treemill.sources.corpora import Corpus


def joined(corpus: Corpus, target: DataFrame) -> Corpus:
    """Sentences put together: ``target`` has sent_id and into, the sentence that each becomes part of.

    Parts follow each other by sent_id; words, arcs and groups are numbered on.  Sentences that ``target`` doesn't
    have stay as they are.
    """
    sizes = corpus.tokens.groupBy("sent_id").agg((F.max("idx") + 1).alias("_n")).join(target, "sent_id", "left").withColumn("into", F.coalesce("into", "sent_id"))
    order = Window.partitionBy("into").orderBy("sent_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("sent_id"), "into", F.coalesce(F.sum("_n").over(order), F.lit(0)).cast("int").alias("_by"))

    def moved(df: DataFrame, *places: str) -> DataFrame:
        found = df.join(offsets, "sent_id")
        return found.withColumns({p: F.col(p) + F.col("_by") for p in places}).withColumn("sent_id", F.col("into")).select(*df.columns)

    return Corpus(moved(corpus.tokens, "idx"), moved(corpus.deps, "gov", "head"), moved(corpus.roles, "gov", "head"), moved(corpus.groups, "first_idx", "last_idx"))


def parted(df: DataFrame, most: int, first: str, *rest: str) -> DataFrame:
    """Rows of sentences that are cut before the words in ``_cuts`` (an array, in order; ``most`` parts at most): their places
    and sentences numbered anew, without what lies across a cut.
    """
    part = lambda p: F.size(F.filter("_cuts", lambda c: c <= F.col(p)))
    found = df.withColumn("_part", part(first)).where(" and ".join(["true", *[f"size(filter(_cuts, c -> c <= {p})) = _part" for p in rest]]))
    begin = F.when(F.col("_part") > 0, F.get("_cuts", F.col("_part") - 1)).otherwise(0)
    found = found.withColumn("_from", begin)
    return found.withColumns({p: F.col(p) - F.col("_from") for p in (first, *rest)}).withColumn("sent_id", F.col("sent_id") * most + F.col("_part")).drop("_part", "_from", "_cuts")


def split_at(corpus: Corpus, places: DataFrame) -> Corpus:
    """Sentences cut before the words in ``places`` (sent_id, idx); arcs and groups across a cut go.

    The sentences are numbered anew: each gets as many numbers as the one with most parts has.
    """
    cuts = places.where("idx > 0").groupBy("sent_id").agg(F.sort_array(F.collect_set("idx")).alias("_cuts"))
    most = (cuts.agg(F.max(F.size("_cuts"))).first()[0] or 0) + 1
    none = F.array().cast("array<int>")

    def moved(df: DataFrame, first: str, *rest: str) -> DataFrame:
        return parted(df.join(cuts, "sent_id", "left").withColumn("_cuts", F.coalesce("_cuts", none)), most, first, *rest)

    return Corpus(moved(corpus.tokens, "idx"), moved(corpus.deps, "gov", "head"), moved(corpus.roles, "gov", "head"), moved(corpus.groups, "first_idx", "last_idx"))


def only(corpus: Corpus, sentences: DataFrame, inside: bool = True) -> Corpus:
    """The sentences in (or not in) ``sentences``."""
    wanted = sentences.select("sent_id").distinct()
    return corpus.each(lambda df: df.join(wanted, "sent_id", "left_semi" if inside else "left_anti"))


def drawn(sentences: DataFrame, share: float, seed: int = 1) -> DataFrame:
    """sent_id of an exact share (rounded) of the sentences, drawn by a hash: the same ones in each run.

    The border between drawn and not drawn is found by counts in cells of the hash, so nothing is sorted as a whole.
    """
    hashed = sentences.select("sent_id").distinct().withColumn("_h", F.xxhash64(F.lit(seed), "sent_id"))
    cells = hashed.groupBy(F.shiftright("_h", 52).alias("_cell")).agg(F.count("*").alias("_n"))
    order = Window.orderBy("_cell")
    cells = cells.select("_cell", (F.sum("_n").over(order) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    ranked = hashed.withColumn("_cell", F.shiftright("_h", 52)).withColumn("_r", F.row_number().over(Window.partitionBy("_cell").orderBy("_h", "sent_id")))
    return ranked.join(F.broadcast(cells), "_cell").where(F.col("_before") + F.col("_r") <= F.round(F.col("_all") * share)).select("sent_id")


def shuffled(corpus: Corpus, seed: int = 1) -> Corpus:
    """Sentences in a random order: their numbers are dealt out anew among them, the same way in each run."""
    known = corpus.tokens.select("sent_id").distinct()
    keyed = known.withColumn("_h", F.xxhash64(F.lit(seed), "sent_id"))
    old = _ranked(known, "sent_id").withColumnRenamed("sent_id", "_new")
    place = _ranked(keyed, "_h").join(old, "_rank").select("sent_id", "_new")
    return corpus.each(lambda df: df.join(place, "sent_id").withColumn("sent_id", F.col("_new")).select(*df.columns))


def _ranked(df: DataFrame, column: str) -> DataFrame:
    from treemill.operators.running import summed_before

    return summed_before(df, column, _rank=F.lit(1)).select("sent_id", "_rank")


def with_words(tokens: DataFrame, words: list[str], least: int = 1) -> DataFrame:
    """sent_id of sentences that have ``least`` of the words (lemmas, in lower case) or more, each counted once."""
    found = tokens.where(F.lower("lemma").isin([w.lower() for w in words])).groupBy("sent_id").agg(F.count_distinct(F.lower("lemma")).alias("n"))
    return found.where(F.col("n") >= least).select("sent_id")


def with_notes(notes: DataFrame, test: Column, after: int | None = None) -> DataFrame:
    """sent_id of sentences whose note meets a test; with ``after`` only the next one behind that sentence."""
    found = notes.where(test)
    if after is None:
        return found.select("sent_id")
    return found.where(F.col("sent_id") > after).agg(F.min("sent_id").alias("sent_id")).where("sent_id is not null")
