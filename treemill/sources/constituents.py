"""Nested constituents in XML: words in ``<w>`` elements, spans from the elements around them.

A row is a sentence, cut by Spark's own line reader at ``</SENT>``, so one file is read by many tasks.  Depth is a running
sum over a sentence's tags, and the n-th end at a depth closes the n-th beginning there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treemill.sources.other import in_encoding, numbered, plain

END = "</SENT>"


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute; null where it is missing."""
    pattern = rf'\s{name}="([^"]*)"'
    return F.when(tag.rlike(pattern), plain(F.regexp_extract(tag, pattern, 1)))


def read_constituents(spark: SparkSession, paths: str | list[str], encoding: str = "UTF-8") -> tuple[DataFrame, DataFrame]:
    """Words (sent_id, idx, form, lemma, pos) and groups (sent_id, name, first_idx, last_idx) of files.

    A ``<w compound="yes">`` is no word, its parts are; words without text go; spaces in a word become underscores.  The tag
    is ``cat``, else a ``catint`` that isn't empty, else the last ``cat`` before.  The lemma is its attribute, else
    the form.  Each other element that holds a word is a group named like it; comments, instructions and
    elements that are closed at once are none.  Sentences are numbered in the order of files.
    """
    rows = spark.read.option("lineSep", END).text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"), in_encoding("value", encoding).alias("value"))
    found = rows.where(F.col("value").contains("<SENT")).select("file", F.struct("_block", "_row").alias("_at"), F.regexp_replace("value", r"(?s)^.*<SENT[^>]*>|<!--.*?-->|<\?.*?\?>", "").alias("value"))
    pieces = numbered(found, "_at").select("sent_id", F.posexplode(F.regexp_extract_all("value", F.lit("(<[^>]*>[^<]*)"))).alias("n", "piece"))
    tag, text = F.regexp_extract("piece", "^(<[^>]*>)", 1), F.trim(F.regexp_extract("piece", r"(?s)>\s*(.*?)\s*$", 1))
    tags = pieces.select("sent_id", "n", tag.alias("tag"), text.alias("text")).where("not endswith(tag, '/>')")
    order = Window.partitionBy("sent_id").orderBy("n")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    leaf = F.col("tag").rlike(r"^<w[\s>]")
    word = leaf & ~F.coalesce(attribute(F.col("tag"), "compound") == "yes", F.lit(False)) & (F.col("text") != "")
    tags = tags.withColumn("_word", word).withColumn("_cat", F.when(leaf, attribute(F.col("tag"), "cat")))
    tags = tags.withColumn("_words", F.sum(F.col("_word").cast("int")).over(upto).cast("int")).withColumn("_cat", F.last("_cat", ignorenulls=True).over(upto))
    inner = attribute(F.col("tag"), "catint")
    own = F.when(attribute(F.col("tag"), "cat").isNull() & (F.trim(inner) != ""), F.trim(inner)).otherwise(F.col("_cat"))
    form = F.translate(plain(F.col("text")), " ", "_")
    words = tags.where("_word").select("sent_id", (F.col("_words") - 1).alias("idx"), form.alias("form"), F.coalesce(attribute(F.col("tag"), "lemma"), form).alias("lemma"), own.alias("pos"))
    ends = F.col("tag").startswith("</")
    edges = tags.where(~F.col("tag").rlike(r"^</?w[\s>]")).withColumn("_end", ends)
    edges = edges.withColumn("_depth", F.sum(F.when(F.col("_end"), -1).otherwise(1)).over(upto) + F.col("_end").cast("int"))
    edges = edges.withColumn("_nth", F.row_number().over(Window.partitionBy("sent_id", "_depth", "_end").orderBy("n")))
    name = F.regexp_extract("tag", r"^</?([^\s>]+)", 1)
    pairs = edges.groupBy("sent_id", "_depth", "_nth").agg(
        F.max(F.when(~F.col("_end"), name)).alias("name"), F.max(F.when(F.col("_end"), name)).alias("_closed"),
        F.max(F.when(~F.col("_end"), F.col("_words"))).alias("first_idx"), (F.max(F.when(F.col("_end"), F.col("_words"))) - 1).alias("last_idx"),
    )
    return words, pairs.where("name = _closed and first_idx <= last_idx").select("sent_id", "name", "first_idx", "last_idx")
