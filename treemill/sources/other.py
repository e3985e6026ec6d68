"""Bracketed trees, transcripts and the native XML form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, place: str) -> DataFrame:
    """``rows`` with sent_id, without gaps from 0 in the order of ``file`` and ``place``.

    Places are ranked inside their file; only one row a file is ordered in one task.
    """
    inside = rows.withColumn("_rank", F.dense_rank().over(Window.partitionBy("file").orderBy(place)))
    sizes = inside.groupBy("file").agg(F.max("_rank").alias("_own"))
    before = sizes.select("file", (F.sum("_own").over(Window.orderBy("file")) - F.col("_own")).alias("_before"))
    return inside.join(before, "file").withColumn("sent_id", (F.col("_before") + F.col("_rank") - 1).cast("long")).drop("_rank", "_before")


def brackets(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """sent_id, idx, pos and form of bracketed trees; a leaf is ``(POS word)``.

    A tree begins where a line opens a bracket at depth 0; depth is a running sum in the file.
    """
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = whole.select("file", F.posexplode(F.split("value", "\n")).alias("at", "line")).where(F.trim("line") != "")
    opened = F.length("line") - F.length(F.translate("line", "(", ""))
    closed = F.length("line") - F.length(F.translate("line", ")", ""))
    order = Window.partitionBy("file").orderBy("at")
    before = F.coalesce(F.sum(opened - closed).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    trees = lines.withColumn("before", before)
    trees = trees.withColumn("tree", F.sum(F.when(F.col("before") == 0, 1).otherwise(0)).over(order))
    leaves = trees.select("file", "tree", "at", F.posexplode(F.regexp_extract_all("line", F.lit(r"(\([^ ()]+ [^ ()]+\))"))).alias("i", "leaf"))
    place = F.row_number().over(Window.partitionBy("file", "tree").orderBy("at", "i")) - 1
    return numbered(leaves, "tree").select("sent_id", place.alias("idx"), F.regexp_extract("leaf", r"^\(([^ ]+) ", 1).alias("pos"), F.regexp_extract("leaf", r" ([^ ]+)\)$", 1).alias("form"))


def in_encoding(column: str, encoding: str) -> Column:
    """Text that Spark's reader took as it stands in the file, read in an encoding."""
    return F.col(column) if encoding.upper() in ("UTF-8", "UTF8") else F.decode(F.col(column).cast("binary"), encoding)


def stm(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """The text after ``male>`` of each line that has it."""
    lines = spark.read.text(path).select(in_encoding("value", encoding).alias("value"))
    return lines.where(F.col("value").contains("male>")).select(F.trim(F.regexp_extract("value", "male>(.*)$", 1)).alias("text"))


def trs(spark: SparkSession, path: str) -> DataFrame:
    """Turns of a transcript: lines up to ``</Turn>``, without tags and ``#`` lines."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "</Turn>")).alias("turn", "part"))
    lines = F.filter(F.transform(F.split("part", "\n"), F.trim), lambda x: (x != "") & ~x.startswith("<") & ~x.startswith("#"))
    return whole.select("file", "turn", F.array_join(lines, " ").alias("text")).where("text <> ''")


def escaped(column: str) -> Column:
    """A string for an XML attribute; null is empty."""
    out = F.coalesce(column, F.lit(""))
    for sign, name in (("&", "amp"), ('"', "quot"), ("<", "lt"), (">", "gt")):
        out = F.replace(out, F.lit(sign), F.lit(f"&{name};"))
    return out


def plain(value: Column) -> Column:
    for sign, name in ((">", "gt"), ("<", "lt"), ('"', "quot"), ("&", "amp")):
        value = F.replace(value, F.lit(f"&{name};"), F.lit(sign))
    return value


#: Facts of a sentence in native XML, fixed names: column and element.
FACTS = {"text": "TXT", "comment": "CMT", "conf": "CONF", "source": "SOURCE"}


def xml_lines(tokens: DataFrame, deps: DataFrame, groups: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """sent_id and text: the native XML of each sentence (its facts if given, words, groups, then arcs).

    ``facts`` has sent_id and any of text, comment, conf and source; nulls are left out.
    """
    t = tokens.groupBy("sent_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("idx", F.format_string('<t i="%d" l="%s" f="%s" c="%s"/>', F.col("idx") + 1, escaped("lemma"), escaped("form"), escaped("pos")).alias("x"))))["x"], "\n").alias("words"))
    g = groups.groupBy("sent_id").agg(F.array_join(F.array_sort(F.collect_list(F.format_string("<group> %s %d %d", F.regexp_replace(escaped("name"), "[\r\n]", " "), "first_idx", "last_idx"))), "\n").alias("spans"))
    d = deps.groupBy("sent_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("gov", F.format_string('<d r="%s" s="%d" c="%d"/>', escaped("label"), F.col("gov") + 1, F.col("head") + 1).alias("x"))))["x"], "\n").alias("arcs"))
    joined = t.join(g, "sent_id", "left").join(d, "sent_id", "left")
    about = []
    if facts is not None:
        there = [c for c in FACTS if c in facts.columns]
        joined = joined.join(facts.select("sent_id", *[F.col(c).cast("string").alias(f"_{c}") for c in there]), "sent_id", "left")
        about = [F.when(F.col(f"_{c}").isNotNull(), F.concat(F.lit(f"<{FACTS[c]}>"), F.regexp_replace(escaped(f"_{c}"), "[\r\n]+", " "), F.lit(f"</{FACTS[c]}>"))) for c in there]
    return joined.select("sent_id", F.concat_ws("\n", F.format_string('<SEQ id="T_%d">', "sent_id"), *about, "words", "spans", "arcs", F.lit("</SEQ>")).alias("text"))


def read_xml_facts(spark: SparkSession, path: str) -> DataFrame:
    """sent_id, text, comment, conf (a number) and source of the sentences of native XML, null where missing."""
    whole = spark.read.text(path, wholetext=True)
    seqs = whole.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)(<SEQ .*?</SEQ>)"))).alias("seq"))

    def fact(name: str) -> Column:
        pattern = rf"(?s)<{name}>(.*?)</{name}>"
        return F.when(F.col("seq").rlike(pattern), plain(F.regexp_extract("seq", pattern, 1)))

    return seqs.select(F.regexp_extract("seq", r'id="T_(\d+)"', 1).cast("long").alias("sent_id"), *[fact(e).try_cast("double").alias(c) if c == "conf" else fact(e).alias(c) for c, e in FACTS.items()])


def read_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """tokens, arcs and groups of native XML; arcs with a missing end or label are dropped."""
    whole = spark.read.text(path, wholetext=True)
    seqs = whole.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)(<SEQ .*?</SEQ>)"))).alias("seq")).select(F.regexp_extract("seq", r'id="T_(\d+)"', 1).cast("long").alias("sent_id"), F.explode(F.split("seq", "\n")).alias("line"))
    at = lambda k: plain(F.regexp_extract("line", rf' {k}="([^"]*)"', 1))
    words = seqs.where("line like '<t %'").select("sent_id", (at("i").cast("int") - 1).alias("idx"), at("f").alias("form"), at("l").alias("lemma"), at("c").alias("pos"))
    arcs = seqs.where("line like '<d %'").select("sent_id", (at("s").cast("int") - 1).alias("gov"), (at("c").cast("int") - 1).alias("head"), at("r").alias("label")).where("label <> ''")
    ends = words.select("sent_id", F.col("idx").alias("gov"))
    arcs = arcs.join(ends, ["sent_id", "gov"], "left_semi").join(ends.withColumnRenamed("gov", "head"), ["sent_id", "head"], "left_semi").select("sent_id", "gov", "head", "label")
    spans = seqs.where("line like '<group>%'").select("sent_id", *[F.regexp_extract("line", r"^<group> (.*) (\d+) (\d+)$", n).alias(c) for n, c in ((1, "_name"), (2, "_first"), (3, "_last"))])
    spans = spans.select("sent_id", plain(F.col("_name")).alias("name"), F.col("_first").cast("int").alias("first_idx"), F.col("_last").cast("int").alias("last_idx"))
    return words, arcs, spans


def chunks(sentences: DataFrame, n: int) -> DataFrame:
    """sent_id and chunk: n equal parts in order, the last with the rest.

    Sentences are numbered in two levels: within ranges of ids, then by sums over the few ranges.
    """
    ranged = sentences.select("sent_id").distinct().repartitionByRange("sent_id").withColumn("part", F.spark_partition_id())
    counts = ranged.groupBy("part").agg(F.min("sent_id").alias("low"), F.count("*").alias("own"))
    order = Window.orderBy("low")
    counts = counts.select(F.col("low"), F.lead("low").over(order).alias("high"), (F.sum("own").over(order) - F.col("own")).alias("before"), F.sum("own").over(Window.partitionBy()).alias("all"))
    # the ranges may differ from run to run of the plan, so rows find theirs by their id
    found = sentences.select("sent_id").distinct().join(F.broadcast(counts), (F.col("sent_id") >= F.col("low")) & (F.col("high").isNull() | (F.col("sent_id") < F.col("high"))))
    seq = F.col("before") + F.row_number().over(Window.partitionBy("low").orderBy("sent_id")) - 1
    size = F.greatest(F.floor(F.col("all") / n), F.lit(1))
    return found.select("sent_id", F.least(F.floor(seq / size), F.lit(n - 1)).alias("chunk"))
