"""Role columns in brackets (CoNLL-05), CoNLL-08 lines and bracketed trees from spans.

All writers return sent_id and text for ``treemill.sources.conll.write``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treemill.sources.other import numbered


def _sentence_text(lines: DataFrame) -> DataFrame:
    """sent_id and text from sent_id, idx and line."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "line")))["line"]
    return lines.groupBy("sent_id").agg(F.concat(F.array_join(ordered, "\n"), F.lit("\n")).alias("text"))


def read_props(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """groups (sent_id, name, first_idx, last_idx) and roles (sent_id, gov, head, label).

    A line is the verb or ``-``, then one bracket column per verb: ``(A0*``, ``*``, ``*)``.  Spans
    of column i are named ``label_i``; those labelled V or N are left out.  A role goes from a
    span's first word to verb i.  In each column the n-th bracket at a depth closes the n-th that
    opened it, so depth is a running sum and a pair is a rank; unclosed spans are dropped.
    """
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\r", "").alias("value"))
    blocks = whole.select("file", F.posexplode(F.split("value", r"\n[ \t]*\n")).alias("at", "block")).where(F.trim("block") != "")
    lines = numbered(blocks, "at").select("sent_id", F.posexplode(F.filter(F.split("block", "\n"), lambda x: F.trim(x) != "")).alias("idx", "line"))
    words = lines.select("sent_id", "idx", F.split(F.trim("line"), r"\s+").alias("c"))
    verbs = words.where(F.col("c")[0] != "-").select("sent_id", F.col("idx").alias("head"), (F.row_number().over(Window.partitionBy("sent_id").orderBy("idx")) - 1).alias("n"))
    cells = words.select("sent_id", "idx", F.posexplode(F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0)))).alias("n", "cell"))
    marks = cells.select("sent_id", "idx", "n", F.posexplode(F.regexp_extract_all("cell", F.lit(r"(\([^()*]*|\))"))).alias("k", "mark"))
    column = Window.partitionBy("sent_id", "n").orderBy("idx", "k")
    opens = F.col("mark").startswith("(")
    after = F.sum(F.when(opens, 1).otherwise(-1)).over(column)
    deep = marks.withColumn("depth", F.when(opens, after).otherwise(after + 1))
    level = Window.partitionBy("sent_id", "n", "depth").orderBy("idx", "k")
    paired = deep.withColumn("last_idx", F.lead("idx").over(level)).withColumn("closes", F.lead("mark").over(level))
    spans = paired.where(opens & (F.col("closes") == ")")).select("sent_id", "n", F.expr("substring(mark, 2)").alias("label"), F.col("idx").alias("first_idx"), "last_idx").where("label not in ('V', 'N')")
    groups = spans.select("sent_id", F.concat_ws("_", "label", "n").alias("name"), "first_idx", "last_idx")
    roles = spans.join(verbs, ["sent_id", "n"]).select("sent_id", F.col("first_idx").alias("gov"), "head", "label")
    return groups, roles


def props_lines(tokens: DataFrame, yields: DataFrame, roles: DataFrame) -> DataFrame:
    """Role columns of each sentence: a span is the yield of the role's word in the syntax tree
    (``yields``: sent_id, idx, leftmost, rightmost).

    A word tagged ``IN...`` right before the span joins it.  A predicate inside is left out: at an
    end the span shrinks, in the middle it splits in two.  A role of a predicate by itself has no
    span.
    """
    predicates = roles.select("sent_id", "head").distinct()
    tagged = tokens.select("sent_id", (F.col("idx") + 1).alias("leftmost"), F.col("pos").startswith("IN").alias("after_in"))
    spans = roles.where("gov <> head").join(yields.select("sent_id", F.col("idx").alias("gov"), "leftmost", "rightmost"), ["sent_id", "gov"])
    spans = spans.join(tagged, ["sent_id", "leftmost"], "left").withColumn("leftmost", F.col("leftmost") - F.coalesce(F.col("after_in").cast("int"), F.lit(0)))
    left, right, verb = F.col("leftmost"), F.col("rightmost"), F.col("head")
    part = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    pieces = (
        F.when(verb == left, F.array(part(left + 1, right)))
        .when(verb == right, F.array(part(left, right - 1)))
        .when((verb > left) & (verb < right), F.array(part(left, verb - 1), part(verb + 1, right)))
        .otherwise(F.array(part(left, right)))
    )
    cut = spans.select("sent_id", "head", "label", F.explode(pieces).alias("p")).where("p.a <= p.b")
    ends = cut.select("sent_id", "head", F.explode(F.array(F.struct(F.col("p.a").alias("idx"), F.concat(F.lit("("), "label").alias("open"), F.lit("").alias("close")), F.struct(F.col("p.b").alias("idx"), F.lit("").alias("open"), F.lit(")").alias("close")))).alias("e"))
    marks = ends.groupBy("sent_id", "head", F.col("e.idx").alias("idx")).agg(F.array_join(F.array_sort(F.collect_list("e.open")), "").alias("open"), F.array_join(F.collect_list("e.close"), "").alias("close"))
    grid = tokens.select("sent_id", "idx", "form", "pos").join(predicates, "sent_id").join(marks, ["sent_id", "head", "idx"], "left")
    own = F.concat(F.lit("("), F.coalesce(F.substring("pos", 1, 1), F.lit("_")), F.lit("*)"))
    cell = F.concat(F.coalesce("open", F.lit("")), F.when(F.col("idx") == F.col("head"), own).otherwise("*"), F.coalesce("close", F.lit("")))
    rows = grid.groupBy("sent_id", "idx").agg(F.array_sort(F.collect_list(F.struct("head", cell.alias("cell"))))["cell"].alias("cells"), F.max((F.col("idx") == F.col("head")).cast("int")).alias("is_verb"))
    full = tokens.select("sent_id", "idx", "form").join(rows, ["sent_id", "idx"], "left")
    line = F.concat_ws("\t", F.when(F.col("is_verb") == 1, F.coalesce("form", F.lit("_"))).otherwise("-"), F.array_join("cells", "\t"))
    return _sentence_text(full.select("sent_id", "idx", line.alias("line")))


def lines08(tokens: DataFrame, deps: DataFrame, roles: DataFrame) -> DataFrame:
    """CoNLL-08 lines: predicates are the heads of roles in order, named ``lemma.n``; one argument
    column each; words without an arc have head 0 and ROOT.
    """
    from treemill.operators.match import first_arcs

    preds = roles.groupBy("sent_id").agg(F.array_sort(F.collect_set("head")).alias("preds"))
    args = roles.groupBy("sent_id", F.col("gov").alias("idx"), "head").agg(F.max("label").alias("label"))
    args = args.groupBy("sent_id", "idx").agg(F.map_from_entries(F.collect_list(F.struct("head", "label"))).alias("args"))
    arcs = first_arcs(deps).select("sent_id", F.col("gov").alias("idx"), F.col("head").alias("_head"), F.col("label").alias("_label"))
    joined = tokens.join(arcs, ["sent_id", "idx"], "left").join(preds, "sent_id", "left").join(args, ["sent_id", "idx"], "left")
    all_preds = F.coalesce("preds", F.array().cast("array<int>"))
    fine = F.coalesce(F.col("extra")["POSD"], F.lit("_")) if "extra" in tokens.columns else F.lit("_")
    number = F.array_position(all_preds, F.col("idx")) - 1
    there = [F.coalesce(c, F.lit("_")) for c in ("form", "lemma", "pos")]
    first = F.array((F.col("idx") + 1).cast("string"), *there, fine, *there, (F.coalesce("_head", F.lit(-1)) + 1).cast("string"), F.coalesce("_label", F.lit("ROOT")), F.when(number >= 0, F.concat_ws(".", "lemma", number.cast("string"))).otherwise("_"))
    cells = F.transform(all_preds, lambda p: F.coalesce(F.try_element_at("args", p), F.lit("_")))
    return _sentence_text(joined.select("sent_id", "idx", F.array_join(F.concat(first, cells), "\t").alias("line")))


def bracket_lines(tokens: DataFrame, groups: DataFrame) -> DataFrame:
    """Bracketed trees from nested groups: at a word the longest opens first, and as many close
    as end there; brackets in forms become ``-``.
    """
    size = F.col("last_idx") - F.col("first_idx")
    opened = groups.groupBy("sent_id", F.col("first_idx").alias("idx")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-size).alias("s"), "name"))), lambda g: F.concat(F.lit("("), g["name"], F.lit(" "))), "").alias("open"))
    closed = groups.groupBy("sent_id", F.col("last_idx").alias("idx")).agg(F.count("*").cast("int").alias("n"))
    leaf: Column = F.concat(F.lit("("), "pos", F.lit(" "), F.trim(F.translate("form", "()", "--")), F.lit(")"))
    joined = tokens.join(opened, ["sent_id", "idx"], "left").join(closed, ["sent_id", "idx"], "left")
    line = F.concat(F.coalesce("open", F.lit("")), leaf, F.repeat(F.lit(")"), F.coalesce("n", F.lit(0))))
    body = _sentence_text(joined.select("sent_id", "idx", line.alias("line")))
    return body.select("sent_id", F.concat(F.lit("( (S\n"), "text", F.lit("))\n")).alias("text"))
