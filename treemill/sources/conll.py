"""CoNLL-06, -08 and -09 files as token and arc tables, and back.

Lines are read with their place in the file; blank lines separate sentences, so a sentence's
number is a running count.  A malformed line (too few columns, an id that is no number) drops its
sentence.  Ids and heads count from 1 in the files, with head 0 for none, and from 0 here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns by format, counted from 0, fixed values: form, lemma, pos, head, label, predicate, first argument.
LAYOUT = {
    "06": {"form": 1, "lemma": 2, "pos": 3, "fine": 4, "feats": 5, "head": 6, "label": 7},
    "08": {"form": 1, "lemma": 2, "pos": 3, "head": 8, "label": 9, "pred": 10, "args": 11},
    "09": {"form": 1, "lemma": 2, "pos": 5, "feats": 6, "head": 9, "label": 11, "fill": 12, "pred": 13, "args": 14},
}


def sentences(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """sent_id and lines (array of arrays of columns) of each sentence, in order of file and place.

    Files are read whole and split here, each by one task; a corpus is many files.
    """
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\r", "").alias("value"))
    blocks = whole.select("file", F.posexplode(F.split("value", r"\n[ \t]*\n")).alias("at", "block"))
    lines = F.filter(F.split("block", "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#"))
    found = blocks.select("file", "at", F.transform(lines, lambda x: F.split(x, "\t")).alias("lines")).where(F.size("lines") > 0)
    per_file = found.groupBy("file").agg(F.max("at").alias("most")).select("file", (F.sum(F.col("most") + 1).over(Window.orderBy("file")) - F.col("most") - 1).alias("before"))
    return found.join(F.broadcast(per_file) if isinstance(paths, str) else per_file, "file").select((F.col("before") + F.col("at")).alias("sent_id"), "lines")


def read(spark: SparkSession, paths: str | list[str], kind: str = "06") -> tuple[DataFrame, DataFrame, DataFrame]:
    """tokens, syntactic arcs and (08, 09) role arcs; role arcs go from a word to its predicate."""
    at = LAYOUT[kind]
    least = max(v for k, v in at.items() if k not in ("args", "pred", "fill")) + 1
    sound = sentences(spark, paths).where(F.forall("lines", lambda x: (F.size(x) >= least) & x[0].rlike("^[0-9]+$")))
    rows = sound.select("sent_id", F.posexplode("lines").alias("idx", "c"))
    col = lambda n: F.get("c", F.lit(at[n])) if n in at else F.lit(None).cast("string")
    extra = F.map_filter(F.create_map(F.lit("POSD"), col("fine"), F.lit("FEATS"), col("feats")), lambda k, v: v.isNotNull() & (v != "_"))
    predicate = F.coalesce(col("pred"), F.lit("_")) != "_"
    if "fill" in at:
        predicate = predicate | (F.coalesce(col("fill"), F.lit("_")) != "_")
    sense = F.when(predicate, col("pred"))
    tokens = rows.select(F.lit(0).alias("level"), "sent_id", "idx", col("form").alias("form"), col("lemma").alias("lemma"), col("pos").alias("pos"), sense.alias("sense"), F.lit(-1).cast("long").alias("src_begin"), F.lit(-1).cast("long").alias("src_end"), extra.alias("extra"))
    deps = rows.select("sent_id", F.col("idx").alias("gov"), (F.expr(f"try_cast(c[{at['head']}] AS int)") - 1).alias("head"), col("label").alias("label")).where("head >= 0")
    if "args" not in at:
        return tokens, deps, deps.limit(0)
    preds = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: (F.get(s["x"], F.lit(at["pred"])) != "_") | ((F.get(s["x"], F.lit(at["fill"])) != "_") if "fill" in at else F.lit(False)))
    heads = sound.select("sent_id", "lines", F.transform(preds, lambda s: s["i"]).alias("preds"))
    args = heads.select("sent_id", "preds", F.posexplode("lines").alias("gov", "c")).select("sent_id", "preds", "gov", F.posexplode(F.slice("c", at["args"] + 1, F.greatest(F.size("c") - at["args"], F.lit(0)))).alias("n", "label"))
    roles = args.where("label <> '_' and n < size(preds)").select("sent_id", "gov", F.get("preds", F.col("n")).alias("head"), "label")
    return tokens, deps, roles


def lines06(tokens: DataFrame, deps: DataFrame) -> DataFrame:
    """sent_id and text: each sentence as CoNLL-06 lines, for ``DataFrame.write.text``."""
    from treemill.operators.match import first_arcs

    one = first_arcs(deps).select("sent_id", F.col("gov").alias("idx"), "head", "label")
    joined = tokens.join(one, ["sent_id", "idx"], "left")
    extra = (lambda k: F.coalesce(F.col("extra")[k], F.lit("_"))) if "extra" in tokens.columns else (lambda k: F.lit("_"))
    there = [F.coalesce(c, F.lit("_")) for c in ("form", "lemma", "pos")]
    line = F.concat_ws("\t", (F.col("idx") + 1).cast("string"), *there, extra("POSD"), extra("FEATS"), (F.coalesce("head", F.lit(-1)) + 1).cast("string"), F.coalesce("label", F.lit("ROOT")), F.lit("_"), F.lit("_"))
    return joined.groupBy("sent_id").agg(F.concat(F.array_join(F.array_sort(F.collect_list(F.struct("idx", line.alias("line"))))["line"], "\n"), F.lit("\n")).alias("text"))


def lines09(tokens: DataFrame, deps: DataFrame, roles: DataFrame) -> DataFrame:
    """sent_id and text: each sentence as CoNLL-09 lines, an argument column per predicate."""
    from treemill.operators.match import first_arcs

    heads = roles.select("sent_id", F.col("head").alias("idx")).unionByName(tokens.where("sense is not null").select("sent_id", "idx"))
    preds = heads.groupBy("sent_id").agg(F.array_sort(F.collect_set("idx")).alias("preds"))
    args = roles.groupBy("sent_id", F.col("gov").alias("idx")).agg(F.map_from_entries(F.collect_list(F.struct("head", "label"))).alias("args"))
    one = first_arcs(deps).select("sent_id", F.col("gov").alias("idx"), "head", "label")
    joined = tokens.join(one, ["sent_id", "idx"], "left").join(preds, "sent_id", "left").join(args, ["sent_id", "idx"], "left")
    head, label = (F.coalesce("head", F.lit(-1)) + 1).cast("string"), F.coalesce("label", F.lit("ROOT"))
    clean = lambda c: F.coalesce(F.translate(c, " ", "_"), F.lit("_"))
    is_pred = F.array_contains(F.coalesce("preds", F.array().cast("array<int>")), F.col("idx"))
    cells = F.transform(F.coalesce("preds", F.array().cast("array<int>")), lambda p: F.coalesce(F.try_element_at("args", p), F.lit("_")))
    first = F.array((F.col("idx") + 1).cast("string"), clean("form"), clean("lemma"), clean("lemma"), clean("pos"), clean("pos"), F.lit("_"), F.lit("_"), head, head, label, label, F.when(is_pred, "Y").otherwise("_"), F.coalesce("sense", F.lit("_")))
    line = F.array_join(F.concat(first, cells), "\t")
    return joined.groupBy("sent_id").agg(F.concat(F.array_join(F.array_sort(F.collect_list(F.struct("idx", line.alias("line"))))["line"], "\n"), F.lit("\n")).alias("text"))


def write(lines: DataFrame, path: str) -> None:
    """Sentences in order; many part files, each sorted."""
    lines.repartitionByRange("sent_id").sortWithinPartitions("sent_id").select("text").write.mode("overwrite").text(path)
