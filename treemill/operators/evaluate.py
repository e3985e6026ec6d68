"""Comparing two annotations of the same sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treemill.operators.match import first_arcs


def side_by_side(tokens: DataFrame, gold: DataFrame, system: DataFrame) -> DataFrame:
    """Each word with gold_head, gold_label, sys_head, sys_label; -1 and ROOT without an arc.

    A leading ``_`` of a system label doesn't count.
    """
    pick = lambda d, n: first_arcs(d).select("sent_id", F.col("gov").alias("idx"), F.col("head").alias(f"{n}_head"), F.col("label").alias(f"{n}_label"))
    found = tokens.join(pick(gold, "gold"), ["sent_id", "idx"], "left").join(pick(system, "sys"), ["sent_id", "idx"], "left")
    found = found.fillna({"gold_head": -1, "sys_head": -1, "gold_label": "ROOT", "sys_label": "ROOT"})
    return found.withColumn("sys_label", F.regexp_replace("sys_label", "^_", ""))


def attachment(words: DataFrame, *keys: str | Column) -> DataFrame:
    """Words, and the shares with the right head (uas), and head and label (las)."""
    head = F.col("gold_head") == F.col("sys_head")
    both = head & (F.col("gold_label") == F.col("sys_label"))
    share = lambda c: F.round(F.avg(c.cast("double")), 9)
    return words.groupBy(*keys).agg(F.count("*").alias("words"), share(head).alias("uas"), share(both).alias("las"), share(F.col("gold_label") == F.col("sys_label")).alias("label_accuracy"))


def direction(head: str) -> Column:
    """Where the head lies: to_root, left, right or self."""
    return F.when(F.col(head) < 0, "to_root").when(F.col(head) < F.col("idx"), "left").when(F.col(head) > F.col("idx"), "right").otherwise("self")


def distance(head: str) -> Column:
    far = F.abs(F.col(head) - F.col("idx"))
    return F.when(F.col(head) < 0, "to_root").when(far <= 1, "1").when(far == 2, "2").when(far <= 6, "3-6").otherwise("7-")


def by_label(gold: DataFrame, system: DataFrame) -> DataFrame:
    """Precision, recall and F per label over all arcs, with the half-width of the 95 % interval; words may have
    several arcs, equal ones count once.
    """
    key = ["sent_id", "gov", "head", "label"]
    sides = gold.select(*key, F.lit(1).alias("g"), F.lit(0).alias("s")).unionByName(system.select(*key, F.lit(0).alias("g"), F.lit(1).alias("s")))
    arcs = sides.groupBy(key).agg(F.max("g").alias("g"), F.max("s").alias("s"), F.sum("g").alias("in_gold"), F.sum("s").alias("in_sys"))
    return _scores(arcs.groupBy("label").agg(F.sum("in_gold").alias("in_gold"), F.sum("in_sys").alias("in_sys"), F.sum(F.col("g") * F.col("s")).cast("long").alias("right")))


def by_label_of(words: DataFrame) -> DataFrame:
    """``by_label`` of words that have gold_head, gold_label, sys_head and sys_label (null without an arc) in one row: one
    aggregation, summed before its shuffle.
    """
    has = lambda side: F.col(f"{side}_head").isNotNull().cast("int")
    right = F.coalesce((F.col("gold_head") == F.col("sys_head")) & (F.col("gold_label") == F.col("sys_label")), F.lit(False)).cast("int")
    one = lambda side, g, s, r: F.struct(F.col(f"{side}_label").alias("label"), g.alias("in_gold"), s.alias("in_sys"), r.alias("right"))
    rows = words.select(F.explode(F.array(one("gold", has("gold"), F.lit(0), right), one("sys", F.lit(0), has("sys"), F.lit(0)))).alias("r")).select("r.*").where("label is not null")
    return _scores(rows.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("in_gold", "in_sys", "right")]))


def _scores(counts: DataFrame) -> DataFrame:
    p, r = F.try_divide("right", "in_sys"), F.try_divide("right", "in_gold")
    found = counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.try_divide(2 * p * r, p + r))
    half = lambda v, n: 1.96 * F.sqrt(F.try_divide(F.col(v) * (1 - F.col(v)), F.col(n)))
    found = found.withColumn("precision_half", half("precision", "in_sys")).withColumn("recall_half", half("recall", "in_gold"))
    return found.select("label", "in_gold", "in_sys", "right", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "precision_half", "recall_half")])


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Arcs in both, in one only, and with another label."""
    joined = a.select("sent_id", "gov", "head", F.col("label").alias("label_a")).join(b.select("sent_id", "gov", "head", F.col("label").alias("label_b")), ["sent_id", "gov", "head"], "full")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return joined.agg(
        n(F.col("label_a").isNotNull() & F.col("label_b").isNotNull()).alias("common"),
        n(F.col("label_b").isNull()).alias("only_a"), n(F.col("label_a").isNull()).alias("only_b"),
        n(F.col("label_a") != F.col("label_b")).alias("relabelled"),
    )


def induced_roles(rows: DataFrame) -> DataFrame:
    """Purity, collocation and their F of found roles against gold ones, per verb."""
    cell = rows.groupBy("verb", "found", "gold").agg(F.count("*").alias("n"))
    purity = cell.groupBy("verb", "found").agg(F.max("n").alias("n")).groupBy("verb").agg(F.sum("n").alias("pure"))
    together = cell.groupBy("verb", "gold").agg(F.max("n").alias("n")).groupBy("verb").agg(F.sum("n").alias("together"))
    total = cell.groupBy("verb").agg(F.sum("n").alias("n"))
    found = total.join(purity, "verb").join(together, "verb").select("verb", "n", (F.col("pure") / F.col("n")).alias("purity"), (F.col("together") / F.col("n")).alias("collocation"))
    return found.withColumn("f1", F.round(2 * F.col("purity") * F.col("collocation") / (F.col("purity") + F.col("collocation")), 9)).withColumn("purity", F.round("purity", 9)).withColumn("collocation", F.round("collocation", 9))
