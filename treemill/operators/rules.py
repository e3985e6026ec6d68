"""Rules that make arcs: each is a nearest-word window or a join within the sentence.

A rule returns candidate arcs (sent_id, gov, head, label).  ``applied`` adds them to a graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treemill.sources.adapter import nearest


def _arcs(rows: DataFrame, head: str, label: str) -> DataFrame:
    return rows.where(F.col(head).isNotNull()).select("sent_id", F.col("idx").alias("gov"), F.col(head).alias("head"), F.lit(label).alias("label"))


def to_any(tokens: DataFrame, a: Column, b: Column, label: str, right: bool = True) -> DataFrame:
    """Each A to every B on one side."""
    others = tokens.where(b).select("sent_id", F.col("idx").alias("head"))
    side = F.col("head") > F.col("idx") if right else F.col("head") < F.col("idx")
    return tokens.where(a).select("sent_id", "idx").join(others, "sent_id").where(side).select("sent_id", F.col("idx").alias("gov"), "head", F.lit(label).alias("label"))


def to_first(tokens: DataFrame, a: Column, b: Column, label: str, right: bool = True, within: int | None = None) -> DataFrame:
    """Each A to the nearest B on one side; ``within n`` looks at n - 1 words."""
    found = tokens.withColumn("_h", nearest(b, before=not right, reach=within - 1 if within else None)).where(a)
    return _arcs(found, "_h", label)


def to_previous(tokens: DataFrame, a: Column, label: str, b: Column | None = None) -> DataFrame:
    """Each A to the word just before, if that is a B."""
    order = Window.partitionBy("sent_id").orderBy("idx")
    ok = F.lag(b if b is not None else F.lit(True)).over(order)
    return _arcs(tokens.withColumn("_h", F.when(ok, F.col("idx") - 1)).where(a), "_h", label)


def head_to_first(tokens: DataFrame, deps: DataFrame, arc_label: str, b: Column, label: str) -> DataFrame:
    """The head of each word with an arc of ``arc_label`` to the nearest B on that head's left."""
    heads = deps.where(F.col("label") == arc_label).select("sent_id", F.col("head").alias("idx")).distinct()
    found = tokens.withColumn("_h", nearest(b, before=True)).join(heads, ["sent_id", "idx"], "left_semi")
    return _arcs(found, "_h", label)


def lifted(deps: DataFrame, arc_label: str) -> DataFrame:
    """Children of a word with an arc of ``arc_label`` moved to that word's head."""
    up = deps.where(F.col("label") == arc_label).select("sent_id", F.col("gov").alias("head"), F.col("head").alias("_up"))
    return deps.join(up, ["sent_id", "head"], "left").select("sent_id", "gov", F.coalesce("_up", "head").alias("head"), "label")


def to_first_childless(tokens: DataFrame, deps: DataFrame, a: Column, b: Column, child: str, label: str) -> DataFrame:
    """Each A to the nearest B on the right that has no child with label ``child``."""
    parents = deps.where(F.col("label") == child).select("sent_id", F.col("head").alias("idx"), F.lit(True).alias("_p")).distinct()
    marked = tokens.join(parents, ["sent_id", "idx"], "left")
    return _arcs(marked.withColumn("_h", nearest(b & F.col("_p").isNull())).where(a), "_h", label)


def applied(deps: DataFrame, new: DataFrame, replace: bool = False) -> DataFrame:
    """``deps`` with the new arcs: for words without one, or in place of theirs.

    Of several candidates for a word the nearest head counts, then the left one.  Labels that start
    with ``_`` are never replaced.
    """
    order = Window.partitionBy("sent_id", "gov").orderBy(F.abs(F.col("head") - F.col("gov")), "head", "label")
    one = new.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    fixed = deps.where(F.col("label").startswith("_")) if replace else deps
    add = one.join(fixed, ["sent_id", "gov"], "left_anti")
    kept = deps.join(add, ["sent_id", "gov"], "left_anti") if replace else deps
    return kept.select("sent_id", "gov", "head", "label").unionByName(add.select("sent_id", "gov", "head", "label"))
