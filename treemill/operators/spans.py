"""Groups (named spans) and their joins with words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def words_in(tokens: DataFrame, groups: DataFrame) -> DataFrame:
    """Words with each group they are in (a range join within the sentence)."""
    return tokens.join(groups, "sent_id").where("idx between first_idx and last_idx")


def begin_inside(tokens: DataFrame, groups: DataFrame, name: str) -> DataFrame:
    """form, pos and ``<name>B`` at the first word of a group, ``<name>I`` inside, ``NO`` outside."""
    spans = groups.where(F.col("name") == name)
    inside = words_in(tokens.select("sent_id", "idx"), spans).groupBy("sent_id", "idx").agg(F.max((F.col("idx") == F.col("first_idx")).cast("int")).alias("begins"))
    tag = F.when(F.col("begins") == 1, f"{name}B").when(F.col("begins") == 0, f"{name}I").otherwise("NO")
    return tokens.join(inside, ["sent_id", "idx"], "left").select("sent_id", "idx", "form", "pos", tag.alias("tag"))


def next_marks(marks: DataFrame, key: Column) -> DataFrame:
    """sent_id and idx of marked words, with those of the next mark of the same ``key``; the last one's is the first."""
    order = Window.partitionBy(key).orderBy("sent_id", "idx")
    first = order.rowsBetween(Window.unboundedPreceding, 0)
    to = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(first)).alias(f"next_{'sent' if c == 'sent_id' else c}")
    return marks.select("sent_id", "idx", to("sent_id"), to("idx"))
