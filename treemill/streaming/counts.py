"""Statistics kept up to date over a folder that sentences arrive in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def label_counts(spark: SparkSession, folder: str) -> DataFrame:
    """A running count by tag and label of CoNLL-06 lines in text files that arrive in ``folder``."""
    cols = F.split("value", "\t")
    lines = spark.readStream.text(folder).where(F.size(cols) >= 8)
    return lines.groupBy(cols[3].alias("pos"), cols[7].alias("label")).agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events per type and tumbling window, closed by a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
