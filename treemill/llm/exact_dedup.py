"""Exact duplicates, with the heavy groups split off before the shuffle.

1. Each text becomes its SHA-256 (null counts as empty); from here only digests move.
2. A Misra-Gries style frequent-items summary (Spark's ``approx_top_k``: counters per task, merged)
   names at most ``WINNERS`` candidates.  Every digest that holds more than ``1 / WINNERS`` of
   the rows is among them.
3. The candidates are verified by an exact count, pre-aggregated in each task.  The winners, at
   most ``WINNERS`` rows whatever the input, are broadcast: their copies never meet in one task.
4. All other digests are grouped and joined by ordinary shuffles.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treemill.llm.common import documents, settle

#: Bound of the broadcast, in rows.
WINNERS = 1000
#: Counters of the summary; its error is at most 3.5 / COUNTERS of the rows.
COUNTERS = 20000


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest (32 bytes) and row, a number that tells repeated rows apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")).withColumn("row", F.monotonically_increasing_id())


def groups(rows: DataFrame) -> DataFrame:
    """digest, group_size and the row that stays: largest doc_id (null is least), then row."""
    return rows.groupBy("digest").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("best"))


def heavy_hitters(rows: DataFrame, winners: int = WINNERS, counters: int = COUNTERS) -> DataFrame:
    """``groups`` of the most frequent digests, exact, at most about ``winners`` rows."""
    keyed = rows.withColumn("key", F.xxhash64("digest"))
    candidates = keyed.agg(F.expr(f"approx_top_k(key, {winners}, {counters})").alias("top")).select(F.explode("top.item").alias("key"))
    return groups(keyed.join(F.broadcast(candidates), "key", "left_semi")).where("group_size > 1")


def exact_dedup(docs: DataFrame, winners: int = WINNERS, counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, keep_id, group_size, kept.

    Null texts equal empty ones.  Of equal texts the row with the largest doc_id stays; of
    repeated rows with that doc_id just one; a null doc_id loses to any other.  An empty table
    gives no rows.  Other columns are not looked at.
    """
    rows = settle(digests(docs))
    top = settle(heavy_hitters(rows, winners, counters))
    rest = rows.join(F.broadcast(top.select("digest")), "digest", "left_anti")
    found = rows.join(F.broadcast(top), "digest").unionByName(rest.join(groups(rest), "digest"))
    return found.select("doc_id", "digest", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each text, all columns as they are."""
    from pyspark.sql.types import StructType

    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("digest").alias("_kept_digest"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    whole: StructType = docs.schema
    marked = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), docs["doc_id"].alias("_id"), digest.alias("_digest"))
    found = marked.join(kept.hint("shuffle_hash"), marked["_id"].eqNullSafe(kept["_kept_id"]) & (marked["_digest"] == kept["_kept_digest"]), "left_semi")
    if exact_repeats(docs):
        found = found.dropDuplicates(["_id", "_digest"])
    return found.select(*[F.col("_doc").getField(c).alias(c) for c in whole.names])


def exact_repeats(docs: DataFrame) -> bool:
    """Whether a doc_id occurs twice: then equal rows can't be told apart by it."""
    return bool(docs.groupBy("doc_id").count().where("count > 1").select("doc_id").take(1)) if "doc_id" in docs.columns else False


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
