"""Quality classifier by importance resampling.

Words and pairs of words are hashed to buckets.  Two generative models, bags of buckets with
add-one smoothing, are counted: one over the target (documents labelled good), one over all raw
documents.  A document's weight is the sum of the log ratios of its buckets; adding Gumbel noise
and keeping the top k draws k documents without replacement in proportion to the ratio.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treemill.llm.common import documents, per_row, settle, slices, texts, word_chunks

BUCKETS = 10_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def counts(text: str | None) -> np.ndarray:
    """How often each bucket occurs in a whole text; a null text has none."""
    from zlib import crc32

    found, left = np.zeros(BUCKETS, np.int64), []
    for words in word_chunks((text or "").encode().translate(LOWER)):
        hashes = np.array(left + list(map(crc32, words)), np.uint64)
        single = hashes[len(left) :]
        pairs = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        for h in (single * np.uint64(0xD6E8FEB86659FD93), pairs):
            found += np.bincount(((h >> np.uint64(33)) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        left = hashes[-1:].tolist() if len(hashes) else left
    return found


def model(rows: DataFrame) -> np.ndarray:
    """Log probabilities of the buckets over all texts in ``rows``; summed in each task first."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch):
                for text in part.column("text").to_pylist():
                    total += counts(text)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    found = np.ones(BUCKETS)
    for r in rows.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        found[r["bucket"]] += r["n"]
    return np.log(found / found.sum())


def weighed(docs: DataFrame, good: DataFrame) -> DataFrame:
    """doc_id, n_grams and log_ratio of every row; ``good`` has the target's doc_ids.

    The ids grow with the corpus, so they are joined by a shuffle at every size: texts move once.
    """
    raw = texts(docs)
    target = raw.join(good.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi")
    ratio = model(target) - model(raw)

    def one(doc_id, text):
        found = counts(text)
        return doc_id, int(found.sum()), float(found @ ratio)

    return per_row(raw, one, "doc_id long, n_grams long, log_ratio double")


def top_share(rows: DataFrame, order: str, share: float) -> DataFrame:
    """``rows`` with ``kept``: whether among the first ``share`` of them by ``order``, largest
    first; equal ones by doc_id, repeated rows together.  Counts over ever narrower ranges
    find the limit, so nothing is sorted in one task.
    """
    n = rows.count()
    want = int(round(share * n))
    if want <= 0 or want >= n:
        return rows.withColumn("kept", F.lit(want > 0))
    low, high = rows.agg(F.min(order), F.max(order)).first()
    left = want
    for _ in range(12):
        if high <= low:
            break
        step = (high - low) / 1024
        cell = F.least(F.floor((F.col(order) - F.lit(low)) / F.lit(step)), F.lit(1023))
        inside = rows.where((F.col(order) >= low) & (F.col(order) <= high)).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(order).alias("low"), F.max(order).alias("high"))
        for r in sorted(inside.collect(), key=lambda r: -r["cell"]):
            if r["n"] >= left:
                low, high = r["low"], r["high"]
                break
            left -= r["n"]
        if r["n"] == left:
            return rows.withColumn("kept", F.col(order) >= low)
    ties = rows.where(F.col(order) == low).select("doc_id")
    limit = ties.orderBy("doc_id").limit(left).agg(F.max("doc_id")).first()[0]
    return rows.withColumn("kept", (F.col(order) > low) | ((F.col(order) == low) & F.coalesce(F.col("doc_id") <= F.lit(limit), F.lit(True))))


def resampled(docs: DataFrame, good: DataFrame, share: float, seed: int = 17) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_grams, log_ratio, key and kept.

    ``key`` is the log ratio plus Gumbel noise from a hash of doc_id and ``seed``, so reruns agree.
    ``share`` of the rows are kept, those with the largest keys.  A text without words weighs 0.
    With no good document the ratio favours none.  Other columns are not looked at.
    """
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / (1 << 52)
    rows = settle(weighed(docs, good).withColumn("key", F.col("log_ratio") - F.log(-F.log(uniform))))
    return top_share(rows, "key", share)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws as large a share of ``documents`` as is good among those with a label."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality in (0, 1)")
    share = labels.agg(F.avg("quality")).first()[0]
    return resampled(documents(spark, sf_dir), labels.where("quality = 1"), 1.0 if share is None else share)
