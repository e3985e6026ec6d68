"""Queries over groups shuffle little more than the texts, and in proportion to them."""

import os

import __spark_entry__
import pytest
from pyspark.sql import functions as F

DOCS = "/root/testdata/sf0.01/documents.parquet"


def stages(spark):
    """By stage the bytes that it has shuffled and spilled; Spark keeps the last thousand."""
    jvm, sc = spark._jvm, spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    found = sc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    found = [found.apply(k) for k in range(found.length())]
    return {s.stageId(): s.shuffleWriteBytes() + s.diskBytesSpilled() for s in found}


@pytest.mark.parametrize("name, keys", [("sub_groups", ["name"]), ("group_runs", ["name", "words"])])
def test_shuffled_at_two_sizes(spark, tmp_path, name, keys):
    docs, counts, shuffled = spark.read.parquet(DOCS), [], []
    for times in (1, 2):
        folder = str(tmp_path / f"x{times}")
        docs.withColumn("doc_id", F.explode(F.array([F.col("doc_id") + k * 10_000_000 for k in range(times)]))).coalesce(1).write.parquet(f"{folder}/documents.parquet")
        last = max(stages(spark))
        counts.append({tuple(r[k] for k in keys): r.n for r in __spark_entry__.queries()[name](spark, folder).collect()})
        shuffled.append(sum(n for stage, n in stages(spark).items() if stage > last))
    assert counts[1] == {k: 2 * n for k, n in counts[0].items()} and len(counts[0]) > 5
    assert 0 < shuffled[0] < 2 * os.path.getsize(DOCS) and shuffled[1] < 2.2 * shuffled[0]
