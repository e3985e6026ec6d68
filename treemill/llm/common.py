"""What the operators of this package share: checkpoints, Arrow batches, words.

A word is a run of characters other than space, tab, line feed, vertical tab, form feed and
carriage return.  ``bytes.split()`` cuts at exactly these six bytes.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a text that are cut into words at a time.
CHUNK = 1 << 20
#: Bits of the filter by which rows are sifted before a shuffle; broadcast as 64-bit words, so at
#: most 262,144 rows (4 MB) whatever the input.
FILTER_BITS = 1 << 24
#: Bytes of an Arrow batch on its way to Python.
BATCH = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, named by ``spark.checkpoint.dir``; only where that
    is unset (tests on one machine) a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp("-checkpoint"))
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder, its lineage cut; for narrow rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again; for wide rows."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def discard(df: DataFrame) -> None:
    """Deletes the table of a ``stored`` frame, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as the query that wrote them ends, for work in many short queries.

    Each of these has to end in a table or a checkpoint: a second run of the same frame shuffles again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def sifted(df: DataFrame, column: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` in two: rows whose ``column`` may be the one of ``keys``, and rows where it is not.

    A bitmap of hashes, made by the executors and broadcast at a bounded size; false hits are in
    the first part, so an exact join has to follow.  A full bitmap sifts nothing and loses nothing.
    """
    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(FILTER_BITS))
    hashed = keys.select(place(F.col(keys.columns[0])).alias("_place"))
    bit = F.expr("shiftleft(1L, cast(_place % 64 AS int))")
    words = settle(hashed.groupBy(F.expr("_place div 64").alias("_bitmap_word")).agg(F.bit_or(bit).alias("_bitmap_bits")))
    placed = df.withColumn("_place", place(F.col(column)))
    marked = placed.join(F.broadcast(words), F.expr("_place div 64") == F.col("_bitmap_word"), "left")
    hit = F.coalesce(F.col("_bitmap_bits").bitwiseAND(bit) != 0, F.lit(False))
    ours = ("_place", "_bitmap_word", "_bitmap_bits")
    return marked.where(hit).drop(*ours), marked.where(~hit).drop(*ours)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH`` bytes in this session, unless it has a size of its own.

    Spark's own size, 64 MB, is held several times over by each task and its Python worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b") if spark.conf.get(key).rstrip("b").isdigit() else 0) == 64 << 20:
        spark.conf.set(key, BATCH)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """Only ``doc_id``, ``text`` and ``more``, so that other columns of ``docs`` can't clash."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), *map(F.col, more))


def per_row(df: DataFrame, one: Callable[..., tuple], schema: str, start: Callable[[], object] | None = None) -> DataFrame:
    """``one(*values)`` of each row, as rows of ``schema``; Arrow batches, nothing shuffled.

    With ``start``, what it returns (made once a task) is passed first.
    """
    if start is None:
        return per_batch(df, lambda rows: [one(*r) for r in rows], schema)
    return per_batch(df, lambda first, rows: [one(first, *r) for r in rows], schema, start)


def per_batch(df: DataFrame, many: Callable[..., list[tuple]], schema: str, start: Callable[[], object] | None = None, size: int = 4 << 20) -> DataFrame:
    """Like ``per_row`` for lists of rows of ``size`` bytes: ``many(rows)`` returns their results."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    bounded_batches(df.sparkSession)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = (start(),) if start else ()
        for batch in batches:
            for part in slices(batch, size):
                rows = many(*first, list(zip(*(c.to_pylist() for c in part.columns), strict=True)))
                columns = zip(*rows, strict=True) if rows else [[] for _ in arrow]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of about ``size`` bytes, a row at least."""
    rows = max(1, int(batch.num_rows * size / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def word_chunks(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists from about ``CHUNK`` bytes each; no word is cut."""
    at = 0
    while at < len(data):
        end = at + CHUNK
        if end < len(data):
            while end < len(data) and data[end] not in b" \t\n\r\v\f":
                end += 1
        yield data[at:end].split()
        at = end


def closed(data: bytes, level: int = 3) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(data)


def opened(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def packed(values: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of each number, one plane of bytes after another, compressed."""
    planes = values.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :size]
    return closed(np.ascontiguousarray(planes.T).tobytes(), 1)


def unpacked(data: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(opened(data), np.uint8).reshape(size, -1)
    found = np.zeros((planes.shape[1], 8), np.uint8)
    found[:, :size] = planes.T
    return found.view("<u8").ravel()
