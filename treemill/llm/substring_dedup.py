"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping blocks of ``BLOCK`` words, the reference blocks.  A
window of ``WINDOW = 2 * BLOCK - 1`` words or more holds a whole block wherever it lies, so two equal
windows show as a block of one document that equals a rolling stretch of the other.

1. Anchors.  All rolling stretches of ``BLOCK`` words probe the index of blocks.  Both are hashed in
   each task with numpy and dealt by hash; a stretch is a hit if it occurs twice or more and
   one occurrence is a block.
2. Extension.  Around the hits the windows of ``WINDOW`` words are hashed (104 bits, from two
   independent hashes of every word) and dealt again; those that occur twice or more are repeats,
   and runs of them are the maximal repeats.  Among 1e13 windows the expected number of unequal
   ones with equal hashes is below 1e-5.
3. The words under a repeat are removed.

Documents are laid end to end in chunks of a few MB first, and a place is a word of a chunk.  A
chunk sends each hash once, with its place if it has it once; if it has it more often, its places
are known to be repeated without asking.  So a passage that a third of all documents share sends
one entry a chunk, not one a document.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treemill.llm.common import closed, documents, opened, packed, settle, slices, stored, texts, unpacked

WINDOW, BLOCK = 35, 18
#: Bytes of text in a chunk; entries that a task looks through at a time.
CHUNK, BUCKET = 4 << 20, 1_500_000
#: Places that a task gathers over its buckets before it hands them out by chunk.
GATHER = 1_000_000
BASES = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
SEEDS = 0, 0x5851F42D
#: Bits of a stretch's hash beyond those that number the blocks; one stretch in 2 ** SPARE is a
#: hit by chance, which the windows' 104 bits put right.
SPARE = 13
CHUNKS = "chunk long, doc_ids array<long>, n_words long, words binary"
ENTRY = "bucket long, n int, chunk long, hashes binary, places binary"
FOUND = "chunk long, places binary"


def word_hashes(words: bytes, seed: int = SEEDS[0]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    found = words.split()
    return np.fromiter((xxh64_intdigest(w, seed) for w in found), np.uint64, len(found))


def rolling(words: np.ndarray, length: int, base: int) -> np.ndarray:
    """A hash of ``words[i : i + length]`` for each i, by doubling the stretch."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, done, power = None, 0, words
    step, factor, shift = 1, base, 1
    while True:
        if length & step:
            part = power[done : done + n]
            part = part * np.uint64(shift)
            total = part if total is None else total + part
            done += step
            shift = shift * factor % (1 << 64)
        step *= 2
        if step > length:
            break
        power = power[: len(power) - step // 2] + power[step // 2 :] * np.uint64(factor)
        factor = factor * factor % (1 << 64)
    total = (total ^ (total >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return total ^ (total >> np.uint64(29))


def listed(at: np.ndarray) -> bytes:
    """Rising places as packed steps."""
    return packed(np.diff(at, prepend=0).astype(np.uint64), 5)


def places(lists: list[bytes] | None) -> np.ndarray:
    found = [np.cumsum(unpacked(p, 5).view(np.int64)) for p in lists or []]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunked(docs: DataFrame) -> DataFrame:
    """``CHUNKS`` rows of about ``CHUNK`` bytes, a document at least, as a table: its documents' ids and
    words, those of a document joined by spaces and documents by line feeds.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = itertools.count(TaskContext.get().partitionId() << 32)

        def row(ids: list, texts_: list[bytes], n: int) -> pa.RecordBatch:
            columns = ([next(number)], pa.int64()), ([ids], pa.list_(pa.int64())), ([n], pa.int64()), ([closed(b"\n".join(texts_))], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(*c) for c in columns], ["chunk", "doc_ids", "n_words", "words"])

        ids, held, size, n = [], [], 0, 0
        for batch in batches:
            for part in slices(batch, CHUNK // 4):
                for doc_id, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    words = (text or "").encode().split()
                    ids.append(doc_id)
                    held.append(b" ".join(words))
                    size, n = size + len(held[-1]), n + len(words)
                    if size >= CHUNK:
                        yield row(ids, held, n)
                        ids, held, size, n = [], [], 0, 0
        if ids:
            yield row(ids, held, n)

    return stored(texts(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, CHUNKS))


def entries(chunk: int, block: np.ndarray, at: np.ndarray, first: np.ndarray, second: np.ndarray | None, buckets: int, bits: int) -> Iterator[tuple]:
    """Rows of ``ENTRY`` from one chunk: ``at`` are places, ``first`` their hashes; ``second`` more
    bits of them, or None in the round of the blocks; ``block``, whether a place starts a block.

    Hashes seen twice in the chunk are sent without a place; those places are a row without hashes.
    """
    order = np.argsort(first, kind="stable") if second is None else np.lexsort((second, first))
    h, p = first[order], at[order]
    new = np.r_[True, h[1:] != h[:-1]]
    if second is not None:
        second = second[order] >> np.uint64(24)
        new[1:] |= second[1:] != second[:-1]
    start = np.flatnonzero(new)
    count = np.diff(np.r_[start, len(h)])
    extra = np.maximum.reduceat(block[p].astype(np.uint64), start) if second is None else second[start]
    distinct, place = h[start], np.where(count == 1, p[start] + 1, 0).astype(np.uint64)
    # the top 32 bits deal the hashes, so the number of buckets may grow with the input
    top = distinct >> np.uint64(max(0, bits - 32))
    bucket = (top * np.uint64(buckets) >> np.uint64(min(bits, 32))).astype(np.int64)
    edges = np.flatnonzero(np.r_[True, np.diff(bucket) != 0, True])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        hashes = packed(distinct[a:b], -(-bits // 8))
        hashes = len(hashes).to_bytes(4, "little") + hashes + packed(extra[a:b], 1 if second is None else 5)
        yield int(bucket[a]), int(b - a), chunk, hashes, packed(place[a:b], 5)
    if (count > 1).any():
        yield -1, 0, chunk, b"", listed(np.sort(p[np.repeat(count > 1, count)]))


def shared(rows: list[tuple], anchors: bool, bits: int) -> list[tuple[int, np.ndarray]]:
    """chunk and places of one bucket's hashes that occur twice or more (``anchors``: one in a block);
    ``rows`` are (n, chunk, hashes, places).
    """
    n = np.array([r[0] for r in rows], np.int64)
    ends = np.cumsum(n)
    h, extra, place = np.empty(ends[-1], np.uint64), np.empty(ends[-1], np.uint8 if anchors else np.uint64), np.empty(ends[-1], np.int64)
    for (count, _, data, at), end in zip(rows, ends, strict=True):
        cut = 4 + int.from_bytes(data[:4], "little")
        h[end - count : end] = unpacked(data[4:cut], -(-bits // 8))
        extra[end - count : end] = unpacked(data[cut:], 1 if anchors else 5)
        place[end - count : end] = unpacked(at, 5).view(np.int64)
    order = np.argsort(h, kind="stable") if anchors else np.lexsort((extra, h))
    h, extra = h[order], extra[order]
    new = np.r_[True, h[1:] != h[:-1]]
    if not anchors:
        new[1:] |= extra[1:] != extra[:-1]
    start = np.flatnonzero(new)
    hit = np.add.reduceat(np.where(place[order] == 0, 2, 1), start) > 1
    if anchors:
        hit &= np.maximum.reduceat(extra, start) > 0
    found = np.sort(order[np.repeat(hit, np.diff(np.r_[start, len(h)]))])
    found = found[place[found] > 0]
    parts = zip(rows, np.searchsorted(found, ends - n), np.searchsorted(found, ends), strict=True)
    return [(row[1], place[found[a:b]] - 1) for row, a, b in parts if a < b]


def by_chunk(found: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    """``FOUND`` rows of chunks and places."""
    joined: dict[int, list] = {}
    for chunk, at in found:
        joined.setdefault(chunk, []).append(at)
    lists = [listed(np.sort(np.concatenate(v))) for v in joined.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(joined), pa.int64()), pa.array(lists, pa.binary())], ["chunk", "places"])


def looked_through(anchors: bool, bits: int):
    """A function of batches sorted by bucket: ``FOUND`` rows.  One bucket is in memory at a time, and
    up to ``GATHER`` places of those before it.
    """

    def answer(bucket: int, rows: list[tuple]) -> list[tuple[int, np.ndarray]]:
        return [(chunk, places([at])) for _, chunk, _, at in rows] if bucket < 0 else shared(rows, anchors, bits)

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, found = None, [], []
        for batch in batches:
            for part in slices(batch):
                for bucket, *row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if held and (bucket != now or bucket < 0):
                        found += answer(now, held)
                        held = []
                        if sum(len(f[1]) for f in found) > GATHER:
                            yield by_chunk(found)
                            found = []
                    now = bucket
                    held.append(tuple(row))
        yield by_chunk(found + (answer(now, held) if held else []))

    return look


def dealt(rows: DataFrame, n_words: int, anchors: bool) -> DataFrame:
    """chunk and its lists of places of stretches (``anchors``) or windows that are shared.

    ``rows`` has chunk and words; for windows also hits, the places of shared stretches.
    ``n_words`` is the number of words of all texts; the number of buckets follows it.
    """
    buckets = max(64, n_words // BUCKET + 1)
    bits = min(64, (n_words // BLOCK + 1).bit_length() + SPARE) if anchors else 64
    length = BLOCK if anchors else WINDOW

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                chunk, words, *hits = (c[0].as_py() for c in part.columns)
                texts_ = opened(words).split(b"\n")
                hashes = [word_hashes(t) for t in texts_]
                sizes = np.array([len(w) for w in hashes], np.int64)
                joined = np.concatenate(hashes)
                place = np.arange(len(joined))
                wanted = place + length <= np.repeat(np.cumsum(sizes), sizes)
                if not anchors:
                    wanted &= spread(places(hits[0]), WINDOW - BLOCK, 0, len(joined))
                at = np.flatnonzero(wanted)
                if not len(at):
                    continue
                first, second = rolling(joined, length, BASES[0])[at], None
                if anchors:
                    first = first >> np.uint64(64 - bits)
                else:
                    joined = np.concatenate([word_hashes(t, SEEDS[1]) for t in texts_])
                    second = rolling(joined, length, BASES[1])[at]
                block = (place - np.repeat(np.cumsum(sizes) - sizes, sizes)) % BLOCK == 0
                columns = zip(*entries(chunk, block, at, first, second, buckets, bits), strict=True)
                types = pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["bucket", "n", "chunk", "hashes", "places"])

    # what a chunk found by itself has no bucket and stays by its chunk
    deal = F.when(F.col("n") == 0, F.xxhash64("chunk")).otherwise(F.xxhash64("bucket"))
    sent = rows.mapInArrow(send, ENTRY).withColumn("_deal", deal)
    looked = sent.repartition("_deal").drop("_deal").sortWithinPartitions("bucket").mapInArrow(looked_through(anchors, bits), FOUND)
    return settle(looked.groupBy("chunk").agg(F.collect_list("places").alias("hits")))


def spread(at: np.ndarray, before: int, after: int, n: int) -> np.ndarray:
    """A mask of n places: true from ``before`` places before each of ``at`` to ``after`` after."""
    steps = np.bincount(np.maximum(at - before, 0), minlength=n + 1) - np.bincount(np.minimum(at + after + 1, n), minlength=n + 1)
    return np.cumsum(steps[:n]) > 0


def kept_words(digest: bool):
    """A function of batches of chunks with the starts of repeated windows: a row per document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                ids, n_words, words, starts = (c[0].as_py() for c in part.columns)
                # a repeated window lies within its document, so the mask needs no ends of documents
                gone, at, out = spread(places(starts), 0, WINDOW - 1, n_words), 0, []
                for doc_id, text in zip(ids, opened(words).split(b"\n"), strict=True):
                    own = text.split()
                    mask = gone[at : at + len(own)]
                    at += len(own)
                    if mask.any():
                        text = b" ".join(w for w, g in zip(own, mask.tolist(), strict=True) if not g)
                    out.append((doc_id, len(own), int(mask.sum()), hashlib.sha256(text).hexdigest() if digest else text.decode()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def substring_dedup(docs: DataFrame, digest: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed and kept, the words that are left
    joined by one space (``digest``: kept_sha256 of it).

    A word goes if a window of ``WINDOW`` words that covers it also starts anywhere else, in the same
    document or another, in the input as it is.  Null texts have no words; shorter texts than
    a window lose none.  Repeated rows count as documents of their own.  Other columns are not
    looked at.
    """
    chunks = chunked(docs)
    n_words = int(chunks.agg(F.sum("n_words")).first()[0] or 0)
    hits = dealt(chunks.select("chunk", "words"), n_words, anchors=True)
    met = chunks.join(hits.hint("shuffle_hash"), "chunk").select("chunk", "words", "hits")
    starts = dealt(met, n_words, anchors=False)
    joined = chunks.join(starts.hint("shuffle_hash"), "chunk", "left").select("doc_ids", "n_words", "words", "hits")
    found = joined.mapInArrow(kept_words(digest), "doc_id long, n_words long, n_removed long, kept string")
    return found.withColumnRenamed("kept", "kept_sha256") if digest else found


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir), digest=True)
