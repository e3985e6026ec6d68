"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is cut into segments; the bit counts of the segments are its place in a grid.  One
differing bit changes one count by one, so the Manhattan distance of two places is a lower
bound of the Hamming distance.  For a radius of 2 the range join is an equi-join: two places
at distance 2 or less share a cell within distance 1 of both, so each fingerprint enters its own
cell and the cells one step away.  Pairs in a cell are then verified by the bits themselves.

Only distinct fingerprints are joined; copies of a text have one fingerprint.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treemill.llm.common import discard, documents, packed, per_row, released, settle, sifted, slices, stored, texts, unpacked, word_chunks
from treemill.llm.components import components

SEGMENTS, RADIUS, SHINGLE = 16, 2, 3
SEED = 42
#: Fingerprints in a cell from which it is divided.
CROWD = 200
#: Words of a shingle of near copies, and the factor that joins their hashes.
WORDS, MIX = 5, np.uint64(0x9E3779B97F4A7C15)
#: Documents that share a shingle from which they are dealt into cells instead of paired.
DENSE = 50
#: Shingles of a bucket in which they are counted, about.
COUNTED = 1 << 21
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a text; 0 if it has no word."""
    from xxhash import xxh64_intdigest

    sums, n, left = np.zeros(64, np.int64), 0, []
    for words in word_chunks((text or "").encode().translate(LOWER)):
        words = left + words
        hashes = [xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(shingle)), strict=False)]
        left = words[max(0, len(words) - shingle + 1) :]
        n += len(hashes)
        sums += _bit_sums(np.array(hashes, "<u8"), 64)
    if not n:
        if not left:
            return 0
        n, sums = 1, _bit_sums(np.array([xxh64_intdigest(b" ".join(left), SEED)], "<u8"), 64)
    return int(np.packbits(2 * sums > n, bitorder="little").view("<u8")[0])


def _bit_sums(hashes: np.ndarray, bits: int) -> np.ndarray:
    found = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, bits)
    return found.sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint (signed 64-bit) of every row; null counts as empty."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return per_row(texts(docs), lambda doc_id, text: (doc_id, signed(fingerprint(text, shingle))), "doc_id long, fingerprint long")


def cells(rows: DataFrame, bits: str, segments: int, width: int) -> DataFrame:
    """``rows`` once for each cell within one step of the place of column ``bits``.

    ``cell`` holds the segments' bit counts; ``step`` tells the row's own cell (0) from the
    neighbours (1 and up).
    """
    size = width.bit_length()
    digit = lambda i: F.bit_count(F.shiftrightunsigned(bits, i * width).bitwiseAND(F.lit((1 << width) - 1))).cast("long")
    place = sum((digit(i) * F.lit(1 << (size * i)) for i in range(1, segments)), digit(0))
    steps = [F.struct(F.lit(0).alias("step"), F.col("_place").alias("cell"))]
    for i in range(segments):
        count = F.shiftrightunsigned("_place", size * i).bitwiseAND(F.lit((1 << size) - 1))
        steps.append(F.when(count < width, F.struct(F.lit(2 * i + 1).alias("step"), (F.col("_place") + F.lit(1 << (size * i))).alias("cell"))))
        steps.append(F.when(count > 0, F.struct(F.lit(2 * i + 2).alias("step"), (F.col("_place") - F.lit(1 << (size * i))).alias("cell"))))
    near = F.explode(F.filter(F.array(*steps), lambda s: s.isNotNull()))
    placed = rows.withColumn("_place", place).withColumn("_near", near)
    return placed.select(*rows.columns, "_near.step", "_near.cell")


def pairs_in(members: DataFrame, keys: Iterable[str], apart: Column) -> DataFrame:
    """Pairs (a, b) of the rows' ``id`` with a < b that share ``keys`` and meet ``apart``, a
    condition on the sides ``a`` and ``b``.

    Two with one place share all their cells; they are paired in their own cell only.
    """
    once = (F.col("a.step") != F.col("b.step")) | (F.col("a.step") == 0)
    on = once & (F.col("a.id") < F.col("b.id")) & apart
    for k in keys:
        on = (F.col(f"a.{k}") == F.col(f"b.{k}")) & on
    return members.alias("a").join(members.alias("b"), on).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def differing(*columns: str) -> Column:
    return sum((F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in columns), F.lit(0))


def links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """All pairs (a, b) of different fingerprints that differ in ``RADIUS`` bits or fewer.

    A cell of more than ``crowd`` members is divided by whole thirds of the bits: two
    fingerprints at distance 2 share one of three thirds, so nothing is lost.
    """
    members = settle(cells(distinct.select(F.col("fingerprint").alias("id")), "id", SEGMENTS, 64 // SEGMENTS))
    crowds = settle(members.groupBy("cell").count().where(F.col("count") > crowd).select("cell"))
    calm = members.join(crowds, "cell", "left_anti")
    thirds = [F.struct(F.lit(n).alias("n"), F.shiftrightunsigned("id", at).bitwiseAND(F.lit((1 << size) - 1)).alias("bits")) for n, (at, size) in enumerate([(0, 21), (21, 21), (42, 22)])]
    divided = members.join(crowds, "cell", "left_semi").withColumn("third", F.explode(F.array(*thirds))).select("id", "step", "cell", "third.n", "third.bits")
    near = differing("id") <= RADIUS
    return pairs_in(calm, ["cell"], near).unionByName(pairs_in(divided, ["cell", "n", "bits"], near)).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (signed), component_id.

    The component is the least doc_id reachable over links of 2 differing bits or fewer.  Texts
    without a word have fingerprint 0 and link like any other.  Rows whose doc_id is null are
    linked too but are never the least; if all are, the component is null.
    """
    prints = settle(fingerprints(docs, shingle))
    classes = settle(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    linked = components(links(classes.select("fingerprint"), crowd)).select(F.col("node").alias("fingerprint"), F.col("component").alias("root"))
    rooted = settle(classes.join(linked, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(least, "root").select("fingerprint", "component_id"), "fingerprint").select("doc_id", "fingerprint", "component_id")


def shingle_set(text: str | None, size: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles, A-Z in lower case.

    Fewer words than ``size`` are one shingle; a text without a word has none.
    """
    from xxhash import xxh3_64_intdigest

    chunks = word_chunks((text or "").encode().translate(LOWER))
    words = np.concatenate([np.zeros(0, np.uint64), *(np.fromiter((xxh3_64_intdigest(w, SEED) for w in c), np.uint64, len(c)) for c in chunks)])
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1 if size else 0, np.uint64)
    for i in range(size):
        out = out * MIX + words[i : len(out) + i]
    return np.unique(out)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets of steps (see ``short_set``) have four fifths or more of all in common."""
    both = len(np.intersect1d(np.cumsum(a), np.cumsum(b), assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def short_hashes(text: str | None) -> np.ndarray:
    """``shingle_set`` by the upper 40 bits of the hashes, sorted.

    Two texts of 500 shingles have one chance in four million that unequal ones count as equal.
    """
    return np.unique(shingle_set(text) >> np.uint64(24))


def short_set(text: str | None) -> bytes:
    """``short_hashes`` as packed steps."""
    return packed(np.diff(short_hashes(text), prepend=np.uint64(0)), 5)


def packs(marked: DataFrame) -> DataFrame:
    """The sets of a batch of texts as one row: pack (its number), ids and sizes of the sets, n (all their
    shingles) and steps, the sets end to end as packed steps.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = itertools.count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for rows in slices(batch, 4 << 20):
                ids, sets = rows.column(0).to_pylist(), [short_hashes(t) for t in rows.column(1).to_pylist()]
                steps = np.concatenate([np.zeros(0, np.uint64), *(np.diff(s, prepend=np.uint64(0)) for s in sets)])
                row = {"pack": next(number), "ids": ids, "sizes": [len(s) for s in sets], "n": len(steps), "steps": packed(steps, 5)}
                yield pa.RecordBatch.from_pylist([row], schema)

    schema = pa.schema([("pack", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("n", pa.int64()), ("steps", pa.binary())])
    return marked.select("doc_id", "text").mapInArrow(run, "pack long, ids array<long>, sizes array<int>, n long, steps binary")


def opened_pack(sizes: list[int], steps: bytes) -> list[np.ndarray]:
    """The sets of a pack."""
    return [np.cumsum(s) for s in np.split(unpacked(steps, 5), np.cumsum(sizes)[:-1])] if sizes else []


def shingle_counts(sets: DataFrame, size: int = COUNTED) -> DataFrame:
    """pack, bucket and counts: in how many sets of all the pack's distinct shingles are, in their order.

    A bucket is a range of hashes with about ``size`` shingles, so its rows fit into a task.
    """
    shingles = sets.agg(F.sum("n")).first()[0] or 0
    shift = np.uint64(40 - (shingles // size).bit_length())

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *opened_pack(row["sizes"], row["steps"])]), return_counts=True)
                buckets, at = np.unique(found >> shift, return_index=True)
                parts = list(zip(np.split(found, at[1:]), np.split(counts, at[1:]), strict=True)) if len(at) else []
                steps = [packed(np.diff(f, prepend=f[:1]), 5) for f, _ in parts]
                columns = [[row["pack"]] * len(parts), buckets.astype(np.int64), [int(f[0]) for f, _ in parts], steps, [packed(c.astype(np.uint64), 8) for _, c in parts]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    def count(rows: pa.Table) -> pa.Table:
        firsts, steps, counts = (rows.column(c).to_pylist() for c in ("first", "steps", "counts"))
        found = [np.cumsum(unpacked(s, 5)) + np.uint64(f) for f, s in zip(firsts, steps, strict=True)]
        _, place = np.unique(np.concatenate(found), return_inverse=True)
        totals = np.bincount(place, weights=np.concatenate([unpacked(c, 8) for c in counts])).astype(np.uint64)
        each = np.split(totals[place], np.cumsum([len(f) for f in found])[:-1])
        return rows.select(["pack", "bucket"]).append_column("counts", pa.array([packed(c, 8) for c in each], pa.binary()))

    fields = pa.schema([("pack", pa.int64()), ("bucket", pa.int64()), ("first", pa.int64()), ("steps", pa.binary()), ("counts", pa.binary())])
    dealt = sets.select("pack", "sizes", "steps").mapInArrow(spread, "pack long, bucket long, first long, steps binary, counts binary")
    return dealt.groupBy("bucket").applyInArrow(count, "pack long, bucket long, counts binary")


def prefixes(sets: DataFrame, counts: DataFrame) -> DataFrame:
    """token, id, n and place of the first shingles of each document's set of n that another set has too.

    All sets are in one order, rare shingles (by ``counts``) first.  Two sets that are alike have four
    fifths of n in common, so the first n - 4/5 n + 1 of each hold a common one.  Those that no
    other set has can't be it, so a set with fewer than 4/5 n of others has no row but its own: a
    row with place -1 stands for the whole set; its token is the set's hash.
    """
    from xxhash import xxh3_64_intdigest

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens, ids, sizes, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
                sets = opened_pack(row["sizes"], row["steps"])
                _, place = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
                seen = np.concatenate([np.zeros(0, np.uint64), *(unpacked(c["counts"], 8) for c in row["counts"] or [])])[place]
                for doc_id, own, n in zip(row["ids"], sets, np.split(seen, np.cumsum(row["sizes"])[:-1]), strict=True):
                    most = len(own) - -(-4 * len(own) // 5) + 1
                    alone = int((n == 1).sum())
                    first = np.lexsort((own, n))[alone:most]
                    tokens += [np.array([xxh3_64_intdigest(own.tobytes(), SEED)], np.uint64), own[first]]
                    ids.append(np.full(len(first) + 1, doc_id, np.int64))
                    sizes.append(np.full(len(first) + 1, len(own), np.int32))
                    at += [np.array([-1], np.int32), np.arange(alone, alone + len(first), dtype=np.int32)]
                columns = [np.concatenate(tokens).view(np.int64), *map(np.concatenate, (ids, sizes, at))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "id", "n", "place"])

    each = counts.groupBy("pack").agg(F.sort_array(F.collect_list(F.struct("bucket", "counts"))).alias("counts"))
    return sets.join(each.hint("shuffle_hash"), "pack", "left").select("ids", "sizes", "steps", "counts").mapInArrow(run, "token long, id long, n int, place int")


def repeated(rows: DataFrame) -> DataFrame:
    """``rows`` whose token another row has too.

    Counted before the shuffle; rows whose token surely is alone stay where they are.
    """
    tokens = settle(rows.groupBy("token").count().where("count > 1").select("token"))
    maybe, _ = sifted(rows, "token", tokens)
    return maybe.join(tokens, "token", "left_semi")


def open_between(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` (token, id, n, place) of tokens that two or more components share, with ``root``,
    the component of the id; ``members``, the token's rows; and ``minor``, whether the row is in
    another component than most of them.
    """
    found = stored(rows.select("token", "id", "n", "place").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")))
    counts = found.groupBy("token", "root").agg(F.count("*").alias("own"))
    counts = counts.groupBy("token").agg(F.sum("own").alias("members"), F.max(F.struct("own", "root"))["root"].alias("main"), F.count("*").alias("roots"))
    counts = settle(counts.where("roots > 1").drop("roots"))
    still = stored(found.join(counts, "token").withColumn("minor", F.col("root") != F.col("main")).drop("main"))
    discard(found)
    return still


def candidates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct pairs (a, b) of ids that share ``keys``, are in different components and can be alike.

    One of two components at least is minor, so the many members of a large one never meet.  Sets
    of n and m shingles that are alike have 4/9 (n + m) in common or more; their first common
    one, at places i and j, leaves n - i and m - j at most.
    """
    on = (F.col("a.root") != F.col("b.root")) & (~F.col("b.minor") | (F.col("a.id") < F.col("b.id")))
    on &= 9 * F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place")) >= 4 * (F.col("a.n") + F.col("b.n"))
    for k in keys:
        on = (F.col(f"a.{k}") == F.col(f"b.{k}")) & on
    pairs = rows.where("minor").alias("a").join(rows.alias("b"), on)
    return pairs.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()


def alike_pairs(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets of shingles are alike."""
    pairs = stored(pairs)
    ids = stored(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    maybe, _ = sifted(marked, "doc_id", ids)
    whole = maybe.join(ids.hint("shuffle_hash"), F.col("doc_id") == F.col("id")).select("id", "text")
    sets = stored(per_row(whole, lambda i, text: (i, short_set(text)), "id long, shingles binary"))
    side = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"{c}_set"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_set", "b_set")
    judged = per_row(both, lambda a, b, x, y: (a, b, alike(unpacked(x, 5), unpacked(y, 5))), "a long, b long, near boolean")
    found = settle(judged.where("near").select("a", "b"))
    for table in (sets, ids, pairs):
        discard(table)
    return found


def merged(*links: DataFrame) -> DataFrame:
    """id and root over all ``links`` (a, b)."""
    joined = components(functools.reduce(DataFrame.unionByName, links))
    return joined.select(F.col("node").alias("id"), F.col("component").alias("root"))


def near_copies(docs: DataFrame, crowd: int = DENSE) -> DataFrame:
    """doc_id and component_id (the least doc_id reachable) of rows with a near copy.

    Links are those of ``near_duplicates`` (fingerprints that differ in 2 bits or fewer) and, since
    texts that share four fifths of their five-word shingles may differ in a dozen bits, every
    pair of texts whose five-word shingles are alike, four fifths or more of all in common:

    1. All shingles of all texts are counted.  Documents are indexed by the first shingles of their
       sets, rare ones first; two alike sets share one of them (an exact prefix filter), and
       where they do bounds what they share.
    2. A shingle of more than ``crowd`` documents is not paired at once: these are dealt at
       random into cells of ``crowd`` or fewer, pairs of a cell are verified and joined.  Rounds of
       this end when the pairs of different components that are left there are no more than the
       index's rows, or a round leaves over half of them.
    3. All pairs of different components that are left are verified, whatever their number.

    So a group of copies is not expanded into its pairs, and no link is lost.  Texts without a
    word are copies of each other; null doc_ids are left out; rows of one doc_id are one document.
    """
    known = near_duplicates(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    marked = texts(docs).where("doc_id is not null").withColumn("text", F.coalesce("text", F.lit("")))
    sets = stored(packs(marked))
    counts = stored(shingle_counts(sets))
    index = stored(prefixes(sets, counts))
    for table in (sets, counts):
        discard(table)
    met = stored(repeated(index))
    discard(index)
    wholes = met.where("place < 0")
    equal = wholes.join(wholes.groupBy("token", "n").agg(F.min("id").alias("b")), ["token", "n"]).select(F.col("id").alias("a"), "b")
    roots = merged(known, equal)
    left, before = open_between(met.where("place >= 0"), roots), None
    discard(met)
    for turn in itertools.count():
        many = F.when(F.col("minor") & (F.col("members") > crowd), F.col("members"))
        rows, pairs = left.agg(F.count("*"), F.coalesce(F.sum(many), F.lit(0))).first()
        if pairs <= rows or (before and 2 * pairs > before):
            break
        before = pairs
        cells = F.pow(2.0, F.ceil(F.log2(F.col("members") / crowd))).cast("long")
        dealt = left.where(F.col("members") > crowd).withColumn("cell", F.pmod(F.xxhash64("id", F.lit(turn)), cells))
        new = alike_pairs(candidates(dealt, ["token", "cell"]), marked)
        roots = merged(roots.select(F.col("id").alias("a"), F.col("root").alias("b")), new)
        left, old = open_between(left, roots), left
        discard(old)
    rest = alike_pairs(candidates(left, ["token"]), marked)
    discard(left)
    return merged(roots.select(F.col("id").alias("a"), F.col("root").alias("b")), rest).toDF("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, crowd: int = DENSE) -> DataFrame:
    """``docs`` with the least doc_id of each group of near copies; all columns as they are.

    Rows with a null doc_id stay.
    """
    with released(docs.sparkSession):
        gone = settle(near_copies(docs, crowd).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct())
    maybe, stay = sifted(docs, "doc_id", gone)
    return maybe.join(gone.hint("shuffle_hash"), F.col("doc_id") == F.col("_gone"), "left_anti").union(stay)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
