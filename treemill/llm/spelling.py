"""Spelling variants: words of a corpus grouped by permuterm rotations.

A word of L characters, closed by a mark, has a rotation for each place: what follows the place, the
mark, what stands before it.  Words that differ by one replaced character share the rotation that
ends just before that character, which is then a prefix of both words' rotations; the word
without the character has that prefix as a whole rotation.  So rows of (prefix, word) are sorted by
prefix and a scan of each group gives every member its neighbours: the other words that skip a
character there, and the one word that skips none.

A prefix and the skipped character make a word, so a group has a word for each character of the
alphabet and one more at most (91 for the letters below), however large the corpus.  Groups are
summed up to a count and the best neighbour of each member; no pairs are written.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treemill.llm.common import CHUNK, bounded_batches, documents, settle

RUN = re.compile("[a-zÀ-ÿ]+")
#: Closes a word; no letter of ``RUN``.
MARK = "$"
#: One occurrence of so many, by a hash of document and run, loses a character.
DAMAGED = 97
#: Code points of a word and its occurrences, at least; how many times more frequent its form is.
SHORTEST, SEEN, TIMES = 5, 3, 2
#: Distinct words that a task counts before it writes the counts out.
HELD = 200_000


def text_pieces(data: bytes) -> Iterator[str]:
    """A text with A-Z in lower case, in pieces of about ``CHUNK`` bytes, cut after white space or
    between other ASCII characters that are no letters.
    """
    at = 0
    while at < len(data):
        end = at + CHUNK
        while end < len(data) and (data[end] >= 0x80 or data[end : end + 1].isalpha()):
            end += 1
        yield data[at:end].lower().decode()
        at = end


def run_counts(docs: DataFrame, damaged: int = DAMAGED) -> DataFrame:
    """word and n: runs of letters of all texts, a character missing where the hash of document and
    run says so; counted per task first.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), F.col("text").cast("binary").alias("data")).where("data is not null")
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for key, data in zip(batch[0].to_pylist(), batch[1], strict=True):
                prefix = zlib.crc32(f"{key}:".encode())
                for piece in text_pieces(data.as_buffer().to_pybytes()):
                    for word, n in Counter(RUN.findall(piece)).items():
                        h = zlib.crc32(word.encode(), prefix)
                        if h % damaged == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        total[word] += n
                    if len(total) > HELD:
                        yield pa.RecordBatch.from_pydict({"word": list(total), "n": list(total.values())}, schema)
                        total.clear()
        if total:
            yield pa.RecordBatch.from_pydict({"word": list(total), "n": list(total.values())}, schema)

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def rotations(words: DataFrame) -> DataFrame:
    """prefix, word, n, whole and first for each rotation of each word: the prefix that skips one
    character (whole: none); first: the character isn't the one before it, so that of the
    equal ways to lose one of a row of equal characters only one counts.
    """
    size = F.length("word")
    places = F.sequence(F.lit(0), size)
    left, right, char = F.substring("word", F.lit(1), F.col("at")), lambda skip: F.substring("word", F.col("at") + 1 + skip, size), F.substring("word", F.col("at") + 1, F.lit(1))
    spread = words.select("word", "n", F.explode(places).alias("at"))
    marked = F.struct(F.concat(right(0), F.lit(MARK), left).alias("prefix"), F.lit(True).alias("whole"), F.lit(False).alias("first"))
    skipped = F.struct(F.concat(right(1), F.lit(MARK), left).alias("prefix"), F.lit(False).alias("whole"), ((F.col("at") == 0) | (char != F.substring("word", F.col("at"), F.lit(1)))).alias("first"))
    kinds = F.when(F.col("at") < size, F.array(marked, skipped)).otherwise(F.array(marked))
    return spread.select("word", "n", F.explode(kinds).alias("r")).select("r.prefix", "word", "n", "r.whole", "r.first")


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near and best (minus n, word) of words (word, n) that have a near word.

    One shuffle by prefix, in whose sorted groups the window runs; then counts by word.
    """
    group = Window.partitionBy("prefix")
    ranked = group.orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = F.struct((-F.col("n")).alias("minus_n"), F.col("word").alias("word"))
    seen = rotations(words).select(
        "word", "whole", "first",
        F.count("*").over(ranked).alias("members"), F.max("whole").over(ranked).alias("has_whole"), F.sum(F.col("first").cast("int")).over(ranked).alias("firsts"),
        F.first(one).over(ranked).alias("top"), F.nth_value(one, 2).over(ranked).alias("second"),
    ).where("members > 1")
    others = F.col("members") - F.col("has_whole").cast("int") - 1
    near = F.when(F.col("whole"), F.col("firsts")).otherwise(others + (F.col("has_whole") & F.col("first")).cast("int"))
    best = F.when(F.col("top.word") == F.col("word"), F.col("second")).otherwise(F.col("top"))
    return seen.select("word", near.alias("near"), best.alias("best")).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of words with a form: forms are followed to the last by doubling.

    A form is ``TIMES`` as frequent as its word, so chains are as long as the logarithm of the
    largest count and the rounds as many as the logarithm of that.
    """
    found = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = found.select(F.col("word").alias("_via"), F.col("root").alias("_root"))
        moved = settle(found.join(onward, found["root"] == onward["_via"], "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("_moved")))
        found = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return found


def spelling_variants(docs: DataFrame, shortest: int = SHORTEST, seen: int = SEEN, times: int = TIMES, damaged: int = DAMAGED) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the texts.

    Words are runs of letters (A-Z lower-cased) of ``shortest`` code points at least that occur
    ``seen`` times.  ``form`` is the most frequent word at one inserted, deleted or replaced
    character, of equally frequent ones the least, if it occurs ``times`` as often; else null.
    Null and empty texts have no words, texts of any length are read whole, repeated rows count
    again; a null doc_id is hashed as an empty string.  Any type of doc_id will do; other columns
    are not looked at.
    """
    words = settle(run_counts(docs, damaged).where((F.length("word") >= shortest) & (F.col("n") >= seen)))
    near = neighbours(words).select(F.col("word").alias("_word"), "n_near", "best")
    fits: Column = -F.col("best.minus_n") >= times * F.col("n")
    judged = settle(words.join(near, words["word"] == near["_word"], "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.word")).alias("form"), F.when(fits, -F.col("best.minus_n")).alias("form_n")))
    last = roots(judged.where("form is not null")).select(F.col("word").alias("_word"), "root")
    return judged.join(last, judged["word"] == last["_word"], "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))
