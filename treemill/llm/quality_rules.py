"""Quality rules as a learned decision list.

Statistics of each text come first.  From labelled documents a list is learned by sequential
covering: a rule (a conjunction of thresholds) is grown by information gain on two thirds
of the rows, pruned on the rest, kept if it is precise there, and what it covers is taken out
before the next rule is grown.  The list becomes one ordered Spark CASE expression.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from treemill.llm.common import bounded_batches, documents, per_row, slices, texts

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS = BASE + ("n_upper", "n_shouts", "n_chars_read", "n_lines")
STATS_SCHEMA = "doc_id long, " + ", ".join(f"{s} long" for s in STATS)
#: What rules may test; shares, so that the length of a text does not matter by itself.
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "upper_per_char": "n_upper / greatest(word_chars, 1)",
    "shouts_per_word": "n_shouts / greatest(n_words, 1)",
    "repeats_per_word": "n_repeat_words / greatest(n_words, 1)",
    "dup_lines_share": "n_dup_lines / greatest(n_lines, 1)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}
#: Labelled rows the list is learned from, at most; those with the smallest hash of doc_id (a bound of the broadcast, too).
SAMPLE = 20_000
MAX_RULES, MAX_TESTS, PRECISION = 12, 4, 0.9
SYMBOLS = str.maketrans("", "", "#*$%&|<>")


def text_stats(text: str | None) -> tuple[int, ...]:
    """The statistics of one text; a null text has none of anything."""
    if not text:
        return (0,) * len(STATS)
    data = text.encode()
    words = data.split()
    n = len(words)
    chars = len(text) - len(data) + len(data.translate(None, b" \t\n\r\v\f"))
    lines = [x for x in text.split("\n") if x.encode().split()] if "\n" in text else [text] * (n > 0)
    upper = sum(map(str.isupper, text)) if not text.isascii() else len(text) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    repeated = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            counts: dict = {}
            for w in windows:
                counts[w] = counts.get(w, 0) + 1
            covered = bytearray(n)
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    covered[i : i + 3] = b"\1\1\1"
            repeated = sum(covered)
    return n, chars, len(text) - len(text.translate(SYMBOLS)), len(lines) - len(set(lines)), repeated, upper, text.count("!"), len(text), len(lines)


def stats(docs: DataFrame) -> DataFrame:
    """doc_id and ``STATS`` of every row."""
    return per_row(texts(docs), lambda doc_id, text: (doc_id, *text_stats(text)), STATS_SCHEMA)


def grow(x: np.ndarray, bad: np.ndarray) -> list[tuple[int, bool, float]]:
    """Tests (feature, whether at least, threshold) of a new rule, added one by one by gain."""
    tests: list[tuple[int, bool, float]] = []
    inside = np.ones(len(x), bool)
    while len(tests) < MAX_TESTS and not bad[inside].all():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        best = (0.0, None)
        for f in range(x.shape[1]):
            values = x[inside, f]
            for cut in np.unique(np.quantile(values, np.linspace(0.02, 0.98, 49))):
                for above in (True, False):
                    hit = values >= cut if above else values <= cut
                    p, n = bad[inside][hit].sum(), (~bad[inside][hit]).sum()
                    if p:
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, above, float(cut)))
        if best[1] is None:
            break
        tests.append(best[1])
        inside &= covers(x, [best[1]])
    return tests


def covers(x: np.ndarray, tests: list[tuple[int, bool, float]]) -> np.ndarray:
    found = np.ones(len(x), bool)
    for f, above, cut in tests:
        found &= x[:, f] >= cut if above else x[:, f] <= cut
    return found


def worth(x: np.ndarray, bad: np.ndarray, tests: list) -> float:
    hit = covers(x, tests)
    p, n = bad[hit].sum(), (~bad[hit]).sum()
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: np.ndarray, bad: np.ndarray, seed: int = 7) -> list[list[tuple[int, bool, float]]]:
    """The ordered rules that reject; none if no rule is precise enough or a class is missing."""
    rules: list = []
    order = np.random.default_rng(seed).permutation(len(x))
    x, bad = x[order], bad[order]
    while len(rules) < MAX_RULES and bad.sum() >= 8 and not bad.all():
        fold = np.arange(len(x)) % 3 == 2
        rule = grow(x[~fold], bad[~fold])
        while len(rule) > 1 and worth(x[fold], bad[fold], rule[:-1]) >= worth(x[fold], bad[fold], rule):
            rule = rule[:-1]
        if not rule:
            break
        hit = covers(x, rule)
        held = hit & fold
        if held.sum() < 4 or bad[held].mean() < PRECISION or bad[hit].mean() < PRECISION:
            break
        rules.append(rule)
        x, bad = x[~hit], bad[~hit]
    return rules


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[list[tuple[str, bool, float]]]:
    """Rules learned from the documents of at most ``sample`` labels, which are broadcast.

    Labels other than 0 and 1, and nulls, are left out; a doc_id with two labels counts with both.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", "quality")
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    rows = stats(texts(docs).join(F.broadcast(drawn.select("doc_id").distinct()), "doc_id", "left_semi"))
    picked = rows.join(F.broadcast(drawn), "doc_id").select("doc_id", "quality", *[F.expr(e).cast("double").alias(f) for f, e in FEATURES.items()]).collect()
    if not picked:
        return []
    picked.sort(key=lambda r: tuple(r))
    x = np.array([[r[f] for f in FEATURES] for r in picked])
    found = learn(x, np.array([r["quality"] == 0 for r in picked]))
    names = list(FEATURES)
    return [[(names[f], above, cut) for f, above, cut in rule] for rule in found]


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(rules: list[list[tuple[str, bool, float]]]) -> Column:
    """The list as one ordered CASE: false at the first rule that holds, else true."""
    case = F.when(base_failed(), F.lit(False))
    for rule in rules:
        holds = F.lit(True)
        for name, above, cut in rule:
            value = F.expr(FEATURES[name])
            holds = holds & (value >= cut if above else value <= cut)
        case = case.when(holds, F.lit(False))
    return case.otherwise(F.lit(True))


def judged(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, ``STATS``, base_failed and kept of every row of ``docs``.

    A null or empty text has no words and fails.  Without usable labels only the base decides.
    Other columns are not looked at.
    """
    rules = fit(docs, labels, sample)
    return stats(docs).withColumns({"base_failed": base_failed(), "kept": verdict(rules)})


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they are; no shuffle of the texts."""
    rules = fit(docs, labels, sample)
    names = docs.columns
    whole = docs.select(F.struct(*[docs[c] for c in names]).alias("_doc"), docs["text"].cast("string").alias("_text"))
    schema = StructType([whole.schema["_doc"], *[StructField(s, LongType()) for s in STATS]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                columns = zip(*map(text_stats, part.column("_text").to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("_doc"), *(pa.array(c, pa.int64()) for c in columns)], ["_doc", *STATS])

    bounded_batches(docs.sparkSession)
    passed = whole.mapInArrow(run, schema).where(verdict(rules))
    return passed.select(*[F.col("_doc").getField(c).alias(c) for c in names])


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", *BASE, "base_failed", "kept")
