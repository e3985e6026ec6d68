"""Language identification in two steps: family first, then languages within the family.

Texts become counts of hashed byte n-grams (1 to 4 bytes, ASCII letters in lower case), square
rooted and scaled to length one.  A one-versus-rest linear support vector machine picks the
family; within it, one-versus-one machines vote, and their margins break ties.  All machines
are learned here by averaged subgradient steps on the hinge loss.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treemill.llm.common import documents, per_row, texts

#: Families by language code, fixed values; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "indic": "hi bn mr ne ur pa gu",
    "semitic": "ar he mt",
}
#: Buckets of the n-grams.
WIDTH = 1 << 12
#: Rows learned from, those with the smallest hash: so many of each language at most, so many in all
#: unless that is under ``LEAST`` of each language.
SAMPLE, IN_ALL, LEAST = 700, 4000, 4
#: Bytes whose n-grams are counted at a time.
STEP = 1 << 20
UNKNOWN = "und"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def family(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang.lower().split("-")[0] in codes.split()), lang)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def vector(text: str) -> np.ndarray:
    """The n-gram vector of a whole text."""
    data = b" " + b" ".join(text.encode().translate(LOWER).split()) + b" "
    counts = np.zeros(WIDTH)
    for at in range(0, len(data), STEP):
        b = np.frombuffer(data[at : at + STEP + 3], np.uint8).astype(np.uint32)
        h = b.copy()
        for n in range(1, 5):
            if n > 1:
                h = h[:-1] * np.uint32(0x01000193) ^ b[n - 1 :]
            used = h[: min(len(h), STEP)]
            counts += np.bincount((used * np.uint32(0x9E3779B1) + np.uint32(n * 7919)) >> np.uint32(32 - WIDTH.bit_length() + 1), minlength=WIDTH)
    found = np.sqrt(counts)
    return (found / max(np.linalg.norm(found), 1e-12)).astype(np.float32)


def machine(x: np.ndarray, y: np.ndarray, epochs: int = 6, penalty: float = 1e-4, seed: int = 3) -> np.ndarray:
    """Weights (the last one is the bias) of a linear SVM; y is +1 or -1."""
    rng = np.random.default_rng(seed)
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w, mean, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    balance = np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y < 0).sum(), 1)))
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 32)):
            t += 1
            hit = rows[y[rows] * (x[rows] @ w) < 1]
            rate = 1 / (penalty * (t + 1000))
            w *= 1 - rate * penalty
            if len(hit):
                w += rate * (y[hit] * balance[hit]) @ x[hit] / len(rows)
            mean += (w - mean) / t
    return mean.astype(np.float32)


def squash(margin: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(2 * margin, -30, 30))))


class Model:
    def __init__(self, x: np.ndarray, langs: list[str]):
        self.tree: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            self.tree.setdefault(family(lang), []).append(lang)
        lang, fam = np.array(langs), np.array([family(v) for v in langs])
        self.families = sorted(self.tree)
        self.first = np.array([machine(x, np.where(fam == f, 1.0, -1.0)) for f in self.families]) if len(self.families) > 1 else None
        self.pairs = {}
        for f in self.families:
            for a, b in itertools.combinations(self.tree[f], 2):
                own = (lang == a) | (lang == b)
                self.pairs[a, b] = machine(x[own], np.where(lang[own] == a, 1.0, -1.0))

    def predict(self, text: str) -> tuple[str, float]:
        v = np.append(vector(text), np.float32(1))
        score, f = 1.0, self.families[0]
        if self.first is not None:
            margins = self.first @ v
            best = int(np.argmax(margins))
            score, f = squash(margins[best]), self.families[best]
        votes = {a: [0, 0.0] for a in self.tree[f]}
        for a, b in itertools.combinations(self.tree[f], 2):
            margin = float(self.pairs[a, b] @ v)
            won = a if margin >= 0 else b
            votes[won][0] += 1
            votes[a][1] += margin
            votes[b][1] -= margin
        lang = max(sorted(votes), key=lambda k: votes[k])
        margins = [float(self.pairs[a, b] @ v) * (1 if a == lang else -1) for a, b in itertools.combinations(self.tree[f], 2) if lang in (a, b)]
        return lang, score * squash(min(margins)) if margins else score


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model of all languages, from up to ``sample`` rows of each; None if no row can be learned from.

    Rows are those with a language and a letter in the text that are not held out; a null
    doc_id counts as held out.
    """
    known = texts(docs, "lang").where(F.col("lang").isNotNull() & F.coalesce(~held_out(), F.lit(False)))
    known = known.where(F.col("text").rlike(r"\p{L}")).withColumn("order", F.xxhash64("doc_id", F.lit(5)))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    sample = max(LEAST, min(sample, IN_ALL // len(counts)))
    # the hash is uniform, so a limit on it leaves a little over ``sample`` rows of each language
    spark = docs.sparkSession
    share = spark.createDataFrame([(lang, min(1.0, 1.2 * sample / n + 4 / n)) for lang, n in counts.items()], "lang string, share double")
    near = known.join(F.broadcast(share), "lang").where(F.pmod("order", F.lit(1 << 20)) / (1 << 20) < F.col("share"))
    rows = per_row(near.select("lang", "order", "text"), lambda lang, order, text: (lang, order, vector(text).tobytes()), "lang string, order long, v binary").collect()
    taken: dict[str, int] = {}
    x, y = [], []
    for r in sorted(rows, key=lambda r: (r["lang"], r["order"], r["v"])):
        if taken.setdefault(r["lang"], 0) < sample:
            taken[r["lang"]] += 1
            x.append(np.frombuffer(r["v"], np.float32))
            y.append(r["lang"])
    return Model(np.array(x), y)


def identified(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Every whole text is read.  A text that is null or has no letter gets ``und`` and score 0, as
    does every text where nothing could be learned.  Every language with a usable row is learned;
    the rows grow with the number of languages (4 of each at least) and not with the corpus.  Equal
    and long texts count like any other.  Only doc_id, text and, to learn from, lang are looked at.
    """
    model = fit(docs, sample)

    def one(doc_id, held, text):
        lang, score = model.predict(text) if model and has_letter(text) else (UNKNOWN, 0.0)
        return doc_id, held, lang, score

    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(True)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return per_row(rows, one, "doc_id long, held_out boolean, lang_pred string, score double")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(documents(spark, sf_dir))
