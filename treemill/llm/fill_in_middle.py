"""Fill-in-middle: a text is cut at two places and its middle moved to the end.

Cuts are counted in code points, texts are stored in UTF-8.  A sparse index of the exceptions, the
characters of more than one byte, turns one into the other: it has the place of each such
character and the bytes in excess of one for each character up to there, and a binary search in it
converts a cut.  Between exceptions (and everywhere in ASCII texts) a place is a sum.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treemill.llm.common import bounded_batches, documents, per_row

MARKS = (b"<P>", b"<S>", b"<M>")
#: Of 100 texts those that are rearranged, and of 100 of these those with the suffix in front.
REARRANGED, SUFFIX_FIRST = 90, 20


@dataclass(frozen=True)
class Exceptions:
    """``at``: byte places of the multibyte characters; ``before``: bytes in excess before each of
    them, and last in the whole text; ``size``: its bytes.
    """

    at: np.ndarray
    before: np.ndarray
    size: int

    @classmethod
    def of(cls, data: bytes) -> Exceptions:
        if data.isascii():
            return cls(np.zeros(0, np.int64), np.zeros(1, np.int64), len(data))
        raw = np.frombuffer(data, np.uint8)
        at = np.flatnonzero(raw >= 0xC0)
        lead = raw[at]
        before = np.zeros(len(at) + 1, np.int64)
        np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0), out=before[1:])
        return cls(at, before, len(data))

    @property
    def points(self) -> int:
        return self.size - int(self.before[-1])

    def byte(self, point: int) -> int:
        """The byte place of a code point."""
        return point + int(self.before[np.searchsorted(self.at - self.before[:-1], point)])

    def point(self, byte: int) -> int:
        """The code point that begins at a byte place."""
        return byte - int(self.before[np.searchsorted(self.at, byte)])


def numbers(key: str) -> list[int]:
    """Four numbers below 2**32 from a hash of ``key``."""
    digest = hashlib.sha256(key.encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def rearranged(data: bytes, key: str, share: int = REARRANGED, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, bytes]:
    """Code points, form, code points of prefix and middle (null if plain), and output of one text.

    Empty texts and texts that hold a mark stay plain, so that every output can be undone.
    """
    index = Exceptions.of(data)
    n = index.points
    h1, h2, h3, h4 = numbers(key)
    if not data or any(m in data for m in MARKS) or h3 % 100 >= share:
        return n, "plain", None, None, data
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = index.byte(low), index.byte(high)
    p, s, m = MARKS
    if h4 % 100 < suffix_first:
        return n, "spm", low, high - low, b"".join((s, data[b:], p, data[:a], m, data[a:b]))
    return n, "psm", low, high - low, b"".join((p, data[:a], s, data[b:], m, data[a:b]))


def restored(output: bytes, form: str) -> bytes:
    """The text that ``rearranged`` made an output of."""
    if form == "plain":
        return output
    p, s, m = MARKS
    first, second = (s, p) if form == "spm" else (p, s)
    one, _, rest = output[len(first) :].partition(second)
    other, _, middle = rest.partition(m)
    return b"".join((other, middle, one) if form == "spm" else (one, middle, other))


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, the key of its cuts and the text's bytes; other columns are not looked at."""
    bounded_batches(docs.sparkSession)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.select("doc_id", key.alias("key"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("data"))


def fill_in_middle(docs: DataFrame, seed: int = 1, share: int = REARRANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row, by a hash of seed and doc_id.

    A null text counts as empty, an empty one stays plain; texts of any length are cut whole.
    Equal doc_ids cut at the same numbers, so repeated rows give repeated results; a null doc_id
    is hashed as an empty string.  Any type of doc_id will do.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    one = lambda doc_id, key, data: (doc_id, *(x := rearranged(data, key, share, suffix_first))[:4], x[4].decode())
    return per_row(_keyed(docs, seed), one, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored_texts(outputs: DataFrame) -> DataFrame:
    """doc_id and text from rows of ``fill_in_middle``."""
    kind = outputs.schema["doc_id"].dataType.simpleString()
    rows = outputs.select("doc_id", "form", F.col("output").cast("binary").alias("output"))
    return per_row(rows, lambda doc_id, form, output: (doc_id, restored(output, form).decode()), f"doc_id {kind}, text string")


def digests(docs: DataFrame, seed: int = 1) -> DataFrame:
    """``fill_in_middle`` with SHA-256 digests of output and restored text in place of the output."""

    def one(doc_id, key, data):
        *facts, output = rearranged(data, key)
        return (doc_id, *facts, hashlib.sha256(output).hexdigest(), hashlib.sha256(restored(output, facts[1])).hexdigest())

    kind = docs.schema["doc_id"].dataType.simpleString()
    return per_row(_keyed(docs, seed), one, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))


OP12_SQL = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
hashed AS (
  SELECT doc_id, t, length(t) AS n,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) % (length(t) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (length(t) + 1) AS b,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS c, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS d
  FROM texts
),
formed AS (
  SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form,
    substring(t, 1, least(a, b)) AS prefix, substring(t, least(a, b) + 1, greatest(a, b) - least(a, b)) AS middle, substring(t, greatest(a, b) + 1) AS suffix
  FROM hashed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(a, b) END AS prefix_chars, CASE WHEN form <> 'plain' THEN greatest(a, b) - least(a, b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM formed
"""
