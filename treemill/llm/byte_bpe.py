"""Byte-level BPE in DuckDB: a recursive query per partition merges the tokens of words.

Each match of the pattern is a word.  The words of a batch that a task has not seen become rows
(word, place, token), from single bytes on.  A recursive query joins neighbours with the table of
merges, takes each word's leftmost pair of least rank and contracts it, until no word has a pair
left; an ordered aggregation reads off the tokens.  Decoding joins ids with the vocabulary and
aggregates the tokens' bytes in order.

A word of over ``LONG`` bytes would take a round for each merge, so its rounds contract more: each
pair that has the least rank within ``REACH`` tokens on both sides (no token is longer, so
nothing that comes before it in rank order can reach it), in runs of equal pairs every other one from
the left.  That gives the same tokens where a merge only makes pairs of higher rank, as in any
vocabulary that was learned by merging.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treemill.llm.bpe import ASCII_PATTERN, COMMON, PATTERN, vocabulary_path
from treemill.llm.common import documents, per_batch, texts

RANKS = "byte_bpe_50k.tiktoken"
#: Bytes of a word up to which each round contracts one pair of it.
LONG = 256
#: Bytes of words that one recursive query takes; a word is never cut.
PORTION = 1 << 20
#: Rows that the rounds of one query on long words hold; more rounds follow in another query.
ROUNDS = 1 << 22
#: Words whose tokens a task keeps: half of them new, half those used before (only speed depends on it).
REMEMBER = 500_000
#: Bytes of text that are encoded at a time, and characters of a piece of a text.
SLICE = 2 << 20
#: Ids that are decoded by one query.
IDS = 500_000
#: Memory of a task's DuckDB.
MEMORY = "400MB"

LAST = """
SELECT word, string_agg(CAST(tok AS VARCHAR), ' ' ORDER BY pos) AS ids FROM step JOIN (SELECT word, max(round) AS round FROM step GROUP BY word) USING (word, round)
GROUP BY word ORDER BY word
"""
#: One pair of each word and round: its row takes the merged token and skips the row after it.
SHORT_WORDS = f"""
WITH RECURSIVE step AS (
  SELECT word, pos, tok, next_tok, pos + 1 AS next_pos, 0 AS round FROM letters
  UNION ALL
  SELECT s.word, s.pos, CASE WHEN s.pos = h.pos THEN h.merged ELSE s.tok END,
    CASE WHEN s.pos = h.pos THEN gone.next_tok WHEN s.next_pos = h.pos THEN h.merged ELSE s.next_tok END,
    CASE WHEN s.pos = h.pos THEN gone.next_pos ELSE s.next_pos END, s.round + 1
  FROM step s
  JOIN (
    SELECT word, min(m.merged) AS merged, arg_min(pos, m.merged * {2 * LONG}::BIGINT + pos) AS pos, arg_min(next_pos, m.merged * {2 * LONG}::BIGINT + pos) AS next_pos
    FROM step JOIN merges m ON m.a = tok AND m.b = next_tok GROUP BY word
  ) h ON h.word = s.word
  JOIN step gone ON gone.word = h.word AND gone.pos = h.next_pos
  WHERE s.pos <> h.next_pos
) {LAST}
"""
#: All pairs that are least within reach; at most $rounds rounds.
LONG_WORDS = """
WITH RECURSIVE step AS (
  SELECT word, pos, tok, 0 AS round FROM letters
  UNION ALL
  SELECT word, pos, CASE WHEN take THEN merged ELSE tok END, round + 1 FROM (
    SELECT *, coalesce(lag(take) OVER w, false) AS gone FROM (
      SELECT *, merged IS NOT NULL AND row_number() OVER r % 2 = 1 AND min(low) OVER r = merged AS take FROM (
        SELECT *, sum(new) OVER w AS run FROM (
          SELECT *, min(merged) OVER (PARTITION BY word ORDER BY pos ROWS BETWEEN $reach PRECEDING AND $reach FOLLOWING) AS low,
            min(merged) OVER (PARTITION BY word) AS least, CASE WHEN merged IS DISTINCT FROM lag(merged) OVER w THEN 1 ELSE 0 END AS new
          FROM (
            SELECT s.*, m.merged FROM (SELECT *, lead(tok) OVER (PARTITION BY word ORDER BY pos) AS next_tok FROM step WHERE round < $rounds) s
            LEFT JOIN merges m ON m.a = s.tok AND m.b = s.next_tok
          ) WINDOW w AS (PARTITION BY word ORDER BY pos)
        ) WHERE least IS NOT NULL WINDOW w AS (PARTITION BY word ORDER BY pos)
      ) WINDOW r AS (PARTITION BY word, run ORDER BY pos)
    ) WINDOW w AS (PARTITION BY word ORDER BY pos)
  ) WHERE NOT gone
)
SELECT word, pos, tok, round FROM step JOIN (SELECT word, max(round) AS round FROM step GROUP BY word) USING (word, round) ORDER BY word, pos
"""
DECODE = "SELECT doc, string_agg(shown, '' ORDER BY pos) AS shown FROM ids JOIN tokens ON tok = id GROUP BY doc"


class Kinds(dict):
    """Stands in for characters whose class differs between Unicode versions: what ``tiktoken``
    takes for a letter, a number or white space becomes one that all versions agree on.
    """

    def __init__(self):
        import tiktoken

        single = {bytes([b]): b for b in range(256)}
        self.common = re.compile(COMMON).fullmatch
        self.tests = [(tiktoken.Encoding(kind, pat_str=kind, mergeable_ranks=single, special_tokens={}).encode_ordinary, stand) for kind, stand in ((r"\p{L}", "a"), (r"\p{N}", "0"), (r"\s", " "))]

    def __missing__(self, point: int) -> str:
        char = chr(point)
        self[point] = char if self.common(char) else next((stand for test, stand in self.tests if test(char)), "‰")
        return self[point]


class Merger:
    """A vocabulary of byte-level BPE in DuckDB, with the words that it has encoded."""

    def __init__(self, path: str):
        import duckdb
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        ranks, reach = self.ranks, max(map(len, self.ranks))
        merges = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY})
        self._table("merges", pa.table([pa.array(c, pa.int32()) for c in zip(*merges, strict=True)], ["a", "b", "merged"]))
        # a byte is shown as the character of its number
        self._table("tokens", pa.table([pa.array(ranks.values(), pa.int32()), pa.array([t.decode("latin-1") for t in ranks])], ["id", "shown"]))
        self.reach = reach
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.find, self.find_ascii = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN).findall
        self.finditer, self.common, self.kinds = regex.compile(PATTERN).finditer, re.compile(COMMON).fullmatch, None
        self.border = re.compile(r"[!-~][ \n]").search
        self.known: dict[str, str] = {}
        self.before: dict[str, str] = {}

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("rows", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM rows")
        self.db.unregister("rows")

    def _asked(self, sql: str, name: str, rows: pa.Table) -> pa.Table:
        self.db.register(name, rows)
        found = self.db.sql(sql).to_arrow_table()
        self.db.unregister(name)
        return found

    def words(self, text: str) -> list[str]:
        """The matches of the pattern."""
        if text.isascii():
            return self.find_ascii(text)
        if self.common(text):
            return self.find(text)
        if self.kinds is None:
            self.kinds = Kinds()
        return [text[m.start() : m.end()] for m in self.finditer(text.translate(self.kinds))]

    def _letters(self, words: list[bytes]) -> pa.Table:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        tok = self.single[np.frombuffer(b"".join(words), np.uint8)]
        place = np.arange(len(tok)) - np.repeat(ends - sizes, sizes)
        after = np.append(tok[1:], -1).astype(np.int32)
        after[ends - 1] = -1
        return pa.table({"word": np.repeat(np.arange(len(words), dtype=np.int32), sizes), "pos": place.astype(np.int32), "tok": tok, "next_tok": after})

    def merged(self, words: list[bytes]) -> list[str]:
        """The decimal ids, joined by spaces, of words of ``LONG`` bytes at most."""
        return self._asked(SHORT_WORDS, "letters", self._letters(words))["ids"].to_pylist()

    def merged_long(self, word: bytes) -> str:
        """The same for one word of any length."""
        rows = self._letters([word]).drop_columns("next_tok")
        while True:
            rounds = max(1, ROUNDS // rows.num_rows)
            rows = self._asked(LONG_WORDS.replace("$reach", str(self.reach)).replace("$rounds", str(rounds)), "letters", rows)
            if rows["round"][0].as_py() < rounds:
                return " ".join(map(str, rows["tok"].to_pylist()))
            rows = rows.drop_columns("round")

    def learn(self, words: set[str]) -> None:
        """Puts the ids of ``words`` into ``known``."""
        portion, names, size = [], [], 0
        for name in words:
            word = name.encode()
            if word in self.ranks:
                self.known[name] = str(self.ranks[word])
            elif len(word) > LONG:
                self.known[name] = self.merged_long(word)
            else:
                portion.append(word)
                names.append(name)
                size += len(word)
                if size > PORTION:
                    self.known.update(zip(names, self.merged(portion), strict=True))
                    portion, names, size = [], [], 0
        if portion:
            self.known.update(zip(names, self.merged(portion), strict=True))

    def pieces(self, text: str) -> Iterator[str]:
        """A text in pieces of about ``SLICE`` characters; no match of the pattern goes from a mark or
        letter to white space, so cuts are made there.
        """
        at = 0
        while len(text) - at > SLICE and (m := self.border(text, at + SLICE)):
            yield text[at : m.start() + 1]
            at = m.start() + 1
        yield text[at:]

    def encode(self, texts: list[str]) -> list[str]:
        """The decimal ids of each text, joined by spaces."""
        found: list[list[str]] = [[] for _ in texts]
        queue, size = [], 0
        for n, text in enumerate(texts):
            for piece in self.pieces(text):
                queue.append((n, piece))
                size += len(piece)
                if size > SLICE:
                    self._encode(queue, found)
                    queue, size = [], 0
        self._encode(queue, found)
        return [" ".join(filter(None, x)) for x in found]

    def _encode(self, queue: list[tuple[int, str]], found: list[list[str]]) -> None:
        cut = [self.words(piece) for _, piece in queue]
        words = set().union(*cut)
        if len(self.known) + len(words) > REMEMBER // 2:
            self.known, self.before = {}, self.known
        new = words.difference(self.known)
        again = new.intersection(self.before)
        self.known.update(zip(again, map(self.before.__getitem__, again), strict=True))
        self.learn(new - again)
        for (n, _), c in zip(queue, cut, strict=True):
            found[n].append(" ".join(map(self.known.__getitem__, c)))

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids."""
        found: list[list[bytes]] = [[] for _ in ids]
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) for x in ids])
        tok = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
        for at in range(0, len(tok), IDS):
            part = slice(at, at + IDS)
            rows = self._asked(DECODE, "ids", pa.table({"doc": doc[part], "pos": np.arange(len(tok[part]), dtype=np.int32), "tok": tok[part]}))
            for n, shown in zip(rows["doc"].to_pylist(), rows["shown"].to_pylist(), strict=True):
                found[n].append(shown.encode("latin-1"))
        return list(map(b"".join, found))


@functools.lru_cache(2)
def merger(path: str) -> Merger:
    """The merger of a file, kept by each worker process from task to task."""
    return Merger(path)


def numbers(ids: str) -> np.ndarray:
    return np.fromstring(ids, np.int32, sep=" ")


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ids (an array) of every row; special tokens are ordinary text.

    A null or empty text has no tokens; texts of any length are encoded whole, repeated rows give
    repeated results.  Any type of doc_id will do, null too; other columns are not looked at.  A
    single word (a match of the pattern) takes some 100 bytes of memory for each of its bytes.
    """
    kind, name = docs.schema["doc_id"].dataType.simpleString(), path or vocabulary_path(RANKS)

    def many(own: Merger, rows):
        found = map(numbers, own.encode([text or "" for _, text in rows]))
        return [(doc_id, len(ids), ids) for (doc_id, _), ids in zip(rows, found, strict=True)]

    return per_batch(texts(docs), many, f"doc_id {kind}, n_tokens long, ids array<int>", lambda: merger(name), SLICE)


def decoded(encodings: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and data, the bytes that the ids of each row of ``encoded`` stand for; null ids: none."""
    kind, name = encodings.schema["doc_id"].dataType.simpleString(), path or vocabulary_path(RANKS)

    def many(own: Merger, rows):
        found = own.decode([np.array(ids or (), np.int32) for _, ids in rows])
        return [(doc_id, data) for (doc_id, _), data in zip(rows, found, strict=True)]

    return per_batch(encodings.select("doc_id", F.col("ids").cast("array<int>").alias("ids")), many, f"doc_id {kind}, data binary", lambda: merger(name), SLICE)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and SHA-256 digests of the decimal ids and of the decoded bytes."""
    kind, name = docs.schema["doc_id"].dataType.simpleString(), path or vocabulary_path(RANKS)

    def many(own: Merger, rows):
        found = own.encode([text or "" for _, text in rows])
        ids = list(map(numbers, found))
        sha = lambda data: hashlib.sha256(data).hexdigest()
        return [(doc_id, len(n), sha(x.encode()), sha(data)) for (doc_id, _), x, n, data in zip(rows, found, ids, own.decode(ids), strict=True)]

    return per_batch(texts(docs), many, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda: merger(name), SLICE)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
