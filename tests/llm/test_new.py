"""Spelling variants, fill-in-middle and byte-level BPE against plain ways to do the same."""

import base64
import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from treemill.llm import bpe, byte_bpe, fill_in_middle, simhash, spelling

SCHEMA = "doc_id long, text string, word string, n string, form string, prefix string, output string, ids string"
LONG = " ".join(f"Wörd{'abcdefgh'[i % 8]}{'xyz'[i % 3] * (i % 4)} é{i}" for i in range(40_000))
TEXTS = [None, "", " \n\t ", "a", "é", "ab <S> cd", "<P>", "don't <|endoftext|> stop\n\nnow  ", "中文字符 😀😀 ñandú x\xa0y", LONG, LONG, "𐞀𐞁 ᲊ x² ①", "same words here", "same words here", "a<", "S><M", "\x00\x01 �"]
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "y", "z", "p", "o", "i") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[12], (None, "null id", None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import public_tokenizers
    import tiktoken

    def make(name):
        with open(public_tokenizers.path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    return make


def test_empty_tables(docs):
    empty = docs.limit(0)
    for found in (spelling.spelling_variants(empty), fill_in_middle.fill_in_middle(empty), byte_bpe.encoded(empty), byte_bpe.digests(empty), fill_in_middle.digests(empty)):
        assert found.count() == 0


# fill-in-middle


def test_exceptions_convert_all_places():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab c\néß中😀\x00߿ࠀ￿") for _ in range(rng.randint(0, 30)))
        data = text.encode()
        index = fill_in_middle.Exceptions.of(data)
        assert index.points == len(text)
        for i in range(len(text) + 1):
            b = len(text[:i].encode())
            assert index.byte(i) == b and index.point(b) == i


def plain_fim(doc_id, text, share=90, first=20):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= share:
        return n, "plain", None, None, text
    if h4 % 100 < first:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


@pytest.mark.parametrize(("share", "first"), [(90, 20), (100, 100), (0, 0)])
def test_fill_in_middle(docs, share, first):
    found = fill_in_middle.fill_in_middle(docs, share=share, suffix_first=first)
    want = collections.Counter((r.doc_id, *plain_fim(r.doc_id, r.text, share, first)) for r in docs.collect())
    assert collections.Counter(map(tuple, found.collect())) == want
    back = collections.Counter(map(tuple, fill_in_middle.restored_texts(found).collect()))
    assert back == collections.Counter((r.doc_id, r.text or "") for r in docs.collect())


def test_fill_in_middle_forms_all_occur(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("é<"), F.col("id").cast("string"), F.lit(">x")).alias("text"))
    rows = fill_in_middle.fill_in_middle(df).collect()
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert all(fill_in_middle.restored(r.output.encode(), r.form).decode() == f"é<{r.doc_id}>x" for r in rows)


def test_fill_in_middle_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.sql(fill_in_middle.OP12_SQL)
    ours = fill_in_middle.op12(spark, DATA)
    assert sorted(ours.columns) == sorted(want.columns)
    assert sorted(map(repr, map(tuple, ours.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_fill_in_middle_takes_other_ids(spark):
    df = spark.createDataFrame([("a", "some text"), ("b", None)], "doc_id string, text string")
    assert {(r.doc_id, r.n) for r in fill_in_middle.fill_in_middle(df).collect()} == {("a", 9), ("b", 0)}


# byte-level BPE


def test_patterns_agree():
    import public_tokenizers

    assert public_tokenizers.PATTERN == bpe.PATTERN


def test_byte_bpe(docs, tiktoken_encoding):
    library = tiktoken_encoding(byte_bpe.RANKS)
    texts = docs.select("doc_id", "text").collect()
    want = collections.Counter((r.doc_id, tuple(library.encode_ordinary(r.text or ""))) for r in texts)
    found = byte_bpe.encoded(docs)
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in found.collect()) == want
    assert collections.Counter((r.doc_id, bytes(r.data)) for r in byte_bpe.decoded(found).collect()) == collections.Counter((r.doc_id, (r.text or "").encode()) for r in texts)


def test_byte_bpe_query(spark, tiktoken_encoding):
    library = tiktoken_encoding(byte_bpe.RANKS)
    sha = lambda data: hashlib.sha256(data).hexdigest()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    want = {i: (len(x := library.encode_ordinary(t)), sha(" ".join(map(str, x)).encode()), sha(t.encode())) for i, t in texts.items()}
    assert {r.doc_id: tuple(r)[1:] for r in byte_bpe.op13(spark, DATA).collect()} == want


@pytest.mark.parametrize("name", [byte_bpe.RANKS, "byte_bpe_multi_50k.tiktoken"])
def test_words_of_all_lengths(name, tiktoken_encoding, monkeypatch):
    library, own = tiktoken_encoding(name), byte_bpe.Merger(bpe.vocabulary_path(name))
    rng = random.Random(2)
    words = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("ab", "etaoin", "abcdefghijklmnopqrstuvwxyz", "aé中", "-=") for n in (1, 2, 7, 40, 255, 256, 300, 3000)]
    words += ["a" * 5001 + "b" * 900, "ab" * 2000, "=" * 1001, " " * 777 + "x", "x" + "ab" * 1000 + "a" * 300]
    monkeypatch.setattr(byte_bpe, "ROUNDS", 9000)  # more than one query for a word
    for word, ids in zip(words, own.encode(words), strict=True):
        assert list(byte_bpe.numbers(ids)) == library.encode_ordinary(word)
    # the slow way on all words, short ones too
    for word in words[:30]:
        assert list(byte_bpe.numbers(own.merged_long(word.encode()))) == library._core_bpe.encode_single_piece(word.encode())


def test_every_token_is_its_own_encoding(tiktoken_encoding):
    own = byte_bpe.Merger(bpe.vocabulary_path(byte_bpe.RANKS))
    tokens = [t for t in own.ranks if len(t) <= byte_bpe.LONG]
    assert own.merged(tokens) == [str(own.ranks[t]) for t in tokens]


def test_pieces_and_forgotten_words(tiktoken_encoding, monkeypatch):
    library, own = tiktoken_encoding(byte_bpe.RANKS), byte_bpe.Merger(bpe.vocabulary_path(byte_bpe.RANKS))
    for name, value in (("SLICE", 50), ("REMEMBER", 40), ("IDS", 7), ("PORTION", 30)):
        monkeypatch.setattr(byte_bpe, name, value)
    rng = random.Random(3)
    texts = ["".join(rng.choice(["word", " ", "\n", "'s", "é", "12", "...", " ", "  x", "ſ", "'"]) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert "".join(own.pieces(text)) == text
        assert list(byte_bpe.numbers(ids)) == library.encode_ordinary(text)
    assert own.decode([byte_bpe.numbers(i) for i in own.encode(texts)]) == [t.encode() for t in texts]


def test_rare_characters(tiktoken_encoding):
    library, own = tiktoken_encoding(byte_bpe.RANKS), byte_bpe.Merger(bpe.vocabulary_path(byte_bpe.RANKS))
    texts = ["".join(f"{chr(c)} {chr(c)}a0" for c in range(at, at + 0x200) if not 0xD800 <= c < 0xE000) for at in range(0, 0x32000, 0x200)]
    assert all(list(byte_bpe.numbers(i)) == library.encode_ordinary(t) for t, i in zip(texts, own.encode(texts), strict=True))


# spelling variants


def plain_variants(rows, shortest=5, seen=3, times=2, damaged=97):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % damaged == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= shortest and n >= seen}

    def close(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    by_size = collections.defaultdict(list)
    for w in words:
        by_size[len(w)].append(w)
    near = {w: [v for k in (-1, 0, 1) for v in by_size[len(w) + k] if close(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def test_variants_of_dense_words(spark):
    rng = random.Random(4)
    rows = [(i if i % 7 else None, " ".join("".join(rng.choice("aabÉé") for _ in range(rng.choice((2, 3, 4, 5)))) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = spelling.spelling_variants(df, shortest=2, seen=1, times=1.2, damaged=5)
    want = plain_variants(rows, 2, 1, 1.2, 5)
    assert {tuple(r) for r in found.collect()} == want
    assert any(w[1] and w[1] != w[2] for w in want)


def test_variants_of_odd_rows(docs, monkeypatch):
    monkeypatch.setattr(spelling, "CHUNK", 1000)
    monkeypatch.setattr(spelling, "HELD", 50)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {tuple(r) for r in spelling.spelling_variants(docs, shortest=3, seen=2).collect()} == plain_variants(rows, 3, 2)


def test_variants_of_a_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    found = spelling.op11(spark, DATA)
    assert {tuple(r) for r in found.select("word", "form", "root", "n", "n_near", "form_n").collect()} == plain_variants(rows)


def test_a_chain_of_forms(spark):
    words = [("abcdefgh" * 2)[:10]]
    for i in range(9):
        words.append(words[-1][:i] + "z" + words[-1][i + 1 :])
    text = " ".join(w for k, w in enumerate(words) for _ in range(3 * 2**k))
    found = {r.word: r for r in spelling.spelling_variants(spark.createDataFrame([(1, text)], "doc_id long, text string"), damaged=1 << 40).collect()}
    assert all(found[w].root == words[-1] for w in words) and found[words[0]].form == words[1]


def test_shingle_counts_of_all_texts(spark):
    """Counts are of every text, in packs and buckets of any size; texts with little in common have no rows but their own."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{w}" for w in rng.integers(0, 6, rng.integers(0, 30)))) for i in range(300)]
    rows += [(300 + i, " ".join(f"x{i}_{k}" for k in range(20)) + " " + " ".join(f"w{k}" for k in range(6))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = simhash.packs(docs).localCheckpoint()
    counts = simhash.shingle_counts(sets, 50).localCheckpoint()
    assert counts.select("bucket").distinct().count() > 8
    want = collections.Counter(t for _, text in rows for t in simhash.short_hashes(text).tolist())
    packs = {r.pack: sorted({t for s in simhash.opened_pack(r.sizes, r.steps) for t in s.tolist()}) for r in sets.collect()}
    found = collections.defaultdict(list)
    for r in counts.orderBy("pack", "bucket").collect():
        found[r.pack] += simhash.unpacked(bytes(r.counts), 8).tolist()
    assert len(packs) >= 3 and all(found[p] == [want[t] for t in tokens] for p, tokens in packs.items())
    index = simhash.prefixes(sets, counts)
    assert index.where("place < 0").count() == len(rows) and index.where("id >= 300 and place >= 0").count() == 0
