"""Queries and pipeline stages against plain code on whole tables."""

import array
import collections
import hashlib
import re

from pyspark.sql import functions as F

from treemill.llm import bpe, mixing, quality_rules, secrets
from treemill.llm.common import stored

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(spark, data=DATA):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


def plain_stats(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_query(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    rules = quality_rules.fit(docs, labels)
    rows = quality_rules.op6(spark, DATA).collect()
    plain = texts(spark)
    assert len(rows) == len(plain)
    shares = {r.doc_id: r for r in quality_rules.stats(docs).selectExpr("doc_id", *[f"{e} AS {f}" for f, e in quality_rules.FEATURES.items()]).collect()}
    for r in rows:
        n, chars, symbols, dup, rep = plain_stats(plain[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        failed = n < 50 or 100 * rep > 50 * n
        rejected = any(all(shares[r.doc_id][f] >= cut if above else shares[r.doc_id][f] <= cut for f, above, cut in rule) for rule in rules)
        assert r.base_failed == failed and r.kept == (not failed and not rejected)


def test_secret_query(spark):
    assign = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    larger = "/root/testdata/sf0.01"  # the smallest table that has any
    plain, found = texts(spark, larger), 0
    for r in secrets.op9(spark, larger).collect():
        text = plain[r.doc_id]
        spans = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[1]) >= 6]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))
        base = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
        found += len(spans)
    assert found > 0


def test_secrets_of_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "token = abcdef " + "x " * 200_000 + "AKIA" + "A" * 20, "c"), (3, "token = abcdef", "d"), (3, "token = abcdef", "d")]
    found = secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert sorted((r.doc_id, [s.kind for s in r.spans]) for r in found) == [(1, []), (2, []), (3, ["assign"]), (3, ["assign"]), (3, ["assign", "access"])]


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stored(stage(spark, seen[-1], DATA)))
    raw, good, exact, near, mix, encoded = seen
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert all(df.columns == raw.columns for df in seen[1:-1])
    # quality: what the query keeps
    assert ids(good) == sorted(r.doc_id for r in quality_rules.op6(spark, DATA).where("kept").collect())
    # exact: the largest doc_id of each text
    best = collections.defaultdict(int)
    for r in good.collect():
        best[r.text] = max(best[r.text], r.doc_id)
    assert ids(exact) == sorted(best.values())
    # near: only documents of its input, every text that shares few shingles with all others stays
    kept = {r.doc_id: r.text for r in near.collect()}
    before = {r.doc_id: r.text for r in exact.collect()}
    assert kept.items() <= before.items()
    sets = {i: set(zip(*(WORD.findall(t.lower())[k:] for k in range(5)), strict=False)) for i, t in before.items()}
    for i in set(before) - set(kept):
        assert max(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in before if j != i) >= 0.5
    for i, a in sets.items():  # no two of those kept are near
        if i in kept:
            assert all(len(a & sets[j]) < 0.8 * len(a | sets[j]) for j in kept if j < i)
    # mixing: the words that the operator takes
    words = collections.Counter()
    for r in mix.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert dict(words) == {r.doc_id: r.taken for r in mixing.mix(near).where("taken > 0").collect()}
    # encoding: the library's ids
    library = Tokenizer.from_file(bpe.vocabulary_path())
    want = collections.Counter((r.doc_id, hashlib.sha256(array.array("I", library.encode(r.text, add_special_tokens=False).ids).tobytes()).hexdigest()) for r in mix.collect())
    assert collections.Counter((r.doc_id, r.ids_sha256) for r in encoded.collect()) == want
    assert encoded.count() == mix.count() and encoded.where(F.col("n_tokens") == 0).count() == 0
