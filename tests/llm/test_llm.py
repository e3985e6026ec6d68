"""The operators against brute force, with nulls, empty and long texts, ties and repeated rows."""

import array
import collections
import hashlib
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from treemill.llm import bpe, components, exact_dedup, language_id, licenses, mixing, quality_rules, resampling, secrets, simhash, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, row int, key int"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
SHARED = " ".join(f"passage{i}" for i in range(60))
TEXTS = [None, "", "   \n\t ", "a", "a b", "A  b", "the same text here", "the same text here", LONG, LONG, f"x y {SHARED} z", f"other {SHARED}", f"{SHARED} {SHARED}", "é ß 中文 \U0001f600 word", "don't <|endoftext|> stop\n\nnow  ", "a b"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, None, "x", 1, 2) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [rows[6], (None, "null id", None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(8)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


def test_empty_tables(spark, empty, labels):
    none = labels.limit(0)
    for found in (
        exact_dedup.exact_dedup(empty), mixing.mix(empty), quality_rules.judged(empty, labels), quality_rules.judged(empty, none), bpe.encoded(empty), secrets.secrets(empty),
        simhash.near_duplicates(empty), simhash.near_copies(empty), language_id.identified(empty), resampling.resampled(empty, labels, 0.5), substring_dedup.substring_dedup(empty),
        licenses.license_scan(empty.withColumn("path", F.lit("a/b"))), mixing.mixed_texts(empty), exact_dedup.drop_duplicates(empty), simhash.drop_near_copies(empty),
    ):
        assert found.count() == 0


def test_exact_dedup(docs):
    rows = exact_dedup.exact_dedup(docs, winners=2, counters=16).collect()
    groups = collections.defaultdict(list)
    for r in docs.collect():
        groups[r.text or ""].append(r.doc_id)
    sizes = sorted((len(g), max((x for x in g if x is not None), default=None) or -1) for g in groups.values() for _ in g)
    assert sorted((r.group_size, -1 if r.keep_id is None else r.keep_id or -1) for r in rows) == sizes
    assert sum(r.kept for r in rows) == len(groups)
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_mix(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    assert all(r.taken <= 2 * r["size"] for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    for of in by.values():
        assert sum(r["size"] for r in of) == of[0].source_size
        assert abs(sum(r.taken for r in of) - of[0].target) <= 0.05 * of[0].target + 30
    weights = dict(zip(sorted(by, key=lambda s: (s is None, s)), (5, 2, 1, 5), strict=False))
    sizes = {s: of[0].source_size for s, of in by.items()}
    want, left, free = {}, 1.5 * sum(sizes.values()), set(sizes)
    while free:
        level = left / sum(weights[s] for s in free)
        full = {s for s in free if level * weights[s] > 2 * sizes[s]}
        if not full:
            want |= {s: level * weights[s] for s in free}
            break
        want |= {s: 2 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        free -= full
    assert {s: of[0].target for s, of in by.items()} == pytest.approx(want)
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(docs.repartition(3)).collect()))
    assert mixing.mixed_texts(docs).columns == docs.columns


def test_mix_reaches_the_targets_of_small_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS", 20)  # large blocks, as a large corpus has
    sizes = {"big": (60, 1000), "s1": (1, 10), "s2": (5, 20), "s3": (40, 50), None: (3, 7)}
    rows = [(f"{name} {k}", name, n) for name, (count, n) in sizes.items() for k in range(count)]
    docs = spark.createDataFrame([(i, " ".join(["w"] * n), name) for i, (_, name, n) in enumerate(rows)], "doc_id long, text string, source string")
    found = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(found) == 5 and all(r.taken > 0 and abs(r.taken - r.target) <= 1 for r in found)


def test_text_stats():
    text = "a b c a b c\n# x |\n# x |\n\n \n"
    n, chars, symbols, dup, rep, *_ = quality_rules.text_stats(text)
    assert (n, chars, symbols, dup) == (12, 12, 4, 1)
    assert rep == 12
    assert quality_rules.text_stats(None)[:5] == (0, 0, 0, 0, 0)


def test_decision_list_learns_a_threshold():
    rng = np.random.default_rng(0)
    x = rng.random((900, len(quality_rules.FEATURES)))
    rules = quality_rules.learn(x, x[:, 0] > 0.7)
    assert rules and all(t[0] == 0 for r in rules for t in r[:1])
    hit = np.any([quality_rules.covers(x, r) for r in rules], axis=0)
    assert (hit == (x[:, 0] > 0.7)).mean() > 0.95


def test_quality_keeps_rows(docs, labels):
    assert quality_rules.judged(docs, labels).count() == docs.count()
    assert quality_rules.keep_good(docs, labels).columns == docs.columns


def test_bpe_matches_the_library(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    for r in bpe.encoded(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert bytes(r.ids) == array.array("I", ids).tobytes() and r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False) == (r.text or "")


def test_bpe_random_words():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(bpe.vocabulary_path()), bpe.Codec(bpe.vocabulary_path())
    rng = np.random.default_rng(5)
    texts = ["".join(chr(c) for c in rng.choice([*range(32, 127), 10, 233, 1234, 0x558, 0x4E2D, 0x1F600], 300)) for _ in range(50)]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids == array.array("I", library.encode(text, add_special_tokens=False).ids).tobytes()


def token(prefix, body):
    value, digits = __import__("zlib").crc32(body.encode()), ""
    while value:
        value, d = divmod(value, 62)
        digits = secrets.DIGITS[d] + digits
    return prefix + body + digits.rjust(6, "0")


def test_secrets():
    good, bad = token("ghp_", "A" * 30), "ghp_" + "A" * 36
    head = __import__("base64").urlsafe_b64encode(json.dumps({"alg": "HS256"}).encode()).decode().rstrip("=")
    text = f'é PassWord = "abc123" token:xy api_key=zzzzzz {good} {bad} AKIA{"B" * 16} AKIA{"B" * 15} {"0f" * 12} {head}.eyJhIjoxfQ.sig ſecret=abcdefgh'
    found = secrets.spans(secrets.automaton(), text)
    assert [k for _, _, k in found] == ["assign", "assign", "tagged", "access", "hex", "jwt"]
    for kind, pattern, least in (("assign", secrets.ASSIGN, 6), ("access", secrets.ACCESS, 20), ("hex", re.compile("[0-9a-f]+"), 24)):
        want = [m.span() for m in pattern.finditer(text) if len(m[2] if kind == "assign" else m[0]) >= least]
        assert [(s, e) for s, e, k in found if k == kind] == want
    assert secrets.spans(secrets.automaton(), None) == []


def brute_print(text):
    from xxhash import xxh64_intdigest

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("crowd", [200, 1])
def test_simhash(spark, crowd):
    rng = np.random.default_rng(3)
    texts = [t for t in TEXTS if t is not LONG] + [" ".join(rng.choice(list("abcde"), 3)) for _ in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    prints = [brute_print(t) for t in texts]
    least = list(range(len(texts)))
    for _ in texts:
        least = [min(least[j] for j in range(len(texts)) if (prints[i] ^ prints[j]).bit_count() <= 2) for i in range(len(texts))]
    found = {r.doc_id: (r.fingerprint % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs, crowd=crowd).collect()}
    assert found == {i: (prints[i], least[i]) for i in range(len(texts))}


def test_links_of_planted_neighbours(spark):
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 300)]
    all_ = sorted(set(base + [x ^ (1 << int(rng.integers(62))) ^ (1 << int(rng.integers(62))) for x in base]))
    want = {(a, b) for i, a in enumerate(all_) for b in all_[i + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
    df = spark.createDataFrame([(x,) for x in all_], "fingerprint long")
    for crowd in (200, 1):
        assert {(r.a, r.b) for r in simhash.links(df, crowd).collect()} == want


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return set(zip(*(words[i:] for i in range(min(5, len(words)))), strict=False))


def alike_components(rows):
    """The least doc_id reachable over pairs with four fifths of their shingles in common, or
    fingerprints that differ in two bits or fewer.
    """
    sets, prints = {i: shingles(t) for i, t in rows}, {i: brute_print(t) for i, t in rows}
    root = {i: i for i in sets}
    for i in sorted(sets):
        todo = [i] if root[i] == i else []
        while todo:
            a = todo.pop()
            new = [b for b in sets if b > i and root[b] == b and (5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) or (prints[a] ^ prints[b]).bit_count() <= 2)]
            root |= dict.fromkeys(new, i)
            todo += new
    return {i: r for i, r in root.items() if r != i or list(root.values()).count(i) > 1}


@pytest.mark.parametrize("crowd", [50, 2])
def test_near_copies(spark, crowd):
    rng = np.random.default_rng(6)
    words = [f"word{i}" for i in range(5000)]
    rows = []
    for _ in range(12):
        text = list(rng.choice(words, 300))
        for edits in (0, 1, 2, 3, 12, 30):  # the last two keep about two thirds and a third
            copy = list(text)
            for at in rng.choice(300, edits, replace=False):
                copy[int(at)] = "edited"
            rows.append(" ".join(copy))
    rows += [" ".join(sorted(rows[0].split())), " ".join(sorted(rows[0].split(), reverse=True))]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.near_copies(docs, crowd).collect()}
    want = alike_components(list(enumerate(rows)))
    assert len(want) >= 48 and found == want
    assert simhash.drop_near_copies(docs, crowd).count() == len(rows) - sum(i != r for i, r in want.items())


def test_near_copies_of_whole_blocks(spark):
    rng = np.random.default_rng(8)
    words = lambda n: [f"u{x}" for x in rng.integers(0, 1 << 40, n)]
    footer, rows = words(60), []
    for n in (90, 200, 400):
        for common in (0.79, 0.805, 0.83, 0.86, 0.9, 0.95):
            for kind in ("appended", "truncated", "replaced", "footer"):
                text, more = words(n) + (footer if kind == "footer" else []), round(n * (1 / common - 1))
                half = round(n * (1 - common) / (1 + common))
                copy = {"appended": text + words(more), "truncated": text[: round(n * common)], "footer": text[:-more]}.get(kind)
                rows += [text, copy or text[: n // 3] + words(half) + text[n // 3 + half :]]
    rows = list(enumerate(map(" ".join, rows)))
    found = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == alike_components(rows) and len(found) > 90


def test_near_copies_of_large_groups(spark):
    """Thousands of links: hundreds of copies of one base that are alike in part only, and pairs
    within a group that are like nothing but their partner.
    """
    rng = np.random.default_rng(9)
    base, rows = [f"b{i}" for i in range(200)], []
    for n, edits in ((300, 3), (60, 12)):
        for _ in range(n):
            text = list(base)
            for at in rng.choice(200, edits, replace=False):
                text[int(at)] = f"e{rng.integers(1 << 40)}"
            rows += [text] + [text[:-1] + ["end"]] * (edits == 12)
    rows = list(enumerate(map(" ".join, rows)))
    want = alike_components(rows)
    for crowd in (50, 4):
        found = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), crowd).collect()}
        assert found == want and len(set(want.values())) > 10


def test_near_copies_odd_rows(docs):
    unique = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    found = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert found == alike_components(list(unique.items()))
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 1


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def without_repeats(rows):
    """(doc_id, n_words, n_removed, digest of what is kept) of each (doc_id, text), sorted."""
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    seen = collections.Counter(tuple(w[i : i + 35]) for _, w in words for i in range(len(w) - 34))
    out = []
    for doc_id, w in words:
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        out.append((doc_id or 0, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out)


def removed(found):
    return sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in found.collect())


def test_substring_dedup(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert removed(substring_dedup.substring_dedup(docs, digest=True)) == without_repeats(rows)


@pytest.mark.parametrize("bucket", [400_000, 300])
def test_substring_dedup_of_a_whole_table(spark, monkeypatch, bucket):
    monkeypatch.setattr(substring_dedup, "BUCKET", bucket)  # small ones: over a thousand buckets
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert removed(substring_dedup.op4(spark, "/root/testdata/sf0.01")) == without_repeats(rows)


def test_language_id(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en"), (10**6 + 1, "", None), (10**6 + 2, "123 !", "en"), (None, "the and of", "en")], "doc_id long, text string, lang string")
    found = language_id.identified(table.select("doc_id", "text", "lang").unionByName(odd), sample=60)
    rows = found.join(table.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.95
    rest = {r.doc_id: r for r in found.where("doc_id is null or doc_id >= 1000000").collect()}
    assert [rest[10**6 + i].lang_pred for i in range(3)] == ["und"] * 3
    assert all(0 <= r.score <= 1 for r in found.collect())


def test_language_id_learns_every_language(spark):
    """More than 200 languages, each with letters of its own."""
    rows = [(40 * k + i, " ".join(f"{chr(0x4E00 + 7 * k)}{chr(0x4E00 + 7 * k + i % 3)}" for _ in range(20)), f"x{k}") for k in range(230) for i in range(6)]
    found = language_id.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    hit = {r.doc_id: r.lang_pred for r in found.collect()}
    assert len(set(hit.values())) > 220 and sum(hit[i] == lang for i, _, lang in rows) > 0.9 * len(rows)


def plain_buckets(text):
    """Bucket counts of words and pairs of words of a text, one by one."""
    from zlib import crc32

    words = [crc32(w) for w in re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()).split()]
    hashes = [w * 0xD6E8FEB86659FD93 for w in words] + [a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F for a, b in zip(words, words[1:], strict=False)]
    return collections.Counter((h % (1 << 64) >> 33) % resampling.BUCKETS for h in hashes)


def test_resampling_against_plain_counts(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r.quality in (0, 1)]
    counts = {i: plain_buckets(t) for i, t in texts.items()}
    models = []
    for ids in ({i for i, q in labels if q == 1 and i in texts}, set(texts)):
        total = sum((counts[i] for i in ids), collections.Counter())
        n = sum(total.values()) + resampling.BUCKETS
        models.append(lambda b, total=total, n=n: np.log((total[b] + 1) / n))
    want = {i: sum(k * (models[0](b) - models[1](b)) for b, k in c.items()) for i, c in counts.items()}
    found = resampling.op1(spark, folder).collect()
    assert {r.doc_id: r.log_ratio for r in found} == pytest.approx(want)
    share = sum(q for _, q in labels) / len(labels)
    best = sorted(found, key=lambda r: -r.key)[: round(share * len(found))]
    assert {r.doc_id for r in found if r.kept} == {r.doc_id for r in best}


def test_resampling(docs, labels):
    rows = resampling.resampled(docs, labels.where("quality = 1"), 0.5).collect()
    assert len(rows) == docs.count() and sum(r.kept for r in rows) >= round(0.5 * len(rows))
    assert min(r.key for r in rows if r.kept) >= max(r.key for r in rows if not r.kept)
    assert [r.log_ratio for r in rows if r.n_grams == 0] == [0.0] * sum(r.n_grams == 0 for r in rows)


def plain_license(text):
    """The nearest template of a text, window by window: (score, licence)."""
    table, places, unknown = licenses.vectors()
    words, best = re.findall("[a-z0-9]+", (text or "").lower().replace("licence", "license")), (0, None)
    for t, template in enumerate(table):
        x = dict(zip(template["words"], template["x"], strict=True))
        idf = dict(zip(template["words"], template["idf"], strict=True))
        starts = {i - p["at"] for p in places if p["template"] == t for i, w in enumerate(words) if w == p["word"]}
        for start in starts:
            window = collections.Counter(words[max(start, 0) : start + template["length"]])
            if any(w not in window for w in template["needs"]) or any(w in window for w in template["bars"]):
                continue
            weight = {w: n * idf.get(w, 1 if w in licenses.FREQUENT else unknown) for w, n in window.items()}
            score = round(sum(v * x.get(w, 0) for w, v in weight.items()) / np.sqrt(sum(v * v for v in weight.values())), 6)
            if score >= licenses.LEAST and score > best[0]:
                best = score, template["license"]
    return best


def test_licenses(spark):
    gpl = "// This program is free software: you can redistribute it and/or modify\n// it under the terms of the GNU General Public License as published by\n// the Free Software Foundation, either version 3 of the License, or\n// (at your option) any later version."
    mit = "some words before\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction"
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.py", "code"), (3, "a/b/y.py", "x\nLicensed under the Apache License, Version 2.0."),
        (4, "z.py", None), (5, None, "All rights reserved."), (6, "a/b/COPYING", "Licensed under CC BY-NC 4.0."), (7, "other/x", "a license to be free, which is not a notice at all"),
        (8, "q/1", gpl), (9, "q/2", mit), (10, "q/3", "Copyright (c) 2020 Jane Doe. Released under the MIT licence. And more."), (11, "q/4", "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007"),
        (12, "q/5", ""), (12, "q/5", ""), (13, "q/6", "word " * 500 + "and this text is\n * licensed under the\n * GNU Lesser General Public License version 3 " + "word " * 5000),
        (14, "q/7", "x" * 1000 + " licensed under the bsd 3-clause license"), (15, None, None),
    ]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("license", F.lit("clash")).withColumn("row", F.lit(1))
    found = licenses.license_scan(files).collect()
    assert len(found) == len(rows)
    got = {r.doc_id: (r.own_license, r.license, r.license_from) for r in found}
    own = {8: "GPL-3.0", 9: "MIT", 10: "MIT", 11: "GPL-3.0", 12: None, 13: "LGPL-3.0", 14: "BSD-3-Clause", 15: None}
    assert got == {
        1: ("MIT", "MIT", None), 2: (None, "CC-BY-NC-4.0", "a/b"), 3: ("Apache-2.0", "Apache-2.0", None), 4: (None, None, None),
        5: ("proprietary", "proprietary", None), 6: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None), 7: (None, None, None),
    } | {i: (v, v, None) for i, v in own.items()}


BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n{}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO"
NOTICES = {
    "BSD-2-Clause": [BSD.format(""), "This file is licensed under the BSD 2-Clause License.", "# SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": [BSD.format("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"), BSD.format("Neither the name of Acme Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"), "Released under the New BSD License"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."],
    "CC-BY-NC-ND-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "Licensed under CC BY-NC-ND 4.0"],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0."],
    "CC-BY-SA-4.0": ["released under the Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0 (see file)"],
    "LGPL-2.0": ["GNU LIBRARY GENERAL PUBLIC LICENSE\n Version 2, June 1991", "under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License"],
    "LGPL-2.1": ["under the terms of the GNU Lesser General Public\n * License as published by the Free Software Foundation; either\n * version 2.1 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["licensed under the GNU Affero General Public License version 3"],
    "Apache-1.1": ["Licensed under the Apache License, Version 1.1", "The Apache Software License, Version 1.1\n\nCopyright (c) 2000 The Apache Software Foundation. All rights reserved."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License."],
    "MPL-1.1": ["The contents of this file are subject to the Mozilla Public License Version\n1.1 (the \"License\"); you may not use this file except in compliance with the License."],
    "GPL-2.0": ["/* This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation; either version 2 of the License, or\n * (at your option) any later version. */"],
    None: ["licensed under the apache license version 7", "the library is open", "a creative commons attribution wtfpl 4 0 license"],
}


def test_notices_get_their_own_licence(spark):
    rows = [(i, f"d{i}/x", text, name) for i, (name, text) in enumerate((n, t) for n, ts in NOTICES.items() for t in ts)]
    found = {r.doc_id: r.own_license for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string, name string")).collect()}
    assert found == {i: name for i, _, _, name in rows}


def test_no_template_is_of_two_licences():
    own = {}
    for name, words in licenses.templates():
        assert own.setdefault(words, name) == name
        assert plain_license(words) == (1.0, name), words


def test_license_scan_of_a_whole_table(spark, monkeypatch):
    """Own licences against every window, inheritance against a walk up; with few and many heavy keys."""
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    own = {i: plain_license(t) for i, t in texts.items()}
    for heavy in (1000, 3):
        monkeypatch.setattr(licenses, "HEAVY", heavy)
        rows = licenses.op3(spark, "/root/testdata/sf0.001").collect()
        assert {r.doc_id: (r.own_score or 0, r.own_license) for r in rows} == own
        files = {r.path.rsplit("/", 1)[0]: r.own_license for r in rows if r.path.endswith("LICENSE") and r.own_license}
        for r in rows:
            up = r.path
            while "/" in up and up.rsplit("/", 1)[0] not in files:
                up = up.rsplit("/", 1)[0]
            want = files.get(up.rsplit("/", 1)[0]) if "/" in up else None
            assert r.license == (r.own_license or want)


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    found = corpus_pipeline.run(spark, folder)
    assert found.count() > 0 and found.where("n_tokens = 0").count() == 0
