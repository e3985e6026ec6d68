"""The mix against a plain loop over slots, and what it does with odd rows."""

import collections
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from treemill.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, number int, block int"


def made(spark, sizes, seed=1):
    """Documents of each source's sizes, with words that tell them apart."""
    rng = random.Random(seed)
    rows = [(i, name, n) for i, (name, n) in enumerate((name, n) for name, ns in sizes.items() for n in ns)]
    texts = [(i, "".join(f"{rng.choice([' ', chr(10), '  '])}é{i}w{k}" for k in range(n)) + " \n", "en", name, None, 1, 2, 3) for i, name, n in rows]
    return spark.createDataFrame(texts, SCHEMA)


def plain_points(slots):
    """Golden-ratio points by fractions."""
    unit = 1 << mixing.BITS
    return [Fraction((i + 1) * mixing.PHI % unit, unit) for i in range(slots)]


def plain_schedule(sources):
    """(slot, number, rank) of sources (number, slots, share), in the order of numbers."""
    total = sum(s[2] for s in sources)
    edges, at = [], 0
    for number, slots, share in sources:
        edges.append((Fraction(at, total), Fraction(at + share, total), number, slots, share))
        at += share
    seen, out = collections.Counter(), []
    for slot, p in enumerate(plain_points(int(total * (1 + mixing.SPARE)) + 64)):
        for low, high, number, slots, share in edges:
            if low <= p < high:
                n = seen[number]
                seen[number] += 1
                if n < share and (n + 1) * slots // share > n * slots // share:
                    out.append((slot, number, n * slots // share))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    sizes = {"big": [rng.randint(0, 3000) for _ in range(60)], "s1": [3], "s2": [0, 700, 41], "s3": [50] * 40, None: [7, 7, 7, 100]}
    return made(spark, sizes)


def test_each_document_is_taken_what_the_slots_hold(docs):
    rows = sorted(mixing.mix(docs).collect(), key=lambda r: (r.source is None, r.source or "", r.start, r["size"]))
    by = collections.OrderedDict()
    for r in rows:
        by.setdefault(r.source, []).append(r)
    sources, streams = [], []
    for number, of in enumerate(by.values()):
        assert [r.start for r in of] == [sum(x["size"] for x in of[:k]) for k in range(len(of))]
        words = round(of[0].target)
        block = max(1, min(mixing.BLOCK, words // mixing.SLOTS))
        slots = -(-words // block)
        sources.append((number, slots, max(slots, mixing.SLOTS)))
        streams.append(([(k, w) for k, r in enumerate(of) for w in range(r["size"])], words, block))
    taken = collections.Counter()
    for _, number, rank in plain_schedule(sources):
        stream, words, block = streams[number]
        for at in range(rank * block, min((rank + 1) * block, words)):
            taken[number, stream[at % len(stream)][0]] += 1
    assert [r.taken for of in by.values() for r in of] == [taken[number, k] for number, of in enumerate(by.values()) for k in range(len(of))]
    for of in by.values():
        assert sum(r.taken for r in of) == round(of[0].target) and all(r.taken <= 2 * r["size"] for r in of)


def test_without_slots_nothing_is_taken(docs, monkeypatch):
    sources = lambda: {r.source for r in mixing.mix(docs).where("taken > 0").collect()}
    assert len(sources()) == 5
    monkeypatch.setattr(mixing, "PHI", 1)  # all points in the first source's share
    assert sources() == {"big"}
    plain = mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda *a: plain(*a).limit(0))
    assert sources() == set()


def test_stretches_of_the_schedule_keep_the_weights(spark):
    shares = [50_000, 20_000, 9_000, 1_000]
    rows, at = [], 0
    for number, s in enumerate(shares):
        at += s
        rows.append((number, s, s, at))
    sources = spark.createDataFrame(rows, "number long, slots long, share long, high long")
    for few in (mixing.FEW, 0):
        found = mixing.schedule(spark, sources, len(rows) if few else 100_000, at).collect()
        assert collections.Counter(r.number for r in found) == dict(enumerate(shares))
        by_stretch = collections.Counter((r.slot // 1000, r.number) for r in found)
        for stretch in range(80_000 // 1000):
            for number, s in enumerate(shares):
                assert abs(by_stretch[stretch, number] - 1000 * s / at) <= 6
        assert sorted((r.number, r["rank"]) for r in found) == sorted((n, k) for n, s in enumerate(shares) for k in range(s))


def test_points_are_exact(spark):
    ids = [0, 1, 2047, 2048, (1 << 22) - 1, 1 << 33, (1 << 43) + 12345]
    found = spark.createDataFrame([(i,) for i in ids], "id long").select("id", mixing.point(F.col("id")).alias("p")).collect()
    assert {r.id: r.p for r in found} == {i: (i + 1) * mixing.PHI % (1 << mixing.BITS) for i in ids}


def test_mixed_texts_hold_the_pieces(docs):
    texts = {r.doc_id: r for r in docs.collect()}
    found = mixing.mixed_texts(docs)
    assert found.columns == docs.columns
    got, whole = collections.defaultdict(list), 0
    for r in found.collect():
        assert (r.lang, r.source, r.row, r.n_chars) == ("en", texts[r.doc_id].source, 1, len(r.text))
        assert r.text in texts[r.doc_id].text
        whole += r.text == texts[r.doc_id].text
        got[r.doc_id] += re.findall(r"[^\x20\x09-\x0D]+", r.text)
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    assert {i: n for i, n in taken.items() if n} == {i: len(w) for i, w in got.items()}
    assert whole > 0
    assert all(max(collections.Counter(w).values()) <= 2 for w in got.values())


def test_mixed_texts_come_in_the_order_of_slots(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART", 500)
    docs = made(spark, {"a": [30] * 100, "b": [30] * 100})
    order = [r.source for r in mixing.mixed_texts(docs).collect()]
    a = order.count("a") / len(order)
    for at in range(0, len(order) - 100, 100):
        assert abs(order[at : at + 100].count("a") / 100 - a) < 0.1


def test_odd_rows(spark):
    rows = [(1, None, None, "a", None, 1, 1, 1), (2, "", None, "a", None, 1, 1, 1), (None, "x y z", None, None, None, 1, 1, 1), (None, "x y z", None, None, None, 1, 1, 1), (3, "same same", None, "b", None, 1, 1, 1), (3, "same same", None, "b", None, 1, 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = mixing.mix(docs).collect()
    assert len(found) == 6 and all(r.taken <= 2 * r["size"] for r in found)
    assert sum(r.taken for r in found if r.source == "b") == round(next(r.target for r in found if r.source == "b"))
    words = sum(len(r.text.split()) for r in mixing.mixed_texts(docs).collect())
    assert words == sum(r.taken for r in found)
    assert mixing.mix(docs.withColumn("text", F.lit(None).cast("string"))).agg(F.sum("taken"), F.max("target")).first()[:] == (0, 0)


def test_many_sources_are_ranked_over_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = {f"host{i % 997:04}" if i % 50 else None: [i % 13] for i in range(2000)}
        docs = made(spark, sizes)
        found = mixing.mix(docs).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by = collections.defaultdict(list)
    for r in found:
        by[r.source].append(r)
    weights = dict(zip(sorted(by, key=lambda s: (s is None, s)), [5, 2, 1] * len(by), strict=False))
    caps = {s: 2 * of[0].source_size for s, of in by.items()}
    want, left, free = {}, 1.5 * sum(caps.values()) / 2, {s for s in caps}
    while free:
        level = left / sum(weights[s] for s in free)
        full = {s for s in free if level * weights[s] > caps[s]}
        if not full:
            want |= {s: level * weights[s] for s in free}
            break
        want |= {s: caps[s] for s in full}
        left -= sum(caps[s] for s in full)
        free -= full
    assert {s: of[0].target for s, of in by.items()} == pytest.approx(want)
    assert all(sum(r.taken for r in of) == round(of[0].target) for of in by.values())
