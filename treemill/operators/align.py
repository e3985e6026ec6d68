"""Aligning sentence pairs word by word and projecting annotation through the links."""

from __future__ import annotations

import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treemill.operators.forest import per_sentence

#: Characters of a band of sentence lengths.
BAND = 8
#: What an alignment says of a word: the same on both sides, on the left or right only, another word.
SAME, LEFT, RIGHT, OTHER = range(4)


def _thinned(x: list, y: list, first: int) -> list[tuple[int, int, int | None]] | None:
    """The steps from the end where y is x without some words, which no other way is cheaper than; else None."""
    path, i, j = [], len(x), len(y)
    while i >= j and i:
        i -= 1
        if j and x[i] == y[j - 1]:
            j -= 1
            path.append((SAME, first + i, first + j))
        else:
            path.append((LEFT, first + i, None))
    return path if i == j == 0 else None


def edit_path(a: list, b: list) -> list[tuple[int, int | None, int | None]]:
    """(code, place in a, place in b) along a cheapest way from a to b; deleting, inserting and replacing cost 1.

    The common ends are cut off first.  Sentences that differ in two places at most, or by words left out of one side, need
    no more.  Of others only a band of places around the diagonal is filled in, twice as
    wide each time until the cost is within it, which no cheaper way can leave.  Of equal ways,
    from the end, words are paired before they are deleted, and deleted before they are inserted.
    """
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    n, m = len(a) - first - last, len(b) - first - last
    x, y, far, band = a[first : first + n], b[first : first + m], n + m + 1, max(1, abs(n - m))
    ends = lambda at, to, size: [(SAME, at + k, to + k) for k in range(size)]
    whole = lambda path: ends(0, 0, first) + path[::-1] + ends(len(a) - last, len(b) - last, last)
    if n == m and sum(map(operator.ne, x, y)) <= 2:  # leaving the diagonal costs two
        return whole([(SAME if x[k] == y[k] else OTHER, first + k, first + k) for k in range(n - 1, -1, -1)])
    path = _thinned(x, y, first) if n > m else [(RIGHT, b, a) if code == LEFT else (code, b, a) for code, a, b in _thinned(y, x, first) or []]
    if path:
        return whole(path)
    while True:
        rows = [list(range(min(m, band) + 1))]
        lows = [0]
        for i in range(1, n + 1):
            low, high = max(0, i - band), min(m, i + band)
            above, at, row = rows[-1], lows[-1], []
            for j in range(low, high + 1):
                k = j - at
                cost = above[k] + 1 if 0 <= k < len(above) else far
                if j and 0 <= k - 1 < len(above):
                    cost = min(cost, above[k - 1] + (x[i - 1] != y[j - 1]))
                if row:
                    cost = min(cost, row[-1] + 1)
                row.append(cost)
            rows.append(row)
            lows.append(low)
        if rows[n][m - lows[n]] <= band:
            break
        band *= 2

    def cost(i: int, j: int) -> int:
        return rows[i][j - lows[i]] if i >= 0 and 0 <= j - lows[i] < len(rows[i]) else far

    path, i, j = [], n, m
    while i or j:
        if i and j and cost(i - 1, j - 1) + (x[i - 1] != y[j - 1]) == cost(i, j):
            i, j = i - 1, j - 1
            path.append((SAME if x[i] == y[j] else OTHER, first + i, first + j))
        elif i and cost(i - 1, j) + 1 == cost(i, j):
            i -= 1
            path.append((LEFT, first + i, None))
        else:
            j -= 1
            path.append((RIGHT, None, first + j))
    return whole(path)


def alignment(left: DataFrame, right: DataFrame) -> DataFrame:
    """sent_id, place, code, idx_a and idx_b: two versions of each sentence word by word.

    Equal sentences stay in the JVM; of the others one row each goes to Python.  Sentences of one version only
    are left out.
    """
    forms = lambda df, n: df.groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("idx", F.coalesce("form", F.lit("")).alias("form")))).alias(n))
    pairs = forms(left, "a").join(forms(right, "b"), "sent_id").select("sent_id", F.col("a.form").alias("a"), F.col("b.form").alias("b"))
    equal = pairs.where("a = b").select("sent_id", F.posexplode("a").alias("place", "_form"))
    equal = equal.select("sent_id", "place", F.lit(SAME).alias("code"), F.col("place").alias("idx_a"), F.col("place").alias("idx_b"))
    one = lambda sent, a, b: [(sent, n, *step) for n, step in enumerate(edit_path(a, b))]
    return equal.unionByName(per_sentence(pairs.where("a <> b"), one, "sent_id long, place int, code int, idx_a int, idx_b int"))


def paths(rows: DataFrame, *carry: str) -> DataFrame:
    """Rows of sentences with two versions a and b (arrays of forms) aligned: codes, at_as and at_bs (the steps of
    ``alignment``), and the arrays in ``carry``.
    """

    def one(sent, a, b, *rest):
        path = edit_path(a, b) if a != b else [(SAME, k, k) for k in range(len(a))]
        return [(sent, *rest, *([s[k] for s in path] for k in range(3)))]

    kinds = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in carry)
    return per_sentence(rows.select("sent_id", "a", "b", *carry), one, f"sent_id long{kinds}, codes array<int>, at_as array<int>, at_bs array<int>")


def steps(aligned: DataFrame) -> DataFrame:
    """The rows of ``alignment`` for those of ``paths``, with its other columns."""
    kept = [c for c in aligned.columns if c not in ("codes", "at_as", "at_bs")]
    found = aligned.select(*kept, F.posexplode(F.arrays_zip("codes", "at_as", "at_bs")).alias("place", "_s"))
    return found.select(*kept, "place", F.col("_s.codes").alias("code"), F.col("_s.at_as").alias("idx_a"), F.col("_s.at_bs").alias("idx_b"))


def links(left: DataFrame, right: DataFrame, others: bool = False) -> DataFrame:
    """sent_id, idx_a, idx_b: equal words of two versions of each sentence that are aligned; with ``others``
    also words in each other's place.
    """
    return alignment(left, right).where(F.col("code").isin(SAME, *([OTHER] if others else []))).select("sent_id", "idx_a", "idx_b")


def edits(left: DataFrame, right: DataFrame, linked: DataFrame) -> DataFrame:
    """Per sentence the words linked, not linked on the left and not linked on the right."""
    n = lambda df, name: df.groupBy("sent_id").agg(F.count("*").alias(name))
    found = n(left, "n_a").join(n(right, "n_b"), "sent_id").join(n(linked, "matched"), "sent_id", "left").fillna(0)
    return found.select("sent_id", "matched", (F.col("n_a") - F.col("matched")).alias("deleted"), (F.col("n_b") - F.col("matched")).alias("inserted"))


def edit_counts(aligned: DataFrame) -> DataFrame:
    """Per sentence the words matched, replaced, only on the left and only on the right."""
    if "codes" in aligned.columns:  # ``paths``
        n = lambda code, name: F.size(F.filter("codes", lambda c: c == code)).cast("long").alias(name)
        return aligned.select("sent_id", n(SAME, "matched"), n(OTHER, "substituted"), n(LEFT, "deleted"), n(RIGHT, "inserted"))
    n = lambda code, name: F.sum((F.col("code") == code).cast("long")).alias(name)
    return aligned.groupBy("sent_id").agg(n(SAME, "matched"), n(OTHER, "substituted"), n(LEFT, "deleted"), n(RIGHT, "inserted"))


def errors(aligned: DataFrame, left: DataFrame | None = None, right: DataFrame | None = None) -> DataFrame:
    """How often each word is deleted, inserted, or replaced by another: code, form_a, form_b and n.

    ``paths`` that carry a and b need no other table.
    """
    if left is None:
        wrong = steps(aligned).where(F.col("code") != SAME).select("code", F.get("a", F.col("idx_a")).alias("form_a"), F.get("b", F.col("idx_b")).alias("form_b"))
        return wrong.groupBy("code", "form_a", "form_b").agg(F.count("*").alias("n"))
    form = lambda df, side: df.select("sent_id", F.col("idx").alias(f"idx_{side}"), F.col("form").alias(f"form_{side}"))
    wrong = aligned.where(F.col("code") != SAME).join(form(left, "a"), ["sent_id", "idx_a"], "left").join(form(right, "b"), ["sent_id", "idx_b"], "left")
    return wrong.groupBy("code", "form_a", "form_b").agg(F.count("*").alias("n"))


def project_tags(aligned: DataFrame, left: DataFrame | None = None, right: DataFrame | None = None, column: str = "pos") -> DataFrame:
    """The words of the right version with ``column`` of the word that they are aligned with, null without one.

    ``paths`` that carry the left version's array of it need no other table.
    """
    if left is None:
        return steps(aligned).where("idx_b is not null").select("sent_id", F.col("idx_b").alias("idx"), F.get(f"{column}s", F.col("idx_a")).alias(column))
    tags = aligned.where("idx_a is not null and idx_b is not null").join(left.select("sent_id", F.col("idx").alias("idx_a"), F.col(column).alias("_tag")), ["sent_id", "idx_a"])
    tags = tags.select("sent_id", F.col("idx_b").alias("idx"), "_tag")
    return right.drop(column).join(tags, ["sent_id", "idx"], "left").withColumnRenamed("_tag", column)


def project_arcs(deps: DataFrame, linked: DataFrame) -> DataFrame:
    """Arcs of the left version on the right one, where both ends are linked."""
    end = lambda n: linked.groupBy("sent_id", F.col("idx_a").alias(n)).agg(F.min("idx_b").alias(f"to_{n}"))
    return deps.join(end("gov"), ["sent_id", "gov"]).join(end("head"), ["sent_id", "head"]).select("sent_id", F.col("to_gov").alias("gov"), F.col("to_head").alias("head"), "label")


def project_groups(groups: DataFrame, linked: DataFrame) -> DataFrame:
    """Groups from the first linked word at or after their start to the last at or before their end."""
    inside = groups.join(linked, "sent_id").where("idx_a between first_idx and last_idx")
    return inside.groupBy("sent_id", "name", "first_idx", "last_idx").agg(F.min("idx_b").alias("to_first"), F.max("idx_b").alias("to_last")).select("sent_id", "name", F.col("to_first").alias("first_idx"), F.col("to_last").alias("last_idx"))


def closest(queries: DataFrame, sentences: DataFrame, rare: int = 50, rows: int = 1 << 14) -> DataFrame:
    """The nearest other sentence of each query by edit distance over characters, the least id of equals.

    Sentences that share a word found in ``rare`` sentences or fewer give a first bound of the
    distance; queries without one take the greatest length.  Then each query meets every sentence
    whose length differs by its bound or less, in bands of length that are dealt into blocks of
    about ``rows`` sentences, so that no sentence is left out and no block grows with the corpus.
    Null texts are left out; a query with no other sentence has no row.
    """
    queries, sentences = (df.select("sent_id", "text").where("text is not null") for df in (queries, sentences))
    words = lambda df, k: df.select(F.col("sent_id").alias(k), "text", F.explode(F.array_distinct(F.split("text", " "))).alias("w"))
    all_words = words(sentences, "near_id").withColumnRenamed("text", "near_text")
    few = all_words.groupBy("w").count().where(F.col("count") <= rare).select("w")
    shared = words(queries, "sent_id").join(few, "w").join(all_words, "w").where("sent_id <> near_id")
    bounds = shared.groupBy("sent_id", "text").agg(F.min(F.levenshtein("text", "near_text")).alias("bound"))
    longest = sentences.agg(F.max(F.length("text"))).first()[0] or 0
    banded = sentences.withColumn("band", F.floor(F.length("text") / BAND).cast("int"))
    blocks = banded.groupBy("band").agg(F.ceil(F.count("*") / rows).cast("int").alias("blocks"))
    dealt = banded.join(blocks, "band").select("band", F.pmod(F.xxhash64("sent_id"), "blocks").cast("int").alias("block"), F.col("sent_id").alias("near_id"), F.col("text").alias("near_text"))
    asked = queries.join(bounds, ["sent_id", "text"], "left").withColumn("bound", F.coalesce("bound", F.greatest(F.length("text"), F.lit(longest))))
    low, high = (F.floor((F.length("text") + k * F.col("bound")) / BAND).cast("int") for k in (-1, 1))
    met = asked.withColumn("band", F.explode(F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.greatest(low, F.lit(longest // BAND))))))
    met = met.join(blocks, "band").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    near = F.abs(F.length("text") - F.length("near_text")) <= F.col("bound")
    pairs = met.join(dealt, ["band", "block"]).where((F.col("sent_id") != F.col("near_id")) & near)
    scored = pairs.withColumn("distance", F.expr("levenshtein(text, near_text, bound)")).where("distance >= 0")
    return scored.groupBy("sent_id").agg(F.min(F.struct("distance", "near_id")).alias("best")).select("sent_id", "best.near_id", "best.distance")
