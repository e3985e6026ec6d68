"""Measures and patterns of whole sentences, one row each with arrays of heads, labels and tags.

A batch of sentences is one flat array of heads; ancestors are found by pointer doubling (as many
steps as the logarithm of the longest sentence), yields by sums from the deepest words up.  No
walk is cut short, whatever the depth; words in or under a cycle are told apart exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treemill.operators.match import first_arcs

#: Words of a batch that are measured at a time.
WORDS = 1 << 18


def gathered(words: DataFrame, *columns: str) -> bool:
    """Whether ``words`` are rows of sentences with an array for each of the columns."""
    return all(f"{c}s" in words.columns for c in columns)


def sentences(words: DataFrame, *columns: str) -> DataFrame:
    """A row per sentence: sent_id and, for each column, the array of its values in word order.

    ``words`` that are rows of sentences already (with an array ``heads`` for head, and so on) stay as they are.
    """
    if gathered(words, *columns):
        return words.select("sent_id", *[f"{c}s" for c in columns])
    rows = F.array_sort(F.collect_list(F.struct("idx", *columns)))
    return words.groupBy("sent_id").agg(rows.alias("_w")).select("sent_id", *[F.col(f"_w.{c}").alias(f"{c}s") for c in columns])


def with_heads(tokens: DataFrame, deps: DataFrame | None) -> DataFrame:
    """``tokens`` with the head and label of each word's first arc, -1 and null without one; words
    that have a head already (``deps`` None) stay as they are.
    """
    if deps is None:
        return tokens
    arcs = first_arcs(deps).select("sent_id", F.col("gov").alias("idx"), "head", "label")
    return tokens.join(arcs, ["sent_id", "idx"], "left").withColumn("head", F.coalesce("head", F.lit(-1)))


def climbed(up: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a forest given by ``up`` (-1: none), after 2**steps or more moves from each node, halting
    at roots: the node reached, how many moves were made, and the least node passed.
    """
    at = np.arange(len(up))
    has = up >= 0
    to, made, least = np.where(has, up, at), has.astype(np.int64), np.where(has, np.minimum(up, at), at)
    for _ in range(steps):
        made, least, to = made + made[to], np.minimum(least, least[to]), to[to]
    return to, made, least


def measured(heads: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """depth, root, leftmost, rightmost, size and cyclic of each word of sentences laid end to end.

    ``heads`` counts from each sentence's start.  In or under a cycle depth and root are -1; the yield of
    a word in a cycle has all that hangs on the cycle.
    """
    sizes = np.diff(np.append(starts, len(heads)))
    base = np.repeat(starts, sizes)
    up = np.where(heads >= 0, heads + base, -1)
    steps = int(max(sizes, default=1)).bit_length()
    to, depth, _ = climbed(up, steps)
    hung = up[to] >= 0
    cyclic = np.zeros(len(up), bool)
    cyclic[to[hung]] = True
    # yields: cycles are cut into roots first, then summed over their words
    tree = np.where(cyclic, -1, up)
    _, level, _ = climbed(tree, steps)
    place = np.arange(len(up))
    left, right, size = place.copy(), place.copy(), np.ones(len(up), np.int64)
    order = np.argsort(level, kind="stable")
    edges = np.searchsorted(level[order], np.arange(level.max(initial=0) + 2))
    for k in range(len(edges) - 2, 0, -1):
        sel = order[edges[k] : edges[k + 1]]
        np.minimum.at(left, tree[sel], left[sel])
        np.maximum.at(right, tree[sel], right[sel])
        np.add.at(size, tree[sel], size[sel])
    if cyclic.any():
        _, _, least = climbed(up, steps)
        ring, of = np.flatnonzero(cyclic), least[cyclic]
        for values, add in ((left, np.minimum), (right, np.maximum)):
            best = values.copy()
            add.at(best, of, values[ring])
            values[ring] = best[of]
        total = np.zeros(len(up), np.int64)
        np.add.at(total, of, size[ring])
        size[ring] = total[of]
    gone = np.full(len(up), -1)
    return {"depth": np.where(hung, gone, depth), "root": np.where(hung, gone, to - base), "leftmost": left - base, "rightmost": right - base, "size": size, "cyclic": cyclic}


def measures(tokens: DataFrame, deps: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """sent_id, idx, depth, root (null in or under a cycle), leftmost, rightmost and size of the part of the tree
    under each word, itself included, and cyclic: whether the word is its own ancestor.

    Arcs whose head is no word of the sentence count as none.  With ``whole`` rows of sentences get these as arrays: depths,
    roots, leftmosts, rightmosts and sizes (-1 for null) and cyclics.
    """
    if whole:
        def many(starts, sizes, heads):
            return measured(np.where(heads < np.repeat(sizes, sizes), heads, -1), starts).values()

        return added(tokens, "heads", many, "depths array<int>, roots array<int>, leftmosts array<int>, rightmosts array<int>, sizes array<long>, cyclics array<boolean>")
    schema = pa.schema([("sent_id", pa.int64()), ("idx", pa.int32()), ("depth", pa.int32()), ("root", pa.int32()), ("leftmost", pa.int32()), ("rightmost", pa.int32()), ("size", pa.int64()), ("cyclic", pa.bool_())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1):
                lists = part.column(1)
                sizes = np.diff(lists.offsets.to_numpy())
                starts = np.cumsum(sizes) - sizes
                heads = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                heads = np.where(heads < np.repeat(sizes, sizes), heads, -1)
                found = measured(heads, starts)
                columns = [pa.array(np.repeat(part.column(0).to_numpy(), sizes)), pa.array((np.arange(len(heads)) - np.repeat(starts, sizes)).astype(np.int32))]
                for name in schema.names[2:]:
                    missing = found[name] < 0 if name in ("depth", "root") else None
                    columns.append(pa.array(found[name], mask=missing).cast(schema.field(name).type))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = sentences(with_heads(tokens, deps), "head")
    return rows.mapInArrow(run, "sent_id long, idx int, depth int, root int, leftmost int, rightmost int, size long, cyclic boolean")


def parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``WORDS`` list elements."""
    words = max(1, len(batch.column(column).flatten()))
    rows = max(1, batch.num_rows * WORDS // words)
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def per_sentence(rows: DataFrame, one: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that ``one(*values)`` gives for each row, in Arrow batches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                values = [c.to_pylist() for c in batch.slice(at, 1024).columns]
                found = [row for v in zip(*values, strict=True) for row in one(*v)]
                columns = zip(*found, strict=True) if found else [[] for _ in arrow]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(run, schema)


def flat(rows: DataFrame, many: Callable[..., Iterable], schema: str) -> DataFrame:
    """The columns that ``many(sent_ids, starts, sizes, *arrays)`` gives for a batch of sentences laid end to end; the arrays
    of ``rows`` (sent_id and arrays, as long as each other) as Arrow arrays.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1):
                sizes = part.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                found = many(part.column(0).to_numpy(), np.cumsum(sizes) - sizes, sizes, *[c.flatten() for c in part.columns[1:]])
                yield pa.RecordBatch.from_arrays([(c if isinstance(c, pa.Array) else pa.array(c)).cast(f.type) for c, f in zip(found, arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(run, schema)


def added(rows: DataFrame, column: str, many: Callable[..., Iterable[np.ndarray]], schema: str) -> DataFrame:
    """``rows`` with the arrays, named and typed by ``schema``, that ``many(starts, sizes, values)`` gives for the array ``column`` of
    sentences laid end to end.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    at, whole = rows.columns.index(column), rows.schema.simpleString()[7:-1] + "," + schema
    arrow = to_arrow_schema(_parse_datatype_string(whole))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, at):
                sizes = part.column(at).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                edges = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
                found = many(edges.to_numpy()[:-1].astype(np.int64), sizes, part.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.int64))
                columns = [*part.columns, *[pa.ListArray.from_arrays(edges, pa.array(c)) for c in found]]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(run, whole)


def listed(of: np.ndarray, values: pa.Array, n: int) -> pa.Array:
    """For each of ``n`` words the list of the values that are its own by ``of``, in their order."""
    edges = np.append(0, np.cumsum(np.bincount(of, minlength=n))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), values.take(pa.array(np.argsort(of, kind="stable"))))


#: Different keys that ``counted`` keeps before it hands them on.
KEYS = 1 << 17


def counted(rows: DataFrame, one: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """How often ``one(*arrays)`` gives each key (a tuple, or a word for one column) over all rows of sentences: the key's
    columns by ``schema``, and n.

    Keys are counted where they are made, so what is shuffled are the different keys of a task.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(f"{schema}, n long"))

    def made(counts: Counter) -> pa.RecordBatch:
        columns = [*zip(*counts, strict=True), list(counts.values())] if counts else [[] for _ in arrow]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                for values in zip(*[c.to_pylist() for c in batch.slice(at, 1024).columns[1:]], strict=True):
                    counts.update(one(*values))
                if len(counts) > KEYS:
                    yield made(counts)
                    counts = Counter()
        yield made(counts)

    keys = [f.name for f in arrow][:-1]
    return rows.mapInArrow(run, f"{schema}, n long").groupBy(*keys).agg(F.sum("n").alias("n"))


# sub-trees


def children_of(heads: list[int]) -> list[list[int]]:
    found: list[list[int]] = [[] for _ in heads]
    for word, head in enumerate(heads):
        if 0 <= head < len(heads):
            found[head].append(word)
    return found


def names_to(depth: int, heads: list[int], labels: list[str], tags: list[str]) -> list[list[str]]:
    """For k from 1 to ``depth`` the canonical name of each word's sub-tree of k levels.

    A name is the tag and, in brackets, the children's labels and names, sorted; so equal trees,
    whatever the order of their children, have equal names, and each level is made from the one below.
    """
    names = [list(tags)]
    inner = [(word, kids) for word, kids in enumerate(children_of(heads)) if kids]
    for _ in range(1, depth):
        last, level = names[-1], list(tags)
        for word, kids in inner:
            level[word] = f"{tags[word]}({' '.join(sorted([f'{labels[c]}:{last[c]}' for c in kids]))})"
        names.append(level)
    return names


def _labelled(words: DataFrame) -> DataFrame:
    """Arrays of heads, labels and tags, ``_`` for null."""
    if gathered(words, "head", "label", "pos"):
        filled = lambda c: F.transform(c, lambda x: F.coalesce(x, F.lit("_"))).alias(c)
        return words.select("sent_id", "heads", filled("labels"), filled("poss"))
    return sentences(words.select("sent_id", "idx", "head", F.coalesce("label", F.lit("_")).alias("label"), F.coalesce("pos", F.lit("_")).alias("pos")), "head", "label", "pos")


def subtrees(words: DataFrame, depth: int) -> DataFrame:
    """sent_id, idx, k and tree: the canonical name of each word's sub-tree of k levels, k up to ``depth``.

    ``words`` have head, label and pos (null tags and labels are read as ``_``).
    """
    rows = _labelled(words)
    one = lambda sent, heads, labels, tags: [(sent, i, k, tree) for k, level in enumerate(names_to(depth, heads, labels, tags), 1) for i, tree in enumerate(level)]
    return per_sentence(rows, one, "sent_id long, idx int, k int, tree string")


def frequent_subtrees(words: DataFrame, depth: int, least: int) -> DataFrame:
    """k, tree and n of the sub-trees of up to ``depth`` levels that occur ``least`` times or more."""
    one = lambda heads, labels, tags: [(k, tree) for k, level in enumerate(names_to(depth, heads, labels, tags), 1) for tree in level]
    return counted(_labelled(words), one, "k int, tree string").where(F.col("n") >= least)


def subtree(words: DataFrame, at: DataFrame | None, depth: int) -> DataFrame:
    """The words of the sub-tree of ``depth`` levels under each word of ``at`` (sent_id, idx), as sent_id, top,
    idx (numbered anew from 0), head (-1 for the top) and the other columns of ``words``.

    Of rows of sentences all arrays but ``heads`` are such columns, and their ``tops`` stand for ``at``.
    """
    keys = [c for c in words.columns if c not in ("sent_id", "idx", "head")]

    def one(sent, heads, tops, *values):
        below = children_of(heads) if tops else []
        for top in tops:
            level, found = [top], set()
            for _ in range(depth):
                found.update(level)
                level = [c for w in level for c in below[w] if c not in found]
            place = {w: i for i, w in enumerate(sorted(found))}
            yield from ((sent, top, *([] if values else [w]), i, -1 if w == top else place[heads[w]], *[v[w] for v in values]) for w, i in place.items())

    if gathered(words, "head"):
        named = [c for c in words.columns if c not in ("sent_id", "heads", "tops")]
        kinds = "".join(f", {c[:-1]} {words.schema[c].dataType.elementType.simpleString()}" for c in named)
        return per_sentence(words.where("size(tops) > 0").select("sent_id", "heads", "tops", *named), one, f"sent_id long, top int, idx int, head int{kinds}")
    tops = at.groupBy("sent_id").agg(F.collect_set("idx").alias("tops"))
    placed = per_sentence(sentences(words, "head").join(tops, "sent_id"), one, "sent_id long, top int, _old int, _new int, _head int")
    joined = placed.join(words.select("sent_id", F.col("idx").alias("_old"), *keys), ["sent_id", "_old"])
    return joined.select("sent_id", "top", F.col("_new").alias("idx"), F.col("_head").alias("head"), *keys)


def matched(wants: list[set[int]]) -> bool:
    """Whether each of ``wants`` can have an element of its own."""
    owner: dict[int, int] = {}

    def placed(k: int, tried: set[int]) -> bool:
        for x in wants[k] - tried:
            tried.add(x)
            if x not in owner or placed(owner[x], tried):
                owner[x] = k
                return True
        return False

    return all(placed(k, set()) for k in range(len(wants)))


def places_of(target: tuple[list[int], list[str]], heads: list[int], labels: list[str]) -> list[int]:
    """Words at which the tree ``target`` (heads with one root, labels) is found: each of its words has a word of its own with
    the same label under its parent's one; children in any order, others may stand among them.
    """
    wanted, own = children_of(target[0]), children_of(heads)
    seen: dict[tuple[int, int], bool] = {}

    def under(t: int, w: int) -> bool:
        if (t, w) not in seen:
            seen[t, w] = False  # a cycle never closes
            kids = [{c for c in own[w] if labels[c] == target[1][k] and under(k, c)} for k in wanted[t]] if len(own[w]) >= len(wanted[t]) else [set()]
            seen[t, w] = matched(kids)
        return seen[t, w]

    top = next(i for i, h in enumerate(target[0]) if h < 0)
    least = len(wanted[top])
    return [w for w in range(len(heads)) if len(own[w]) >= least and under(top, w)]


def including(words: DataFrame, heads: list[int], labels: list[str]) -> DataFrame:
    """sent_id and idx of the words whose tree includes the given one (heads with -1 for its one root).

    Sentences that lack one of its labels are left out before any tree is looked at.
    """
    wanted = F.array(*[F.lit(x) for x in sorted({x for x, h in zip(labels, heads, strict=True) if h >= 0})]).cast("array<string>")
    rows = sentences(words, "head", "label").where(F.size(F.array_except(wanted, "labels")) == 0)
    target = (list(heads), list(labels))
    return per_sentence(rows, lambda sent, hs, ls: [(sent, w) for w in places_of(target, hs, ls)], "sent_id long, idx int")


def similar(words: DataFrame, above: list[str], below: list[str]) -> DataFrame:
    """sent_id, idx, parents, children and distance of every word to one whose arcs up to the root have the labels ``above``
    and whose children have the labels ``below``: how many of the labels above are equal in turn, how many of those below
    (each counted once) are there too, and minus their sum.
    """
    up, down = list(above), Counter(below)

    def many(sents, starts, sizes, heads, labels):
        base, place = np.repeat(starts, sizes), np.arange(len(heads))
        own = heads.to_numpy(zero_copy_only=False).astype(np.int64)
        known = (own >= 0) & (own < np.repeat(sizes, sizes))
        head = np.where(known, own + base, 0)
        named = {x: pc.fill_null(pc.equal(labels, pa.scalar(x)), False).to_numpy(zero_copy_only=False) for x in {*up, *down}}
        at, going, same, shared = place, np.ones(len(place), bool), np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        for label in up:
            going = going & known[at] & named[label][at]
            same += going
            at = np.where(going, head[at], at)
        for label, most in down.items():
            shared += np.minimum(np.bincount(head[known & named[label]], minlength=len(place)), most)
        return np.repeat(sents, sizes), place - base, same, shared, -same - shared

    return flat(sentences(words, "head", "label"), many, "sent_id long, idx int, parents int, children int, distance int")


# projectivity


def repaired(heads: list[int]) -> list[int]:
    """``heads`` without the arcs that break projectivity, removed in word order until none is left.

    An arc breaks it if a word between its ends has no head or one beyond its ends, or if it closes a cycle
    of two.  Each removal counts for the words that follow, so the order matters.
    """
    found = list(heads)
    while True:
        before = list(found)
        for i, head in enumerate(found):
            if head >= 0:
                low, high = min(i, head), max(i, head)
                if found[head] == i or any(not low <= found[j] <= high for j in range(low + 1, high)):
                    found[i] = -1
        if found == before:
            return found


#: Words between the ends of arcs that are looked at at a time.
BETWEEN = 1 << 22


def breaking(arcs: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Which of some words' arcs break projectivity in the graph ``up`` of sentences laid end to end (-1: no head)."""
    low, high = np.minimum(arcs, up[arcs]), np.maximum(arcs, up[arcs])
    hit, size = up[up[arcs]] == arcs, np.maximum(high - low - 1, 0)
    ends = np.cumsum(size)
    at = 0
    while at < len(arcs):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BETWEEN, "right")))
        n = size[at:to]
        of = np.repeat(np.arange(at, to), n)
        over = up[np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + low[of] + 1]
        hit[of[(over < low[of]) | (over > high[of])]] = True
        at = to
    return hit


def repaired_all(starts: np.ndarray, sizes: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """``repaired`` for sentences laid end to end: the k-th words of all that have arcs to lose are looked at together."""
    base, row = np.repeat(starts, sizes), np.repeat(np.arange(len(sizes)), sizes)
    up = np.where(heads >= 0, heads + base, -1)
    some = np.arange(len(sizes))
    while len(some):
        live = np.zeros(len(sizes), bool)
        live[some] = True
        arcs = np.flatnonzero((up >= 0) & live[row])
        some = np.unique(row[arcs[breaking(arcs, up)]])
        some = some[np.argsort(-sizes[some], kind="stable")]
        for k in range(int(sizes[some].max(initial=0))):
            at = starts[some[: np.searchsorted(-sizes[some], -k, "left")]] + k
            at = at[up[at] >= 0]
            up[at[breaking(at, up)]] = -1
    return np.where(up >= 0, up - base, np.where(heads < 0, heads, -1))


def projective(tokens: DataFrame, deps: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """sent_id, idx and head of all words once the arcs that break projectivity are gone.

    With ``whole`` rows of sentences get these heads as an array ``kepts``.
    """
    if whole:
        return added(tokens, "heads", lambda starts, sizes, heads: [repaired_all(starts, sizes, heads)], "kepts array<int>")
    rows = sentences(with_heads(tokens, deps), "head")
    return per_sentence(rows, lambda sent, heads: [(sent, i, h) for i, h in enumerate(repaired(heads))], "sent_id long, idx int, head int")
