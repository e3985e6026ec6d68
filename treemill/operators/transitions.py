"""A transition parser: an automaton with a stack, its oracle, and a linear model over hashed features.

Words are read from left to right.  LA hangs the word on top of the stack on the next one, RA the next one on the top
(and puts it on the stack), REDUCE takes the top away, SHIFT puts the next word on the stack.  An action that is
not possible becomes SHIFT, so every sequence of actions ends.  One sentence is one row, and those of a batch take
their steps together in numpy; the model is trained on all sentences: each partition improves the weights on its own
ones, the results are averaged by a shuffle, and this is repeated.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treemill.operators.forest import added, parts, per_sentence, sentences

ACTIONS = LEFT, RIGHT, REDUCE, SHIFT = ("LA", "RA", "REDUCE", "SHIFT")
#: Rows of the table of weights, whatever the number of features; it is collected and sent to the tasks.
WEIGHTS = 1 << 16
#: States that are tried ahead at least, while the model learns.
LOOK = 24


class Automaton:
    """The state of parsing one sentence of ``size`` words."""

    def __init__(self, size: int):
        self.heads, self.stack, self.at, self.size = [-1] * size, [], 0, size

    def possible(self, action: str) -> bool:
        if action == SHIFT:
            return True
        if self.at >= self.size and action != REDUCE:
            return False
        return bool(self.stack) and not (action == LEFT and self.heads[self.stack[-1]] >= 0)

    def act(self, action: str) -> None:
        if not self.possible(action):
            action = SHIFT
        if action == LEFT:
            self.heads[self.stack.pop()] = self.at
        elif action == REDUCE:
            self.stack.pop()
        elif self.at < self.size:  # behind the last word there is nothing to shift
            if action == RIGHT:
                self.heads[self.at] = self.stack[-1]
            self.stack.append(self.at)
            self.at += 1


def oracle(heads: list[int]) -> list[str]:
    """The actions that give back a projective tree (head -1: none), in linear time; of other graphs they give the
    arcs that a stack can reach.  A word goes as soon as it has its head and its last dependent.
    """
    last = list(range(len(heads)))
    for word, head in enumerate(heads):
        if 0 <= head < len(heads):
            last[head] = max(last[head], word)
    state, out = Automaton(len(heads)), []
    while state.at < state.size:
        top = state.stack[-1] if state.stack else None
        if top is not None and heads[top] == state.at and state.heads[top] < 0:
            action = LEFT
        elif top is not None and heads[state.at] == top:
            action = RIGHT
        elif top is not None and last[top] < state.at and (state.heads[top] >= 0 or heads[top] < state.at):
            action = REDUCE
        else:
            action = SHIFT
        out.append(action)
        state.act(action)
    return out


def replayed(actions: Iterable[str], size: int) -> list[int]:
    """The heads that a sequence of actions gives; words left at its end are shifted."""
    state = Automaton(size)
    for action in actions:
        if state.at >= size:
            break
        state.act(action)
    return state.heads


class Automata:
    """The states of parsing many sentences, laid end to end; words are named by their places in the whole, and a step
    is taken by many sentences at once.
    """

    def __init__(self, starts: np.ndarray, sizes: np.ndarray):
        self.at, self.end = starts.copy(), starts + sizes
        self.heads, self.below = np.full(sizes.sum(), -1), np.full(sizes.sum(), -1)
        self.top = np.full(len(starts), -1)

    def left(self) -> np.ndarray:
        """The sentences that have words to come."""
        return np.flatnonzero(self.at < self.end)

    def seen(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For some sentences the word on top of the stack and the one under it (-1: none), whether the top has a head, and the next word."""
        top = self.top[which]
        there = top >= 0
        return top, np.where(there, self.below[top], -1), there & (self.heads[top] >= 0), self.at[which]

    def act(self, which: np.ndarray, action: np.ndarray) -> None:
        """Some sentences, all with words to come, take an action that is possible."""
        top, at = self.top[which], self.at[which]
        left, right, push = action == 0, action == 1, action % 2 == 1
        self.heads[top[left]], self.heads[at[right]] = at[left], top[right]
        self.below[at[push]] = top[push]
        self.top[which] = np.where(push, at, self.below[top])
        self.at[which] += push


def steps_of(heads: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """What the oracle does in each sentence, sentence by sentence: top, second, hung and at before each action, and the action.

    ``heads`` count from each sentence's start; the same rules as ``oracle``.
    """
    place, base, size = np.arange(len(heads)), np.repeat(starts, sizes), np.repeat(sizes, sizes)
    inside = (heads >= 0) & (heads < size)
    gold = np.where(inside, heads + base, np.where(heads < 0, -1, len(heads)))
    last = place.copy()
    np.maximum.at(last, gold[inside], place[inside])
    state, found = Automata(starts, sizes), []
    live = state.left()
    while len(live):
        top, second, hung, at = state.seen(live)
        there, head = top >= 0, gold[top]
        action = np.select([there & ~hung & (head == at), there & (gold[at] == top), there & (last[top] < at) & (hung | (head < at))], [0, 1, 2], 3)
        found.append((live, top, second, hung, at, action))
        state.act(live, action)
        live = live[state.at[live] < state.end[live]]
    if not found:
        return (np.zeros(0, np.int64),) * 5
    of, *columns = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(of, kind="stable")
    return tuple(c[order] for c in columns)


def row_of(feature: str) -> int:
    return zlib.crc32(feature.encode()) % WEIGHTS


def rows_of(name: str, *coded: tuple[list, np.ndarray]) -> np.ndarray:
    """Rows of the features ``name`` with some values each, ``coded`` as (all values, the place of each feature's one)."""
    key = np.zeros(len(coded[0][1]), np.int64)
    for values, at in coded:
        key = key * len(values) + at
    keys, back = np.unique(key, return_inverse=True)
    columns = []
    for values, _ in reversed(coded):
        keys, k = np.divmod(keys, max(1, len(values)))
        columns.append([values[i] for i in k.tolist()])
    return np.array([row_of(" ".join([name, *map(str, f)])) for f in zip(*reversed(columns), strict=True)], np.int64)[back]


class Features:
    """The features of states of sentences laid end to end, as rows of the table of weights."""

    def __init__(self, forms: pa.Array, tags: pa.Array, starts: np.ndarray, sizes: np.ndarray):
        coded = [c.fill_null("_").dictionary_encode() for c in (forms, tags)]
        (words, self.word), (self.tags, self.tag) = ((c.dictionary.to_pylist(), c.indices.to_numpy(zero_copy_only=False).astype(np.int64)) for c in coded)
        self.bias = row_of("bias")
        self.words = {n: np.array([row_of(f"{n} {w}") for w in words], np.int64) for n in ("sw", "iw")}
        self.kinds = {n: np.array([row_of(f"{n} {t}") for t in self.tags], np.int64) for n in ("sp", "sh True", "sh False", "s1", "ip")}
        # the next word's tag, and both tags
        more = np.ones(len(self.tag), bool)
        more[(starts + sizes - 1)[sizes > 0]] = False
        at = np.flatnonzero(more)
        one, two = (self.tags, self.tag[at]), (self.tags, self.tag[at + 1])
        self.ahead = np.full((2, len(self.tag)), WEIGHTS)
        self.ahead[:, at] = rows_of("i1", two), rows_of("i2", one, two)

    def rows(self, top: np.ndarray, second: np.ndarray, hung: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For what stands on the stack and before it ten rows (by the states); ``WEIGHTS`` stands for none."""
        there, tag = top >= 0, self.tag[top]
        near = np.flatnonzero(there)
        pairs = np.full(len(top), WEIGHTS)
        pairs[near] = rows_of("si", (self.tags, tag[near]), (self.tags, self.tag[at[near]]), (range(5), np.minimum(at - top, 4)[near]))
        on = lambda rows: np.where(there, rows, WEIGHTS)
        stack = [on(self.words["sw"][self.word[top]]), on(self.kinds["sp"][tag]), on(np.where(hung, self.kinds["sh True"][tag], self.kinds["sh False"][tag]))]
        under = np.where(second >= 0, self.kinds["s1"][self.tag[second]], WEIGHTS)
        return np.stack([np.full(len(top), self.bias), *stack, under, pairs, self.words["iw"][self.word[at]], self.kinds["ip"][self.tag[at]], *self.ahead[:, at]])


def barred(top: np.ndarray, hung: np.ndarray) -> np.ndarray:
    """For each state minus infinity for the actions that are not possible, 0 for others."""
    bar = np.zeros((len(top), 4))
    bar[top < 0, :3] = -np.inf
    bar[hung, 0] = -np.inf
    return bar


def chosen(weights: np.ndarray, rows: np.ndarray, bar: np.ndarray) -> np.ndarray:
    """The possible action with most weight in each state, the first of equals."""
    return (np.add.reduce(weights.take(rows, axis=0), axis=0) + bar).argmax(axis=1)


def padded(weights: np.ndarray) -> np.ndarray:
    """The table with a row of zeros for features that a state doesn't have."""
    return np.vstack([weights, np.zeros((1, 4), weights.dtype)])


def improved(weights: np.ndarray, states: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, int]:
    """Averaged perceptron over batches of states (feature rows, bars, right actions): the weights after one pass, and how many
    states there were.

    Weights change at each wrong action only, so stretches of states are tried with the same weights, up to the first
    wrong one; the result is that of one state after the other.
    """
    own = padded(weights.astype(np.float64))
    total, cells, done, ahead = np.zeros(own.size), own.reshape(-1), 0, LOOK
    for rows, bar, right in states:
        wrongs, gots, at, end = [], [], 0, len(right)
        while at < end:
            to = at + ahead
            got = chosen(own, rows[:, at:to], bar[at:to])
            wrong = got != right[at:to]
            k = int(wrong.argmax())
            if not wrong[k]:
                at, ahead = to, min(2 * ahead, 4096)
                continue
            at, ahead, a = at + k, max(LOOK, ahead // 2), got[k]
            here = rows[:, at] * 4
            np.add.at(cells, here + right[at], 1.0)
            np.subtract.at(cells, here + a, 1.0)
            own[WEIGHTS] = 0.0
            wrongs.append(at)
            gots.append(a)
            at += 1
        wrongs = np.array(wrongs, np.int64)
        here, steps = rows[:, wrongs] * 4, np.broadcast_to(done + 1.0 + wrongs, (len(rows), len(wrongs)))
        np.add.at(total, (here + right[wrongs]).reshape(-1), steps.reshape(-1))
        np.subtract.at(total, (here + np.array(gots, np.int64)).reshape(-1), steps.reshape(-1))
        done += end
    return (own - total.reshape(own.shape) / (done + 1))[:-1], done


#: Words (sent_id, idx, form, pos, head), rows of sentences, or what maps batches of such rows (sent_id, heads, forms, poss) as
#: ``mapInArrow`` does.
Words = DataFrame | Callable[[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str], DataFrame]


def _mapped(words: Words, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return words(run, schema) if callable(words) else sentences(words, "head", "form", "pos").mapInArrow(run, schema)


def _laid(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """sent_ids, starts, sizes, heads, forms and tags of some sentences at a time, laid end to end."""
    for batch in batches:
        for part in parts(batch, 1) if batch.num_rows else ():
            sizes = part.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            yield part.column(0).to_numpy(), np.cumsum(sizes) - sizes, sizes, *[c.flatten() for c in part.columns[1:]]


def states_of(starts: np.ndarray, sizes: np.ndarray, heads: pa.Array, forms: pa.Array, tags: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows, bars and right actions of all states that the oracle passes in sentences laid end to end."""
    top, second, hung, at, action = steps_of(heads.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), starts, sizes)
    return Features(forms, tags, starts, sizes).rows(top, second, hung, at), barred(top, hung), action


def found_heads(weights: np.ndarray, starts: np.ndarray, sizes: np.ndarray, forms: pa.Array, tags: pa.Array) -> np.ndarray:
    """The head of each word (from its sentence's start, -1: none) by the action of most weight at each step."""
    given, features, state = padded(weights), Features(forms, tags, starts, sizes), Automata(starts, sizes)
    live = state.left()
    while len(live):
        top, second, hung, at = state.seen(live)
        state.act(live, chosen(given, features.rows(top, second, hung, at), barred(top, hung)))
        live = live[state.at[live] < state.end[live]]
    return np.where(state.heads >= 0, state.heads - np.repeat(starts, sizes), -1)


def trained(words: Words, rounds: int = 2) -> np.ndarray:
    """The weights learned from ``words``; nulls are read as ``_``.

    Only the weights that differ from zero come to the driver, ``WEIGHTS`` rows of four at most.
    """
    weights = np.zeros((WEIGHTS, 4))
    for _ in range(rounds):
        given = weights.astype(np.float32)

        def run(batches: Iterable[pa.RecordBatch], given: np.ndarray = given) -> Iterator[pa.RecordBatch]:
            own, n = improved(given, (states_of(*laid) for _, *laid in _laid(batches)))
            if n:
                at, action = np.nonzero(own)
                columns = [np.append(at, -1).astype(np.int32), np.append(action, 0).astype(np.int32), np.append(own[at, action], 1.0)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["at", "action", "w"])

        found = _mapped(words, run, "at int, action int, w double").groupBy("at", "action").agg(F.sum("w").alias("w")).toPandas()
        tasks = found.loc[found["at"] < 0, "w"].sum()
        found = found[found["at"] >= 0]
        weights = np.zeros((WEIGHTS, 4))
        if tasks:
            weights[found["at"], found["action"]] = found["w"] / tasks
    return weights


def compared(words: Words, weights: np.ndarray) -> DataFrame:
    """sent_id, idx, pos, head and found (the head that the model gives, -1: none) of every word."""
    given = weights.astype(np.float32)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sents, starts, sizes, heads, forms, tags in _laid(batches):
            idx = np.arange(sizes.sum()) - np.repeat(starts, sizes)
            columns = [pa.array(np.repeat(sents, sizes)), pa.array(idx.astype(np.int32)), tags, heads, pa.array(found_heads(given, starts, sizes, forms, tags).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["sent_id", "idx", "pos", "head", "found"])

    return _mapped(words, run, "sent_id long, idx int, pos string, head int, found int")


def parsed(words: DataFrame, weights: np.ndarray) -> DataFrame:
    """sent_id, idx and head (-1: none) of every word, by the action of most weight at each step."""
    if not {"head", "heads"} & set(words.columns):
        words = words.withColumn("head", F.lit(-1))
    return compared(words, weights).select("sent_id", "idx", F.col("found").alias("head"))


def replayed_all(at: np.ndarray, actions: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``replayed`` for sentences laid end to end: actions as places in ``ACTIONS``, sentence by sentence, with a word ``at`` of theirs."""
    state, n = Automata(starts, sizes), np.bincount(np.searchsorted(starts, at, "right") - 1, minlength=len(starts))
    first, k = np.cumsum(n) - n, 0
    live = state.left()
    while len(live := live[(n[live] > k) & (state.at[live] < state.end[live])]):
        top, _, hung, _ = state.seen(live)
        action = actions[first[live] + k]
        state.act(live, np.where((action < 3) & ((top < 0) | ((action == 0) & hung)), 3, action))
        k += 1
    return np.where(state.heads >= 0, state.heads - np.repeat(starts, sizes), -1)


def replays(words: DataFrame, whole: bool = False) -> DataFrame:
    """sent_id, idx, head and again: the head after replaying the oracle's actions.

    With ``whole`` rows of sentences get these as an array ``agains``.
    """
    if whole:
        def many(starts, sizes, heads):
            *_, at, actions = steps_of(heads, starts, sizes)
            return [replayed_all(at, actions, starts, sizes)]

        return added(words, "heads", many, "agains array<int>")
    one = lambda sent, heads: [(sent, i, h, a) for i, (h, a) in enumerate(zip(heads, replayed(oracle(heads), len(heads)), strict=True))]
    return per_sentence(sentences(words.select("sent_id", "idx", "head"), "head"), one, "sent_id long, idx int, head int, again int")
