"""Per-sentence parsing algorithms: one row a sentence in, arcs or states out, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def viterbi(start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> list[int]:
    """The best state sequence; all arguments are log probabilities, ``emit`` by word and state."""
    score, back = start + emit[0], []
    for row in emit[1:]:
        steps = score[:, None] + move
        back.append(steps.argmax(axis=0))
        score = steps.max(axis=0) + row
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def tree_of(weights: np.ndarray) -> list[int]:
    """Heads of the maximum spanning tree; ``weights[h, d]``, word 0 is the root; by contraction."""
    n = len(weights)
    best = weights.copy().astype(float)
    np.fill_diagonal(best, -np.inf)
    head = [-1] + [int(best[:, d].argmax()) for d in range(1, n)]
    seen = [0] * n
    for first in range(1, n):
        path, d = [], first
        while d > 0 and not seen[d]:
            seen[d] = first
            path.append(d)
            d = head[d]
        if d > 0 and seen[d] == first:
            cycle = path[path.index(d) :]
            break
    else:
        return head
    inside = set(cycle)
    outer = [v for v in range(n) if v not in inside]
    place = {v: i for i, v in enumerate(outer)}
    m = len(outer)
    small = np.full((m + 1, m + 1), -np.inf)
    enter, leave = {}, {}
    for u in outer:
        for v in outer:
            small[place[u], place[v]] = best[u, v]
        gain = [best[u, v] - best[head[v], v] for v in cycle]
        k = int(np.argmax(gain))
        small[place[u], m], enter[u] = gain[k], cycle[k]
        out = [best[v, u] for v in cycle]
        k = int(np.argmax(out))
        small[m, place[u]], leave[u] = out[k], cycle[k]
    found = tree_of(small)
    heads = list(head)
    for v in outer[1:]:
        h = found[place[v]]
        heads[v] = leave[v] if h == m else outer[h]
    came = outer[found[m]]
    heads[enter[came]] = came
    return heads


def spanning_trees(scores: DataFrame) -> DataFrame:
    """sent_id, gov, head of each sentence's best tree; ``scores``: sent_id, gov, head (-1 root), weight."""
    rows = scores.groupBy("sent_id").agg(F.collect_list(F.struct("gov", "head", "weight")).alias("arcs"))

    def run(batches):
        for pdf in batches:
            out = []
            for sent, arcs in zip(pdf["sent_id"], pdf["arcs"], strict=True):
                n = max(max(a["gov"], a["head"]) for a in arcs) + 2
                w = np.full((n, n), -1e9)
                for a in arcs:
                    w[a["head"] + 1, a["gov"] + 1] = a["weight"]
                out += [(sent, d - 1, h - 1) for d, h in enumerate(tree_of(w)) if d]
            yield pd.DataFrame(out, columns=["sent_id", "gov", "head"])

    return rows.mapInPandas(run, "sent_id long, gov int, head int")


def tagged(tokens: DataFrame, states: list[str], start: np.ndarray, move: np.ndarray, emit: dict[str, np.ndarray]) -> DataFrame:
    """sent_id, idx and state by Viterbi; ``emit`` has log probabilities of the states by tag."""
    rows = tokens.groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("idx", "pos")))["pos"].alias("tags"))
    flat = np.zeros(len(states))

    def run(batches):
        for pdf in batches:
            out = []
            for sent, tags in zip(pdf["sent_id"], pdf["tags"], strict=True):
                path = viterbi(start, move, np.array([emit.get(t, flat) for t in tags]))
                out += [(sent, i, states[s]) for i, s in enumerate(path)]
            yield pd.DataFrame(out, columns=["sent_id", "idx", "state"])

    return rows.mapInPandas(run, "sent_id long, idx int, state string")


