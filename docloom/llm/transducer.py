"""Weighted acyclic automata over words: built from sorted phrases, summed up, composed for lookups.

An automaton is minimal: states with the same continuations are one, whatever their
weights.  Weights lie beside it, in the order of its phrases: on the way through the
automaton a phrase adds up how many phrases come before it, and that number is the place
of its weight.  Everything here works on whole arrays, level by level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from docloom.llm.common import mix

#: The columns that hold an automaton in a DataFrame.
SCHEMA = "labels array<string>, first binary, arc_label binary, arc_target binary, accept binary, weights binary"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_ODD = np.uint64(0x9E3779B97F4A7C15)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes each as the greatest needs; the first byte says how many."""
    width = next(w for w in (1, 2, 4, 8) if not len(numbers) or int(numbers.max()) < 1 << (8 * w))
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def unpacked(raw: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(kind)


@dataclass
class Transducer:
    """``labels`` (sorted words); of state s the arcs ``first[s]`` to ``first[s + 1]``, sorted by label; the last state is the start."""

    labels: pa.StringArray
    first: np.ndarray
    arc_label: np.ndarray
    arc_target: np.ndarray
    accept: np.ndarray
    weights: np.ndarray

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """The number of phrases from each state on, and of each arc's state those that come before the arc."""
        count = self.accept.astype(np.int64)
        owner = np.repeat(np.arange(len(count)), np.diff(self.first))
        # a phrase has few words, so a few rounds settle all counts
        while True:
            total = np.concatenate([[0], np.cumsum(count[self.arc_target])])
            held = self.accept + total[self.first[1:]] - total[self.first[:-1]]
            if (held == count).all():
                break
            count = held
        total = np.concatenate([[0], np.cumsum(count[self.arc_target])])
        return count, total[:-1] - total[self.first[owner]]

    def phrases(self) -> tuple[np.ndarray, np.ndarray]:
        """All phrases as rows of label numbers, filled up with -1, in order, and their weights."""
        width, rows = 0, [np.zeros((0, 0), np.int32)]
        places = [np.zeros(0, np.int64)]
        _, skip = self.paths()
        state, at, words = np.array([len(self.accept) - 1]), np.zeros(1, np.int64), np.zeros((1, 0), np.int32)
        while len(state):
            done = self.accept[state]
            rows.append(words[done])
            places.append(at[done])
            arcs = self.first[state + 1] - self.first[state]
            parent = np.repeat(np.arange(len(state)), arcs)
            arc = np.arange(len(parent)) - np.repeat(np.cumsum(arcs) - arcs, arcs) + self.first[state][parent]
            at = at[parent] + done[parent] + skip[arc]
            words = np.hstack([words[parent], self.arc_label[arc][:, None].astype(np.int32)])
            state = self.arc_target[arc]
            width += 1
        full = np.full((sum(len(r) for r in rows), max(width - 1, 1)), -1, np.int32)
        end = 0
        for r in rows:
            full[end : end + len(r), : r.shape[1]] = r
            end += len(r)
        order = np.argsort(np.concatenate(places), kind="stable")
        return full[order], self.weights

    def texts(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The phrases joined by spaces, their numbers of words and their weights."""
        rows, weights = self.phrases()
        words = self.labels.to_pylist()
        sizes = (rows >= 0).sum(1)
        return [" ".join([words[i] for i in r[:k]]) for r, k in zip(rows.tolist(), sizes.tolist(), strict=True)], sizes, weights

    def columns(self) -> list:
        """The labels, and each array of numbers as bytes."""
        return [self.labels, *(packed(x) for x in (self.first, self.arc_label, self.arc_target, self.accept, self.weights))]


def build(labels: pa.StringArray, rows: np.ndarray, weights: np.ndarray) -> Transducer:
    """The automaton of distinct ``rows`` of label numbers, filled up with -1 and sorted.

    The rows' prefix tree is folded from its leaves: each level's states enter a register
    of (accepting, arcs), in which equal ones meet.
    """
    n, width = rows.shape
    labels, rows = trimmed(labels, rows)
    sizes = (rows >= 0).sum(1)
    fresh = np.ones((n, width + 1), bool)  # row i is the first of its prefix of d words
    fresh[1:, 0] = False
    for d in range(1, width + 1):
        fresh[1:, d] = (fresh[1:, d - 1] | (rows[1:, d - 1] != rows[:-1, d - 1])) & (sizes[1:] >= d)
        fresh[:1, d] = sizes[:1] >= d
    register: dict[tuple[int, int], int] = {}
    first, arc_label, arc_target, accept = [np.zeros(1, np.int64)], [], [], []
    below_class = np.zeros(0, np.int64)
    below_rows = np.zeros(0, np.int64)
    states = arcs = 0
    for d in range(width, -1, -1):
        at = np.flatnonzero(fresh[:, d])
        ends = sizes[at] == d
        owner = np.searchsorted(at, below_rows, "right") - 1
        label = rows[below_rows, d] if d < width else np.zeros(0, np.int32)
        packed = mix((label.astype(np.uint64) << np.uint64(32)) + below_class.astype(np.uint64) + np.uint64(1))
        counts = np.bincount(owner, minlength=len(at)) if len(at) else np.zeros(0, np.int64)
        stops = np.cumsum(counts)
        starts = stops - counts
        # 128 bits for each state: two sums over its arcs
        keys = np.zeros((len(at), 2), np.uint64)
        for j, x in enumerate((packed, mix(packed * _ODD))):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
            keys[:, j] = mix(total[stops] - total[starts] + ends.astype(np.uint64) * _ODD)
        by = np.lexsort(keys.T)
        new = np.ones(len(by), bool)
        new[1:] = (keys[by[1:]] != keys[by[:-1]]).any(1)
        head, inverse = by[new], np.empty(len(by), np.int64)
        inverse[by] = np.cumsum(new) - 1
        number = np.empty(len(head), np.int64)
        for j, i in enumerate(head.tolist()):
            key = (int(keys[i, 0]), int(keys[i, 1]))
            known = register.get(key)
            if known is None:
                known = register[key] = states
                states += 1
                a, b = starts[i], stops[i]
                arc_label.append(label[a:b])
                arc_target.append(below_class[a:b])
                arcs += b - a
                first.append(np.array([arcs]))
                accept.append(bool(ends[i]))
            number[j] = known
        below_class, below_rows = number[inverse], at
    if not accept:
        first, accept = [np.zeros(1, np.int64), np.zeros(1, np.int64)], [False]
    empty = np.zeros(0, np.int32)
    return Transducer(labels, np.concatenate(first), np.concatenate([*arc_label, empty]), np.concatenate([*arc_target, empty.astype(np.int64)]), np.array(accept), np.asarray(weights, np.int64))


def trimmed(labels: pa.StringArray, rows: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """Only the labels that ``rows`` mention, and the rows with their new numbers."""
    there = np.zeros(len(labels) + 1, bool)
    there[rows] = True  # -1 is the last place
    there[-1] = False
    if there[:-1].all():
        return labels, rows
    number = (np.cumsum(there) - 1).astype(np.int32)
    number[-1] = -1
    return labels.take(pa.array(np.flatnonzero(there))), number[rows]


def read(batch: pa.RecordBatch | pa.Table) -> list[Transducer]:
    """The automata of the rows of Arrow data."""
    labels, *numbers = [batch.column(c).combine_chunks() if isinstance(batch, pa.Table) else batch.column(c) for c in COLUMNS]
    kinds = (np.int64, np.int32, np.int64, bool, np.int64)
    return [Transducer(labels[i].values, *[unpacked(c[i].as_py(), k) for c, k in zip(numbers, kinds, strict=True)]) for i in range(batch.num_rows)]


def union(parts: list[Transducer], least: int = 0) -> Transducer:
    """All phrases of ``parts`` with their weights summed up; those of a sum below ``least`` go."""
    return add_up([(p.labels, *p.phrases()) for p in parts], least)


def add_up(pieces: list[tuple[pa.StringArray, np.ndarray, np.ndarray]], least: int = 0) -> Transducer:
    """The automaton of (labels, rows, weights) of several sources, each sorted by itself."""
    labels, rank = sorted_labels(pa.chunked_array([p[0] for p in pieces], pa.string()).combine_chunks())
    width, total = max([1, *(r.shape[1] for _, r, _ in pieces)]), sum(len(r) for _, r, _ in pieces)
    full, base, end = np.full((total, width), -1, np.int32), 0, 0
    for words, r, _ in pieces:
        if len(words):
            full[end : end + len(r), : r.shape[1]] = np.where(r >= 0, rank[base + np.maximum(r, 0)], -1)
        base, end = base + len(words), end + len(r)
    full, weight = summed(full, np.concatenate([*(w for _, _, w in pieces), np.zeros(0, np.int64)]))
    keep = weight >= least
    return build(labels, full[keep], weight[keep])


def summed(rows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, and the sums of their weights."""
    if not len(rows):
        return rows, weights
    order = np.lexsort(rows.T[::-1])
    rows, weights = rows[order], weights[order]
    new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)]))
    return rows[new], np.add.reduceat(weights, new)


def sorted_labels(words: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The distinct ``words`` in the order of their bytes, and of each word its number there."""
    import pyarrow.compute as pc

    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)


def from_texts(texts: list[str], weights: list[int] | np.ndarray | None = None) -> Transducer:
    """The automaton of phrases given as texts, in any order; equal ones are summed up, without weights each counts once."""
    split = [t.split(" ") for t in texts]
    sizes = [len(s) for s in split]
    labels, rank = sorted_labels(pa.array([w for s in split for w in s], pa.string()))
    rows = np.full((len(split), max(sizes, default=1)), -1, np.int32)
    rows[np.repeat(np.arange(len(split)), sizes), np.arange(sum(sizes)) - np.repeat(np.cumsum(sizes) - sizes, sizes) if sizes else []] = rank
    return build(labels, *summed(rows, np.ones(len(split), np.int64) if weights is None else np.asarray(weights, np.int64)))


def compose(queries: Transducer, counts: Transducer) -> np.ndarray:
    """The weight in ``counts`` of each phrase of ``queries``, in order, 0 if it is not there: the paths that both share."""
    found = np.zeros(len(queries.weights), np.int64)
    import pyarrow.compute as pc

    to = pc.index_in(queries.labels, value_set=counts.labels).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(counts.accept)), np.diff(counts.first))
    keys = (owner.astype(np.int64) << 32) + counts.arc_label  # sorted, as the arcs of a state are
    _, skip_q = queries.paths()
    _, skip_c = counts.paths()
    q, c = np.array([len(queries.accept) - 1]), np.array([len(counts.accept) - 1])
    at_q, at_c = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(q):
        both = queries.accept[q] & counts.accept[c]
        found[at_q[both]] = counts.weights[at_c[both]]
        arcs = queries.first[q + 1] - queries.first[q]
        parent = np.repeat(np.arange(len(q)), arcs)
        arc = np.arange(len(parent)) - np.repeat(np.cumsum(arcs) - arcs, arcs) + queries.first[q][parent]
        label = to[queries.arc_label[arc]] if len(to) else np.zeros(0, np.int64)
        wanted = (c[parent] << 32) + label
        place = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        hit = (label >= 0) & (keys[place] == wanted) if len(keys) else np.zeros(len(wanted), bool)
        parent, arc, place = parent[hit], arc[hit], place[hit]
        at_q = at_q[parent] + queries.accept[q][parent] + skip_q[arc]
        at_c = at_c[parent] + counts.accept[c][parent] + skip_c[place]
        q, c = queries.arc_target[arc], counts.arc_target[place]
    return found
