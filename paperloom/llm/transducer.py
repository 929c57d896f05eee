"""Weighted acyclic automata over sequences of 64-bit labels, with numpy.

A count transducer maps each of a set of n-grams to its count. It is a deterministic acyclic automaton whose
arcs carry a label and a weight: the count of the n-gram that ends with the arc (0 where none does). It is
built in one sweep over sorted n-grams: an arc opens wherever an n-gram leaves the path of the one before it,
states are closed from the longest n-grams up, and states with equal arcs (labels, weights and targets) are
registered once, so common beginnings and common ends are stored once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import zstandard

from paperloom.llm.common import mix

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Grams:
    """Sorted distinct n-grams: `ranks` points into the sorted `alphabet` (from 1; 0 after the end)."""

    alphabet: np.ndarray
    ranks: np.ndarray
    weights: np.ndarray

    def __len__(self) -> int:
        return len(self.weights)

    def labels(self) -> np.ndarray:
        """The labels themselves; 0 after the end."""
        return np.concatenate([np.zeros(1, np.uint64), self.alphabet])[self.ranks]

    def lengths(self) -> np.ndarray:
        return (self.ranks > 0).sum(1)

    def where(self, mask: np.ndarray) -> Grams:
        return _shrunk(Grams(self.alphabet, self.ranks[mask], self.weights[mask]))


def _shrunk(grams: Grams) -> Grams:
    used = np.zeros(len(grams.alphabet) + 1, bool)
    used[grams.ranks] = True
    used[0] = False
    to = np.cumsum(used)
    return Grams(grams.alphabet[used[1:]], np.where(grams.ranks > 0, to[grams.ranks], 0).astype(np.int32), grams.weights)


def _order(ranks: np.ndarray, size: int) -> np.ndarray:
    """The order of rows, by columns from the left."""
    bits = max(1, int(size).bit_length())
    per = 64 // bits
    keys = []
    for at in range(0, ranks.shape[1], per):
        key = np.zeros(len(ranks), np.uint64)
        for column in ranks[:, at : at + per].T:
            key = (key << np.uint64(bits)) | column.astype(np.uint64)
        keys.append(key)
    return np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])


def _fresh(ranks: np.ndarray) -> np.ndarray:
    """For every row and depth, whether the row's beginning of that depth differs from the row before."""
    fresh = np.ones(ranks.shape, bool)
    if len(ranks):
        fresh[1:] = np.logical_or.accumulate(ranks[1:] != ranks[:-1], axis=1)
    return fresh


def sorted_grams(alphabet: np.ndarray, ranks: np.ndarray, weights: np.ndarray) -> Grams:
    """Sort rows and add up the weights of equal ones."""
    order = _order(ranks, len(alphabet))
    ranks = ranks[order]
    starts = np.flatnonzero(_fresh(ranks)[:, -1])
    sums = np.add.reduceat(weights[order], starts) if len(starts) else weights[:0]
    return Grams(alphabet, ranks[starts], sums)


def count_windows(labels: np.ndarray, begins: np.ndarray, lengths: np.ndarray, least: int, most: int) -> Grams:
    """The n-grams of `least` to `most` labels that begin at `begins`, with their numbers of occurrences;
    `lengths` says how many labels a window may have (those below `least` have no n-gram)."""
    wide = lengths >= least
    begins, lengths = begins[wide], np.minimum(lengths[wide], most)
    alphabet, ranked = np.unique(labels, return_inverse=True)
    ranked = np.concatenate([ranked.astype(np.int32) + 1, np.zeros(most, np.int32)])
    window = lambda i: np.where(lengths > i, ranked[begins + i], 0)
    bits = len(alphabet).bit_length()
    if 0 < most * bits <= 64:  # a window is one number: sort the numbers
        keys = np.zeros(len(begins), np.uint64)
        for i in range(most):
            keys = (keys << np.uint64(bits)) | window(i).astype(np.uint64)
        keys, sums = np.unique(keys, return_counts=True)
        cuts = [(keys >> np.uint64(bits * i)) & np.uint64((1 << bits) - 1) for i in range(most - 1, -1, -1)]
        full = Grams(alphabet, np.stack(cuts, axis=1).astype(np.int32), sums.astype(np.int64))
    else:
        ranks = np.zeros((len(begins), most), np.int32)
        for i in range(most):
            ranks[:, i] = window(i)
        full = sorted_grams(alphabet, ranks, np.ones(len(begins), np.int64))
    if least == most:
        return _shrunk(full)
    # every beginning of a window that is long enough is an n-gram of its own
    fresh, parts, sums = _fresh(full.ranks), [], []
    for depth in range(least, most + 1):
        starts = np.flatnonzero(fresh[:, depth - 1])
        sizes = np.add.reduceat(full.weights, starts) if len(starts) else full.weights[:0]
        here = full.ranks[starts, depth - 1] > 0
        cut = full.ranks[starts[here]].copy()
        cut[:, depth:] = 0
        parts.append(cut)
        sums.append(sizes[here])
    return _shrunk(sorted_grams(full.alphabet, np.concatenate(parts), np.concatenate(sums)))


@dataclass
class Transducer:
    """States are runs of arcs, `first[s]` to `first[s + 1]`; state 0 has none and the last is the start.
    The arcs of a state are in the order of their labels."""

    alphabet: np.ndarray
    first: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    target: np.ndarray

    @property
    def start(self) -> int:
        return len(self.first) - 2


def build(grams: Grams) -> Transducer:
    """The minimal transducer of sorted n-grams."""
    ranks, depth = grams.ranks, grams.ranks.shape[1]
    fresh, lengths = _fresh(ranks), grams.lengths()
    # rows where an arc of each depth opens
    opened = [np.flatnonzero(fresh[:, d] & (ranks[:, d] > 0)) for d in range(depth)]
    first, label, weight, target = [np.zeros(2, np.int64)], [], [], []
    n_states, n_arcs = 1, 0
    states_below = np.zeros(len(opened[-1]), np.int64) if depth else np.zeros(0, np.int64)
    for d in range(depth - 1, -1, -1):
        rows = opened[d]
        arc_label = ranks[rows, d].astype(np.int64)
        arc_weight = np.where(lengths[rows] == d + 1, grams.weights[rows], 0)
        # the arcs of one parent are neighbours: a parent is an arc of the depth above (or the start)
        above = opened[d - 1] if d else np.zeros(min(1, len(ranks)), np.int64)
        bounds = np.searchsorted(rows, np.append(above, len(ranks)))
        sizes = np.diff(bounds)
        parents = np.flatnonzero(sizes)
        begins, sizes = bounds[:-1][parents], sizes[parents]
        states = np.zeros(len(above), np.int64)
        if len(parents):
            one = mix(mix(arc_label.view(np.uint64) + _FACTOR) ^ arc_weight.view(np.uint64))
            one = mix(one + states_below.view(np.uint64) * _FACTOR)
            marks = np.add.reduceat(one, begins) + sizes.astype(np.uint64)
            _, chosen, which = np.unique(marks, return_index=True, return_inverse=True)
            which = _verified(which, chosen, begins, sizes, (arc_label, arc_weight, states_below))
            _, chosen, which = np.unique(which, return_index=True, return_inverse=True)
            flat = _runs(begins[chosen], sizes[chosen])
            first.append(n_arcs + np.cumsum(sizes[chosen]))
            label.append(arc_label[flat])
            weight.append(arc_weight[flat])
            target.append(states_below[flat])
            states[parents] = n_states + which
            n_states += len(chosen)
            n_arcs += len(flat)
        states_below = states
    if not n_arcs:
        first.append(np.zeros(1, np.int64))
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return Transducer(grams.alphabet, np.concatenate(first), join(label), join(weight), join(target))


def _runs(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all runs, one after another."""
    total = int(sizes.sum())
    shift = np.repeat(begins - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    return np.arange(total, dtype=np.int64) + shift


def _verified(
    which: np.ndarray, chosen: np.ndarray, begins: np.ndarray, sizes: np.ndarray, arcs: Sequence[np.ndarray]
) -> np.ndarray:
    """Classes of equal runs of arcs; a run that only shares its class's mark gets a class of its own."""
    model = chosen[which]
    same = sizes == sizes[model]
    checked = np.flatnonzero(same)
    mine, theirs = _runs(begins[checked], sizes[checked]), _runs(begins[model[checked]], sizes[checked])
    equal = np.ones(len(mine), bool)
    for column in arcs:
        equal &= column[mine] == column[theirs]
    if len(checked):
        ends = np.concatenate([[0], np.cumsum(sizes[checked])[:-1]])
        same[checked] = np.logical_and.reduceat(equal, ends)
    other = np.flatnonzero(~same)
    if len(other):
        which = which.copy()
        which[other] = len(chosen) + np.arange(len(other))
    return which


def grams_of(machine: Transducer) -> Grams:
    """The n-grams of a transducer with their weights, sorted."""
    state = np.array([machine.start])
    path = np.zeros((1, 0), np.int32)
    found, sums = [], []
    while len(state):
        sizes = machine.first[state + 1] - machine.first[state]
        arcs = _runs(machine.first[state], sizes)
        path = np.concatenate([np.repeat(path, sizes, axis=0), machine.label[arcs, None].astype(np.int32)], axis=1)
        weight, state = machine.weight[arcs], machine.target[arcs]
        ends = weight > 0
        found.append(path[ends])
        sums.append(weight[ends])
        on = state > 0
        path, state = path[on], state[on]
    depth = max([p.shape[1] for p in found if len(p)], default=1)
    padded = [np.pad(p, ((0, 0), (0, depth - p.shape[1]))) for p in found if len(p)]
    if not padded:
        return Grams(machine.alphabet, np.zeros((0, 1), np.int32), np.zeros(0, np.int64))
    return sorted_grams(machine.alphabet, np.concatenate(padded), np.concatenate(sums))


def union(parts: Sequence[Grams]) -> Grams:
    """All n-grams of the parts; weights of equal ones are added up."""
    parts = [p for p in parts if len(p)]
    if not parts:
        return Grams(np.zeros(0, np.uint64), np.zeros((0, 1), np.int32), np.zeros(0, np.int64))
    alphabet = np.unique(np.concatenate([p.alphabet for p in parts]))
    depth = max(p.ranks.shape[1] for p in parts)
    ranks, weights = [], []
    for p in parts:
        to = np.concatenate([[0], np.searchsorted(alphabet, p.alphabet) + 1]).astype(np.int32)
        ranks.append(np.pad(to[p.ranks], ((0, 0), (0, depth - p.ranks.shape[1]))))
        weights.append(p.weights)
    return sorted_grams(alphabet, np.concatenate(ranks), np.concatenate(weights))


def compose(asked: np.ndarray, machine: Transducer) -> np.ndarray:
    """The weights that a transducer gives to n-grams (rows of labels, 0 after the end): the rows, read as
    paths, go through the transducer in step. 0 for an n-gram that it does not hold."""
    weights = np.zeros(len(asked), np.int64)
    state = np.full(len(asked), machine.start, np.int64)
    rows = np.arange(len(asked))
    n = len(machine.alphabet) + 2
    owner = np.repeat(np.arange(len(machine.first) - 1), np.diff(machine.first))
    arcs = owner * n + machine.label  # sorted, as states are in order and their arcs by label
    for d in range(asked.shape[1]):
        labels = asked[rows, d]
        going = labels != 0
        rows, state, labels = rows[going], state[going], labels[going]
        weights[rows] = 0
        rank = np.searchsorted(machine.alphabet, labels)
        known = rank < len(machine.alphabet)
        known[known] = machine.alphabet[rank[known]] == labels[known]
        wanted = state * n + np.where(known, rank + 1, n - 1)
        at = np.searchsorted(arcs, wanted)
        hit = at < len(arcs)
        hit[hit] = arcs[at[hit]] == wanted[hit]
        rows, at = rows[hit], at[hit]
        weights[rows] = machine.weight[at]
        state = machine.target[at]
    return weights


_KINDS = (np.uint8, np.uint16, np.uint32, np.uint64)


def _small(values: np.ndarray) -> np.ndarray:
    most = int(values.max()) if len(values) else 0
    return values.astype(next(k for k in _KINDS if most <= np.iinfo(k).max))


def pack(machine: Transducer) -> bytes:
    """The transducer as bytes."""
    parts = [machine.alphabet.astype(np.uint64)]
    parts += [_small(x) for x in (np.diff(machine.first), machine.label, machine.weight, machine.target)]
    head = np.array([v for p in parts for v in (p.itemsize, len(p))], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), *[p.tobytes() for p in parts]]))


def unpack(data: bytes) -> Transducer:
    raw = zstandard.ZstdDecompressor().decompress(data)
    head = np.frombuffer(raw, np.int64, 10)
    at, parts = 80, []
    for size, n in head.reshape(-1, 2).tolist():
        kind = np.dtype(f"u{size}")
        parts.append(np.frombuffer(raw, kind, n, at))
        at += size * n
    sizes, label, weight, target = (p.astype(np.int64) for p in parts[1:])
    return Transducer(parts[0], np.concatenate([[0], np.cumsum(sizes)]), label, weight, target)
