"""Byte-pair encoding of many pre-tokens at once, on ragged numpy arrays.

All sequences of a batch lie behind one another in one array. In each round every sequence applies its
lowest-rank pair, at all places where it occurs, and sequences without a pair leave. Merging all places of a pair
at once gives the library's result because a pair that a merge creates always has a higher rank than the merge.

A round over the array costs its length. A sequence of more than ``LONG`` symbols therefore keeps its places in buckets
by rank and looks up again only what stands beside a merge, so that its rounds cost their merges.
"""

from __future__ import annotations

import heapq
import json

import numpy as np

NONE = np.int32(2**31 - 1)
LONG = 4096


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(free)
            free += 1
    return [out[b] for b in range(256)]


class PairTable:
    """Ids and merges of one vocabulary file: pairs in an open-addressed table of 2**20 places."""

    def __init__(self, model_json: str):
        model = json.loads(model_json)["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        marks = byte_characters()
        self.first = np.array([vocab[c] for c in marks], dtype=np.int32)
        self.last = np.array([vocab[c + end] for c in marks], dtype=np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
        self.keys = np.full(1 << 20, -1, dtype=np.int64)
        self.ranks = np.full(1 << 20, NONE, dtype=np.int32)
        self.made = made
        keys, todo, step = left << 32 | right, np.arange(len(merges)), 0
        while len(todo):
            spots = self._spot(keys[todo], step)
            free = self.keys[spots] == -1
            _, firsts = np.unique(spots[free], return_index=True)
            put = np.flatnonzero(free)[firsts]
            self.keys[spots[put]], self.ranks[spots[put]] = keys[todo[put]], todo[put]
            todo, step = np.delete(todo, put), step + 1
        self.probes = step

    @staticmethod
    def _spot(keys: np.ndarray, step: int) -> np.ndarray:
        mixed = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
        return ((mixed + np.uint64(step * 7919)) & np.uint64((1 << 20) - 1)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 32 | b
        spots = self._spot(keys, 0)
        found = self.keys[spots]
        out = np.where(found == keys, self.ranks[spots], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        for step in range(1, self.probes):
            if not len(open_):
                break
            spots = self._spot(keys[open_], step)
            found = self.keys[spots]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[spots[hit]]
            open_ = open_[~hit & (found != -1)]
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of the sequences ``data[offsets[i]:offsets[i + 1]]`` of bytes."""
        lengths = np.diff(offsets)
        symbols = self.first[data]
        full = lengths > 0
        ends = offsets[1:][full] - 1
        symbols[ends] = self.last[data[ends]]
        owner = np.repeat(np.arange(len(lengths)), lengths)
        done_symbols, done_owner = [], []
        for i in np.flatnonzero(lengths > LONG):
            done_symbols.append(self._merged_alone(symbols[offsets[i]:offsets[i + 1]]))
            done_owner.append(np.full(len(done_symbols[-1]), i))
        if done_symbols:
            short = (lengths <= LONG)[owner]
            symbols, owner = symbols[short], owner[short]
        while len(symbols):
            ranks = np.full(len(symbols), NONE, dtype=np.int32)
            inside = np.flatnonzero(owner[:-1] == owner[1:])
            ranks[inside] = self.rank(symbols[inside], symbols[inside + 1])
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.repeat(np.minimum.reduceat(ranks, starts), np.diff(np.r_[starts, len(symbols)]))
            over = lowest == NONE
            if over.any():
                done_symbols.append(symbols[over])
                done_owner.append(owner[over])
                going = ~over
                symbols, owner, ranks, lowest = symbols[going], owner[going], ranks[going], lowest[going]
            at = np.flatnonzero(ranks == lowest)
            at = at[_every_other(at)]
            symbols[at] = self.made[ranks[at]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if not done_symbols:
            return np.zeros(0, dtype=np.int32), np.zeros(len(lengths) + 1, dtype=np.int64)
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        counts = np.bincount(owner, minlength=len(lengths))
        return symbols[order], np.r_[0, np.cumsum(counts)]

    def _merged_alone(self, symbols: np.ndarray) -> np.ndarray:
        """The merged symbols of one sequence: all places of the lowest rank, then of the next lowest, and so on."""
        n = len(symbols)
        symbols = np.r_[symbols, 0]
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        ranks = np.full(n + 1, NONE, dtype=np.int32)
        ranks[:n - 1] = self.rank(symbols[:n - 1], symbols[1:n])
        left = np.ones(n, dtype=bool)
        buckets: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def put(places: np.ndarray) -> None:
            found = ranks[places]
            places, found = places[found != NONE], found[found != NONE]
            order = np.argsort(found, kind="stable")
            places, found = places[order], found[order]
            cuts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else found
            for rank, lo, hi in zip(found[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(found)]):
                if rank not in buckets:
                    buckets[rank] = []
                    heapq.heappush(waiting, rank)
                buckets[rank].append(places[lo:hi])

        put(np.arange(n - 1))
        while waiting:
            rank = heapq.heappop(waiting)
            at = np.unique(np.concatenate(buckets.pop(rank)))
            at = at[ranks[at] == rank]  # places that a merge has changed since are in other buckets
            if not len(at):
                continue
            at = at[_every_other(at, after)]
            gone = after[at]
            symbols[at], ranks[gone], left[gone] = self.made[rank], NONE, False
            after[at] = after[gone]
            before[after[at]] = at
            beside = before[at]
            look = np.unique(np.r_[at, beside[beside >= 0]])
            paired = after[look] < n
            ranks[look] = NONE
            ranks[look[paired]] = self.rank(symbols[look[paired]], symbols[after[look[paired]]])
            put(look)
        return symbols[:n][left]


def _every_other(at: np.ndarray, after: np.ndarray | None = None) -> np.ndarray:
    """In runs of neighbours (a pair of equal symbols overlapping itself) the 1st, 3rd, ... of each run."""
    if not len(at):
        return np.zeros(0, dtype=bool)
    start = np.r_[True, (at[:-1] + 1 if after is None else after[at[:-1]]) != at[1:]]
    first = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
    return (np.arange(len(at)) - first) % 2 == 0


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices values[starts[i]:starts[i] + lengths[i]] behind one another."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return values[shift + np.arange(total)]
