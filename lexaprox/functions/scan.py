"""One query against many terms at once.

Terms are held by length, as matrices of code points and of symbol counts, and as
bits of the classes of their symbols. For a query the bits, then the counts, leave
those terms that have not too many symbols too much on either side; these fill
their distance matrices together, a term's symbol after
another, and a term goes as soon as no end within the budget is left."""

from __future__ import annotations

from functools import cache

import numpy as np

from .costs import UNIT, CostModel
from .distance import FAR, _adjacency, _codes
from .layout import neighbours


class TermBlock:
    """Terms (id, norm, weight) for scanning, in the order of their length."""

    def __init__(self, ids, norms: list[str], weights):
        n = np.fromiter(map(len, norms), dtype=np.int64, count=len(norms))
        order = np.argsort(n, kind="stable")
        self.order, self.ids, self.weights = order, np.asarray(ids, dtype=np.int64)[order], np.asarray(weights, dtype=np.int64)[order]
        self.lengths, self.begin = np.unique(n[order], return_index=True)
        self.end = np.append(self.begin[1:], len(order))
        # Classes that a term has, and those that it has twice.
        self.codes, self.masks, self.twice = [], np.zeros(len(order), np.uint64), np.zeros(len(order), np.uint64)
        # Counts of symbols, of a length at a time.
        self.counts = []
        for length, lo, hi in zip(self.lengths.tolist(), self.begin, self.end):
            codes = _codes([norms[i] for i in order[lo:hi]])[0].astype(np.int32)
            counts = np.zeros((hi - lo, 32), dtype=np.int8)
            for j in range(length):
                if j < 127:
                    counts[np.arange(hi - lo), codes[:, j] & 31] += 1
                bit = _bits(codes[:, j])
                self.twice[lo:hi] |= self.masks[lo:hi] & bit
                self.masks[lo:hi] |= bit
            self.codes.append(codes)
            self.counts.append(counts)
        self.near: dict[str, np.ndarray] = {}

    def _near(self, layout: str) -> np.ndarray:
        """Of each term: the classes of the keys that touch one of its symbols."""
        if layout not in self.near:
            touched, out = _touched(layout), np.zeros(len(self.ids), np.uint64)
            for codes, lo, hi in zip(self.codes, self.begin, self.end):
                for j in range(codes.shape[1]):
                    out[lo:hi] |= touched[np.minimum(codes[:, j], len(touched) - 1)]
            self.near[layout] = out
        return self.near[layout]

    def search(self, q: str, budget: int, cm: CostModel, prefix: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, costs, weights) of all terms within the budget."""
        m, band, most = len(q), budget // cm.c_indel_min, budget // cm.c_min
        code = np.array([ord(c) for c in q], dtype=np.int32)
        own = np.bincount(code & 31, minlength=32).clip(0, 127).astype(np.int8) if m else np.zeros(32, np.int8)
        first = int(np.searchsorted(self.lengths, m - band))
        last = len(self.lengths) if prefix else int(np.searchsorted(self.lengths, m + band, side="right"))
        if first >= last:
            return (np.empty(0, np.int64),) * 3
        lo, hi = self.begin[first], self.end[last - 1]
        passed = self._possible(code, lo, hi, budget, cm, prefix)
        # Of all lengths together, the shorter first, each as far as it can matter.
        width, parts = min(m + band, int(self.lengths[last - 1])), []
        for k in range(first, last):
            at = passed[np.searchsorted(passed, self.begin[k]) : np.searchsorted(passed, self.end[k])] - self.begin[k]
            apart = own - self.counts[k][at]
            # Counts stop at 127 on either side; longer texts could only look nearer.
            keep = np.maximum(apart, 0).sum(1) <= most
            if not prefix:
                keep &= np.maximum(-apart, 0).sum(1) <= most
            if keep.any():
                parts.append((k, at[keep]))
        n = np.repeat([min(width, int(self.lengths[k])) for k, _ in parts], [len(at) for _, at in parts])
        codes, row = np.zeros((len(n), width), np.int32), 0
        for k, at in parts:
            own_width = min(width, int(self.lengths[k]))
            codes[row : row + len(at), :own_width] = self.codes[k][at, :own_width]
            row += len(at)
        at = np.concatenate([at + self.begin[k] for k, at in parts]) if parts else np.empty(0, np.int64)
        live, cost = _fill(code, codes, n, budget, cm, prefix)
        return self.ids[at[live]], cost, self.weights[at[live]]

    def _possible(self, code: np.ndarray, lo: int, hi: int, budget: int, cm: CostModel, prefix: bool) -> np.ndarray:
        """Places of the terms that no bound on symbols keeps out: every class of
        symbols that the other text lacks has to be left out or replaced, cheaply
        only by a key that touches it and that the other text has. The first of
        equal symbols is never a doubled one; a second one that is too much costs an
        edit more."""
        if cm.first < 4:
            return np.arange(lo, hi)
        dear = min(cm.sub, cm.indel)
        cheap = min(dear, cm.sub_adjacent)
        masks, near, touched = self.masks[lo:hi], self._near(cm.layout)[lo:hi], _touched(cm.layout)
        mine, mine2 = own_bits(code)
        cost = lambda x, near, y: cheap * np.bitwise_count(x).astype(np.int16) + (dear - cheap) * np.bitwise_count(x & ~near).astype(np.int16) + cm.c_min * np.bitwise_count(y).astype(np.int16)
        # The first bound leaves few; the others are worked out for these.
        at = np.flatnonzero(cheap * np.bitwise_count(mine & ~masks).astype(np.int16) <= budget)
        masks, twice = masks[at], self.twice[lo:hi][at]
        keep = cost(mine & ~masks, near[at], mine2 & ~twice) <= budget
        if not prefix:
            about = np.bitwise_or.reduce(touched[np.minimum(code, len(touched) - 1)], initial=np.uint64(0))
            keep &= cost(masks & ~mine, about, twice & ~mine2) <= budget
        return at[keep] + lo


class RankedTerms:
    """Terms as blocks, the heaviest first, each some times as large as the one before.

    Hits rank by cost, then weight, then id, so once a query has k hits, terms of
    later blocks only matter if they cost less than the last of these."""

    def __init__(self, ids, norms: list[str], weights, first: int = 4096, times: int = 4):
        ids, weights = np.asarray(ids, dtype=np.int64), np.asarray(weights, dtype=np.int64)
        order, self.blocks = np.lexsort((ids, -weights)), []
        while len(order):
            at, order, first = order[:first], order[first:], first * times
            self.blocks.append(TermBlock(ids[at], [norms[i] for i in at], weights[at]))

    def best(self, q: str, k: int, budget: int, ranking: str, cm: CostModel, prefix: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, costs, weights) of the k best terms within the budget, best first."""
        kept = (np.empty(0, np.int64),) * 3
        for block in self.blocks if k else ():
            if budget < 0:
                break
            found = block.search(q, budget, cm, prefix)
            if len(found[0]):
                kept = tuple(np.concatenate(x) for x in zip(kept, found))
                at = top(*kept, k, ranking)
                kept = tuple(x[at] for x in kept)
            if len(kept[0]) == k:
                budget = min(budget, beaten(int(kept[1][-1]), ranking))
        return kept


def beaten(worst: int, ranking: str) -> int:
    """What a term may cost that is to rank before all lighter ones of cost `worst`."""
    return (-(-worst // UNIT) - 1) * UNIT if ranking == "coarse" else worst - 1


def own_bits(code: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Classes of a query's symbols, and those that come twice."""
    kinds, n = np.unique(_bits(code), return_counts=True)
    return np.bitwise_or.reduce(kinds, initial=np.uint64(0)), np.bitwise_or.reduce(kinds[n > 1], initial=np.uint64(0))


def _bits(code: np.ndarray) -> np.ndarray:
    """Each symbol's class as a bit; as costs.symbol_mask."""
    rest = code % 38
    kind = np.where(code < 128, code & 63, rest + np.where(rest < 33, 0, 26))
    return np.left_shift(np.uint64(1), kind.astype(np.uint64))


@cache
def _touched(layout: str) -> np.ndarray:
    """By code point, the last one for all beyond: the classes of the keys that touch it."""
    pairs = [(ord(a), ord(b)) for a, b in neighbours(layout)]
    out = np.zeros(max([128, *(a for a, _ in pairs)]) + 2, np.uint64)
    for a, b in pairs:
        out[a] |= _bits(np.array([b]))[0]
    return out


def _fill(q: np.ndarray, t: np.ndarray, n: np.ndarray, budget: int, cm: CostModel, prefix: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of t, whose lengths n ascend, are within the budget, and their costs."""
    m, width = len(q), t.shape[1]
    number, touch = _adjacency(cm.layout)
    small = lambda x: np.where(x < len(number), number[np.minimum(x, len(number) - 1)], 0)
    step = np.where(touch[small(q)], cm.sub_adjacent, cm.sub)  # of each of the query's symbols by the key of the term's
    lose = np.full(m, cm.indel)
    lose[1:][q[1:] == q[:-1]] = cm.indel_double
    if m:
        step[0], lose[0] = step[0] * cm.first // 4, lose[0] * cm.first // 4
    # The dearest path fits in half the room, if costs and texts are ordinary.
    kind = np.int16 if 2 * max(cm.sub, cm.indel, cm.transpose) * max(4, cm.first) // 4 * (m + width + 2) < 30_000 else np.int32
    ahead = np.concatenate([[0], np.cumsum(lose)]).astype(kind)
    step = np.ascontiguousarray(step.T.astype(kind))  # [key, i]
    rows, d = np.arange(len(t)), np.broadcast_to(ahead, (len(t), m + 1))
    before, key = None, small(t)
    best = d[:, m].copy() if prefix else None
    if not width:
        # The empty prefix of a term.
        cost = d[:, m].astype(np.int64)
        return rows[cost <= budget], cost[cost <= budget]
    found = []
    for j in range(width if len(t) else 0):
        s = t[:, j]
        gain = np.where(s == t[:, j - 1], cm.indel_double, cm.indel).astype(kind) if j else np.full(len(t), cm.indel, kind)
        new = d + gain[:, None]
        new[:, 0] = d[:, 0] + gain * cm.first // 4
        if m:
            same = s[:, None] == q
            replaced = step[key[:, j]]
            replaced[same] = 0
            replaced += d[:, :-1]
            np.minimum(new[:, 1:], replaced, out=new[:, 1:])
            if j and m > 1:
                swap = same[:, :-1] & (t[:, j - 1][:, None] == q[1:]) & (q[1:] != q[:-1])
                r, i = np.nonzero(swap)
                if len(r):
                    dear = np.where(i == 0, cm.transpose * cm.first // 4, cm.transpose)
                    new[r, i + 2] = np.minimum(new[r, i + 2], before[r, i] + dear)
            # What is left out of the query: a running minimum less what leaving out costs.
            new -= ahead
            np.minimum.accumulate(new, axis=1, out=new)
            new += ahead
        before, d = d, new
        if prefix:
            np.minimum(best, d[:, m], out=best)
        ended = int(np.searchsorted(n, j + 1, side="right"))
        if ended:
            found.append((rows[:ended], (best if prefix else d[:, m])[:ended].astype(np.int64)))
            rows, t, n, key, d, before = (x[ended:] for x in (rows, t, n, key, d, before))
            best = best[ended:] if prefix else None
        if not len(rows):
            break
        if j % 2 and not prefix:
            # What is left of both texts differs in length, which costs; a swap goes past a row.
            left = n - 1 - j
            rest = (np.abs(np.arange(m, -1, -1) - np.arange(left[-1] + 2)[:, None]) * cm.c_indel_min).astype(kind)
            keep = ((d + rest[left]).min(1) <= budget) | ((before + rest[left + 1]).min(1) + cm.transpose * min(4, cm.first) // 4 <= budget)
            if not keep.all():
                rows, t, n, key, d, before = (x[keep] for x in (rows, t, n, key, d, before))
                if not len(rows):
                    break
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rows, cost = (np.concatenate(x) for x in zip(*found))
    ok = cost <= budget
    return rows[ok], cost[ok]


def top(ids: np.ndarray, cost: np.ndarray, weights: np.ndarray, k: int, ranking: str) -> np.ndarray:
    """Places of the k best."""
    return np.lexsort((ids, -weights, -(-cost // 16) if ranking == "coarse" else cost))[:k]
