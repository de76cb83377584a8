"""The older search of one query against many distinct texts at once.

Texts are held as the terms of a TermBlock: classes of symbols as bits leave the
few that can be near; places, letter counts and edits are worked out for these."""

from __future__ import annotations

import re

import numpy as np

from .distance import UNIT_COSTS
from .scan import TermBlock, _fill, own_bits
from .typo_scores import combined_scores


class FuzzyBlock(TermBlock):
    """Distinct texts: id, the smallest index of its rows; text; how many rows, as weight."""

    def __init__(self, ids, texts: list[str], copies):
        super().__init__(ids, texts, copies)
        self.texts = [texts[i] for i in self.order]

    def candidates(self, q: str, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances, by the first of these that holds: as many places
        differ as k allows; one character more or less; letters that nearly agree
        and k edits at most. Each is k edits or one, so as many classes of symbols
        at most are in one text only."""
        m, most, code = len(q), max(k, 1), np.array([ord(c) for c in q], dtype=np.int32)
        first, last = int(np.searchsorted(self.lengths, m - most)), int(np.searchsorted(self.lengths, m + most, side="right"))
        if first >= last:
            return (np.empty(0, np.int64),) * 2
        lo, hi = self.begin[first], self.end[last - 1]
        mine, mine2 = own_bits(code)
        at = np.flatnonzero(np.bitwise_count(mine & ~self.masks[lo:hi]) <= most) + lo
        masks, twice = self.masks[at], self.twice[at]
        lacks = lambda x, y: np.bitwise_count(x) + np.bitwise_count(y) <= most
        passed = at[lacks(mine & ~masks, mine2 & ~twice) & lacks(masks & ~mine, twice & ~mine2)]
        own, places, found, parts = _letters(code[None])[0], [], [], []
        for f in range(first, last):
            at, n = passed[np.searchsorted(passed, self.begin[f]) : np.searchsorted(passed, self.end[f])], int(self.lengths[f])
            if not len(at):
                continue
            t, both = self.codes[f][at - self.begin[f], :n], min(m, n)
            distance = (t[:, :both] != code[:both]).sum(1) + abs(m - n)
            places.append(at[distance <= k])
            found.append(distance[distance <= k])
            at, t = at[distance > k], t[distance > k]
            apart = np.abs(_letters(t) - own).sum(1)
            if abs(m - n) == 1:
                one = (_one_cut(code, t) if m > n else _one_cut(t, code)) & ((m > n) | (apart == 1))
                places.append(at[one])
                found.append(np.ones(int(one.sum()), np.int64))
                at, t, apart = at[~one], t[~one], apart[~one]
            near = apart <= 2
            if k >= 2 and abs(m - n) <= 2 and near.any():
                parts.append((at[near], t[near]))
        if parts:
            at, n = np.concatenate([a for a, _ in parts]), np.concatenate([np.full(len(a), t.shape[1]) for a, t in parts])
            codes, row = np.zeros((len(at), int(n[-1])), np.int32), 0
            for a, t in parts:
                codes[row : row + len(a), : t.shape[1]] = t
                row += len(a)
            live, cost = _fill(code, codes, n, k, UNIT_COSTS, False)
            places.append(at[live])
            found.append(cost)
        return (np.concatenate(places), np.concatenate(found).astype(np.int64)) if places else (np.empty(0, np.int64),) * 2

    def holding(self, words: list[str], k: int) -> np.ndarray:
        """How many of the words each text holds, with as many places different as k allows."""
        held = np.zeros(len(self.ids), np.int64)
        for word in words:
            w = np.array([ord(c) for c in word], dtype=np.int32)
            for codes, lo, hi, n in zip(self.codes, self.begin, self.end, self.lengths.tolist()):
                hit = np.zeros(hi - lo, bool)
                for p in range(n - len(w) + 1):
                    hit |= (codes[:, p : p + len(w)] != w).sum(1) <= k
                held[lo:hi] += hit
        return held

    def best(self, q: str, most: int, k: int, curve: np.ndarray, board: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(texts, scores, distances, turns): the best candidates (turn 0) and, if
        their rows are too few for a query of several words, the best of the
        others that hold its words (turn 1)."""
        at, distance = self.candidates(q, k)
        score = combined_scores(q.encode(), [self.texts[i].encode() for i in at], distance, curve, board)
        keep = np.lexsort((self.ids[at], -score))[:most]
        places, scores, distances, turns = [at[keep]], [score[keep]], [distance[keep]], [np.zeros(len(keep), np.int64)]
        words = [w for w in re.split("[ \t\n\r]+", q) if len(w) >= 2]
        if " " in q and len(words) > 1 and self.weights[at].sum() < most:
            held = self.holding(words, k)
            held[at] = 0
            more = np.flatnonzero(held)
            share = ((np.float32(0.8) * held[more].astype(np.float32)).astype(np.float64) / len(words)).astype(np.float32)
            keep = np.lexsort((self.ids[more], -share))[:most]
            for out, x in zip((places, scores, distances, turns), (more[keep], share[keep], np.full(len(keep), k), np.ones(len(keep), np.int64))):
                out.append(x)
        return [self.texts[i] for i in np.concatenate(places)], *(np.concatenate(x) for x in (scores, distances, turns))


def _letters(t: np.ndarray) -> np.ndarray:
    """How often each of the characters 32..127 comes in each row, 255 at most."""
    kind = np.where((t >= 32) & (t <= 127), t - 32, 96) + 97 * np.arange(len(t))[:, None]
    return np.minimum(np.bincount(kind.ravel(), minlength=97 * len(t)).reshape(len(t), 97)[:, :96], 255)


def _one_cut(longer: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Whether taking one character out of `longer` gives `shorter`; either is a row or many."""
    n = shorter.shape[-1]
    before, after = (longer[..., :n] == shorter), (longer[..., 1 : n + 1] == shorter)
    head = np.logical_and.accumulate(before, axis=1).sum(1)
    tail = np.logical_and.accumulate(after[:, ::-1], axis=1).sum(1)
    return head + tail >= n
