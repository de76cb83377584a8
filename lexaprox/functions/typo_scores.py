"""Scores of the older, byte-wise method: typo likelihood, code distance and
letter counts. Single precision, as its results are defined."""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .layout import LAYOUTS

_F = np.float32
BOARDS = ("qwerty", "azerty", "qwertz")
# Groups of letters with codes side by side, by keyboard.
GROUPS = {
    "qwerty": ["aeiou", "sdf", "jkl", "qwrt", "yp", "bvg", "cxz", "nm", "h"],
    "azerty": ["aeiou", "qsdf", "jklm", "azrt", "yp", "bvg", "cxw", "n", "h"],
    "qwertz": ["aeiou", "sdf", "jkl", "qwrt", "zp", "bvg", "cxy", "nm", "h"],
}
# Keys of one finger that do not touch.
FINGERS = {
    "qwerty": [("e", "c"), ("r", "v"), ("t", "b"), ("y", "n"), ("u", "m"), ("i", "k"), ("w", "x"), ("q", "z")],
    "azerty": [("e", "c"), ("r", "v"), ("t", "b"), ("y", "n"), ("u", "m"), ("z", "x"), ("a", "w")],
    "qwertz": [("e", "c"), ("r", "v"), ("t", "b"), ("z", "n"), ("u", "m"), ("i", "k"), ("w", "x"), ("q", "y")],
}
# End of fixed values.


@cache
def confusion(board: str) -> np.ndarray:
    """How easily two letters are taken for each other: 26 x 26."""
    if board not in BOARDS:
        raise ValueError(f"unknown keyboard {board!r}")
    out = np.full((26, 26), 0.05, dtype=np.float32)
    np.fill_diagonal(out, 1)
    rows = [[c for c in r if c.isascii() and c.isalpha()] for r in LAYOUTS[board]]

    def put(a: str, b: str, v: float) -> None:
        out[ord(a) - 97, ord(b) - 97] = out[ord(b) - 97, ord(a) - 97] = v

    for k, row in enumerate(rows):
        for i, (a, b) in enumerate(zip(row, row[1:])):
            put(a, b, 0.8 if k == 1 and i < 3 else 0.7)
    # Keys in one column; of the lower two rows only QWERTY's are listed.
    for a, b in list(zip(rows[0], rows[1]))[:9]:
        put(a, b, 0.5)
    if board == "qwerty":
        for a, b in zip(rows[1], rows[2]):
            put(a, b, 0.4)
    for a, b in FINGERS[board]:
        put(a, b, 0.3)
    return out


def position_curve(most: int) -> np.ndarray:
    """How likely a slip is at each place of terms of up to `most` bytes."""
    t = np.arange(most, dtype=np.float32) / _F(max(1, most))
    middle = _F(0.45) + np.exp(-(((t - _F(0.55)) * _F(4)) ** 2)) * _F(0.55)
    w = np.where(t < _F(0.2), _F(0.15) + t * _F(1.5), np.where(t < _F(0.8), middle, _F(0.5) - (t - _F(0.8)) * _F(1.5)))
    return np.clip(w, _F(0.1), _F(1)).astype(np.float32)


@cache
def codes(board: str) -> np.ndarray:
    """A code for each byte: letters by group, each group from a multiple of
    eight (the first from one), digits last, all else zero."""
    table, code = np.zeros(256, dtype=np.uint8), 1
    for group in GROUPS[board]:
        for i, c in enumerate(group):
            table[[ord(c), ord(c.upper())]] = code + i
        code = (code + len(group) + 7) // 8 * 8
    table[48:58] = np.arange(code, code + 10)
    return table


def typo_score(q: bytes, t: bytes, curve: np.ndarray, board: str = "qwerty") -> np.float32:
    if not q or not t:
        return _F(0)
    if q == t:
        return _F(1)
    conf, penalty = confusion(board), _F(0)
    for i, (a, b) in enumerate(zip(q, t)):
        if a != b:
            place = curve[i] if i < len(curve) else _F(0.5)
            likely = conf[a - 97, b - 97] if 97 <= a <= 122 and 97 <= b <= 122 else _F(0.05)
            penalty += (_F(1) - place * _F(0.6)) * (_F(1) - likely * _F(0.5))
    penalty += _F(abs(len(q) - len(t))) * _F(0.15)
    swaps, i, n = 0, 0, min(len(q), len(t))
    while i < n - 1:
        hit = q[i] == t[i + 1] and q[i + 1] == t[i] and q[i] != q[i + 1]
        swaps, i = swaps + hit, i + 1 + hit
    return _F(min(1, max(0, _F(1) - penalty * _F(0.3) + _F(swaps) * _F(0.35))))


def code_distance(q: bytes, t: bytes, board: str = "qwerty") -> int:
    """Bits in which the codes differ, eight for each byte that one has more."""
    table, n = codes(board), min(len(q), len(t))
    a, b = (table[np.frombuffer(x[:n], dtype=np.uint8)] for x in (q, t))
    return int(np.bitwise_count(a ^ b).sum()) + 8 * abs(len(q) - len(t))


def combined_score(q: bytes, t: bytes, hamming: int, curve: np.ndarray, board: str = "qwerty") -> np.float32:
    if hamming == 0 and len(q) == len(t):
        return _F(1)
    most = 8 * max(len(q), len(t))
    apart = min(_F(1), _F(code_distance(q, t, board)) / _F(most)) if most else _F(0)
    raw = _F(0.7) * typo_score(q, t, curve, board) + _F(0.3) * (_F(1) - apart)
    return _F(raw * (_F(1) / (_F(1) + _F(0.05) * _F(abs(len(q) - len(t))))))


def combined_scores(q: bytes, ts: list[bytes], hamming: np.ndarray, curve: np.ndarray, board: str = "qwerty") -> np.ndarray:
    """combined_score of one text and each of many, a place of all at a time, with
    the same single precision steps."""
    m, n = len(q), np.fromiter(map(len, ts), dtype=np.int64, count=len(ts))
    width = min(m, int(n.max(initial=0)))
    t = np.frombuffer(b"".join(x[:width].ljust(width, b"\0") for x in ts), dtype=np.uint8).reshape(len(ts), width)
    both, apart, table, conf = np.minimum(m, n), np.abs(m - n), codes(board), confusion(board)
    penalty, bits, swaps, last = np.zeros(len(ts), np.float32), np.zeros(len(ts), np.int64), np.zeros(len(ts), np.int64), np.zeros(len(ts), bool)
    for i in range(width):
        a, b, inside = q[i], t[:, i], i < both
        place = curve[i] if i < len(curve) else _F(0.5)
        likely = np.where((b >= 97) & (b <= 122), conf[a - 97, np.clip(b, 97, 122) - 97], _F(0.05)) if 97 <= a <= 122 else np.full(len(ts), _F(0.05))
        penalty += np.where(inside & (b != a), (_F(1) - place * _F(0.6)) * (_F(1) - likely * _F(0.5)), _F(0))
        bits += np.where(inside, np.bitwise_count(table[a] ^ table[b]), 0)
        if i + 1 < width and a != q[i + 1]:
            last = (i + 1 < both) & ~last & (t[:, i + 1] == a) & (b == q[i + 1])
            swaps += last
        else:
            last = np.zeros(len(ts), bool)
    penalty += apart.astype(np.float32) * _F(0.15)
    typo = np.clip(_F(1) - penalty * _F(0.3) + swaps.astype(np.float32) * _F(0.35), _F(0), _F(1))
    typo[both == 0] = 0
    most = 8 * np.maximum(m, n)
    off = np.minimum(_F(1), (bits + 8 * apart).astype(np.float32) / np.maximum(most, 1).astype(np.float32))
    raw = _F(0.7) * typo + _F(0.3) * (_F(1) - off)
    return np.where((hamming == 0) & (m == n), _F(1), raw * (_F(1) / (_F(1) + _F(0.05) * apart.astype(np.float32)))).astype(np.float32)


def small(text: Column) -> Column:
    """A-Z in lower case, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hamming(q: str, t: str) -> Column:
    """Places that differ, and the difference in length. Places are characters;
    ASCII texts have a byte for each."""
    return F.expr(f"abs(length({q}) - length({t})) + size(filter(sequence(1, greatest(1, least(length({q}), length({t})))), i -> i <= least(length({q}), length({t})) AND substring({q}, i, 1) <> substring({t}, i, 1)))")


def fingerprint(text: str) -> Column:
    """How often each of the characters 32..127 comes, 255 at most."""
    return F.expr(f"transform(sequence(32, 127), c -> least(255, length({text}) - length(replace({text}, chr(c), ''))))")


def fingerprint_difference(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> abs(x - y)), 0, (s, x) -> s + x)")
