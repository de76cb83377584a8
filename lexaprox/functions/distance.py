"""Weighted edit distances of query and term, vectorised over Arrow batches.

The distance is the restricted one: neighbouring symbols may be swapped, and a
swapped pair is not edited again. A batch's pairs are sorted by length into
groups; a group's matrices are filled together, a numpy operation for each
cell, so Python's cost is by cell and group, not by pair."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .costs import CostModel
from .layout import neighbours

FAR = 30000


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row for each, zero beyond its end."""
    n = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = np.zeros((len(texts), max(1, int(n.max(initial=0)))), dtype=np.int64)
    out[np.arange(out.shape[1]) < n[:, None]] = flat
    return out, n


@cache
def _adjacency(layout: str) -> tuple[np.ndarray, np.ndarray]:
    """Small numbers for keys, by code point, and which of these touch."""
    keys = sorted({a for a, _ in neighbours(layout)})
    number = np.zeros(max(map(ord, keys)) + 1, dtype=np.int64)
    number[[ord(k) for k in keys]] = np.arange(1, len(keys) + 1)
    touch = np.zeros((len(keys) + 1,) * 2, dtype=bool)
    for a, b in neighbours(layout):
        touch[number[ord(a)], number[ord(b)]] = True
    return number, touch


def _matrices(q: np.ndarray, t: np.ndarray, cm: CostModel) -> list[list[np.ndarray]]:
    """d[j][i], for each pair: the cost of i symbols of the query and j of the term."""
    g, m, n = len(q), q.shape[1], t.shape[1]
    number, touch = _adjacency(cm.layout)
    small = lambda x: np.where(x < len(number), number[np.minimum(x, len(number) - 1)], 0)
    qk, tk = small(q), small(t)
    lose = np.where(np.concatenate([np.zeros((g, 1), bool), q[:, 1:] == q[:, :-1]], 1), cm.indel_double, cm.indel)
    lose[:, :1] = lose[:, :1] * cm.first // 4
    gain = np.where(np.concatenate([np.zeros((g, 1), bool), t[:, 1:] == t[:, :-1]], 1), cm.indel_double, cm.indel)
    gain0 = gain * cm.first // 4
    d = [[np.zeros(g, np.int64)]]
    for i in range(1, m + 1):
        d[0].append(d[0][-1] + lose[:, i - 1])
    for j in range(1, n + 1):
        row = [d[j - 1][0] + gain0[:, j - 1]]
        for i in range(1, m + 1):
            a, b = q[:, i - 1], t[:, j - 1]
            step = np.where(touch[qk[:, i - 1], tk[:, j - 1]], cm.sub_adjacent, cm.sub)
            if i == 1:
                step = step * cm.first // 4
            best = d[j - 1][i - 1] + np.where(a == b, 0, step)
            np.minimum(best, row[i - 1] + lose[:, i - 1], out=best)
            np.minimum(best, d[j - 1][i] + gain[:, j - 1], out=best)
            if i > 1 and j > 1:
                swap = (a == t[:, j - 2]) & (q[:, i - 2] == b) & (a != q[:, i - 2])
                np.minimum(best, d[j - 2][i - 2] + np.where(swap, cm.transpose_cost(i - 2), FAR), out=best)
            row.append(best)
        d.append(row)
    return d


def distances(qs: list[str], ts: list[str], cm: CostModel, prefix: bool = False) -> np.ndarray:
    """The cost of each pair; with prefix, to the best prefix of the term."""
    out = np.zeros(len(qs), dtype=np.int64)
    if not len(qs):
        return out
    m, n = (np.fromiter(map(len, x), dtype=np.int64, count=len(x)) for x in (qs, ts))
    group = (-(-m // 2)) * 100_000 + -(-n // 4)
    order = np.argsort(group, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        for lo in range(0, len(part), 4096):
            at = part[lo : lo + 4096]
            (q, mq), (t, nt) = _codes([qs[i] for i in at]), _codes([ts[i] for i in at])
            # Zero beyond the end could match zero: symbols beyond it are never read.
            d = _matrices(q, t, cm)
            rows = np.arange(len(at))
            if prefix:
                ends = np.stack([np.stack(r)[mq, rows] for r in d])
                ends[np.arange(len(d))[:, None] > nt] = FAR
                out[at] = ends.min(0)
            else:
                low = [int(nt.min()), int(nt.max())]
                stack = np.stack([np.stack(d[j])[mq, rows] for j in range(low[0], low[1] + 1)])
                out[at] = stack[nt - low[0], rows]
    return out


def distance(q: str | Column, t: str | Column, cm: CostModel = CostModel(), prefix: bool = False) -> Column:
    """Column of weighted costs; null where either is null."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        ok = (a.notna() & b.notna()).to_numpy()
        out = pd.array([pd.NA] * len(a), dtype="Int32")
        if ok.any():
            out[ok] = distances(a[ok].tolist(), b[ok].tolist(), cm, prefix).astype(np.int32)
        return pd.Series(out)

    return F.pandas_udf(run, "int")(q, t)


UNIT_COSTS = CostModel(sub=1, sub_adjacent=1, indel=1, indel_double=1, transpose=1, first=4)


def unit_osa(q: str | Column, t: str | Column) -> Column:
    """The restricted distance with all edits at 1."""
    return distance(q, t, UNIT_COSTS)


def osa_within(q: str, t: str, most: int) -> Column:
    """unit_osa, null beyond `most`; pairs too different in length are not computed."""
    near = F.abs(F.length(q) - F.length(t)) <= most
    d = unit_osa(F.when(near, F.col(q)), F.when(near, F.col(t)))
    return F.when(d <= most, d)


def distance_sql(q: str, t: str, cm: CostModel = CostModel()) -> Column:
    """The same cost by JVM functions alone, for plans that may have no Python."""
    pairs = "array(" + ", ".join(f"'{a.replace(chr(39), chr(92) + chr(39))}{b.replace(chr(39), chr(92) + chr(39))}'" for a, b in sorted(neighbours(cm.layout))) + ")"
    m, c = f"length({q})", lambda s, i: f"substring({s}, {i}, 1)"
    i, j, at = f"(x % ({m} + 1))", f"(x div ({m} + 1))", lambda back: f"element_at(d, CAST(x + 1 - ({back}) AS INT))"
    first = lambda cost, place: f"IF({place} = 0, {cost} * {cm.first} div 4, {cost})"
    sub = f"IF({c(q, i)} = {c(t, j)}, 0, {first(f'IF(array_contains({pairs}, concat({c(q, i)}, {c(t, j)})), {cm.sub_adjacent}, {cm.sub})', f'{i} - 1')})"
    lose = first(f"IF({i} > 1 AND {c(q, i)} = {c(q, i + ' - 1')}, {cm.indel_double}, {cm.indel})", f"{i} - 1")
    gain = first(f"IF({j} > 1 AND {c(t, j)} = {c(t, j + ' - 1')}, {cm.indel_double}, {cm.indel})", i)
    swap = f"{i} > 1 AND {j} > 1 AND {c(q, i)} = {c(t, j + ' - 1')} AND {c(q, i + ' - 1')} = {c(t, j)} AND {c(q, i)} <> {c(q, i + ' - 1')}"
    cell = f"""least(IF({i} > 0 AND {j} > 0, {at(f'{m} + 2')} + {sub}, {FAR}), IF({i} > 0, {at('1')} + {lose}, {FAR}), IF({j} > 0, {at(f'{m} + 1')} + {gain}, {FAR}),
        IF({swap}, {at(f'2 * {m} + 4')} + {first(str(cm.transpose), f'{i} - 2')}, {FAR}))"""
    return F.expr(f"CAST(element_at(aggregate(sequence(0, ({m} + 1) * (length({t}) + 1) - 1), CAST(array() AS ARRAY<BIGINT>), (d, x) -> IF(x = 0, array(0L), concat(d, array(CAST({cell} AS BIGINT))))), -1) AS INT)")
