import itertools
import random

import pytest
from pyspark.sql import functions as F

from lexaprox.functions.costs import CostModel, least_cost, symbol_mask, symbol_parts, whole_units
from lexaprox.functions.distance import UNIT_COSTS, distance, distance_sql, distances, osa_within, unit_osa
from lexaprox.functions.layout import LAYOUTS, are_neighbours, neighbours
from lexaprox.functions.scan import TermBlock


def brute(q, t, cm, prefix=False):
    d = {(0, 0): 0}
    for i, j in itertools.product(range(len(q) + 1), range(len(t) + 1)):
        ways = [d[i, j]] if i == j == 0 else []
        if i and j:
            ways.append(d[i - 1, j - 1] + cm.sub_cost(q[i - 1], t[j - 1], i - 1))
        if i:
            ways.append(d[i - 1, j] + cm.del_cost(q, i - 1))
        if j:
            ways.append(d[i, j - 1] + cm.ins_cost(t[j - 1], t[j - 2] if j > 1 else None, i))
        if i > 1 and j > 1 and q[i - 1] == t[j - 2] and q[i - 2] == t[j - 1] and q[i - 1] != q[i - 2]:
            ways.append(d[i - 2, j - 2] + cm.transpose_cost(i - 2))
        d[i, j] = min(ways)
    return min(d[len(q), j] for j in range(len(t) + 1)) if prefix else d[len(q), len(t)]


def texts(seed, n, alphabet="asdfqwerb", most=9):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("alphabet", ["asdfqwer", "aqw", "éèçßa", "жю😀a", "çlp.;"])
@pytest.mark.parametrize("layout", ["qwerty", "abnt2"])
def test_vectorised_is_brute_force(alphabet, layout):
    cm = CostModel.for_layout(layout)
    qs, ts = texts(1, 150, alphabet), texts(2, 150, alphabet)
    for prefix in (False, True):
        assert distances(qs, ts, cm, prefix).tolist() == [brute(q, t, cm, prefix) for q, t in zip(qs, ts)]


@pytest.mark.parametrize("pair,cost", [(("javasript", "javascript"), 16), (("pythno", "python"), 12), (("ryst", "rust"), 8), (("abcab", "ab"), 48), (("vat", "bat"), 12), (("", "ab"), 48), (("", ""), 0)])
def test_known_costs(pair, cost):
    assert distances([pair[0]], [pair[1]], CostModel()).tolist() == [cost]


def test_columns_agree(spark):
    rows = list(zip(texts(3, 60), texts(4, 60))) + [(None, "a"), ("a", None)]
    df = spark.createDataFrame(rows, "q string, t string")
    out = df.select("q", "t", distance("q", "t").alias("a"), distance_sql("q", "t").alias("b"), unit_osa("q", "t").alias("u"), osa_within("q", "t", 2).alias("w")).collect()
    for r in out:
        if r["q"] is None or r["t"] is None:
            assert r["a"] is None and r["u"] is None and r["w"] is None
            continue
        assert r["a"] == r["b"] == brute(r["q"], r["t"], CostModel())
        u = brute(r["q"], r["t"], UNIT_COSTS)
        assert r["u"] == u and r["w"] == (u if u <= 2 else None)


def test_unit_distance_is_restricted(spark):
    assert distances(["ca"], ["abc"], UNIT_COSTS).tolist() == [3]


def test_bounds_never_exceed_the_cost(spark):
    cm = CostModel()
    rows = list(zip(texts(5, 400, "asdfqwerjkl"), texts(6, 400, "asdfqwerjkl")))
    df = spark.createDataFrame(rows, "q string, t string").select("q", "t", symbol_mask("q").alias("qm"), symbol_mask("t").alias("tm"), symbol_parts("q", cm).alias("qp"), symbol_parts("t", cm).alias("tp"))
    for r in df.select("q", "t", least_cost("qp", "tm", cm).alias("a"), least_cost("tp", "qm", cm).alias("b")).collect():
        assert max(r["a"], r["b"]) <= brute(r["q"], r["t"], cm)


def test_block_scan_is_brute_force():
    terms = sorted(set(texts(7, 300)) - {""})
    block = TermBlock(range(len(terms)), terms, [1] * len(terms))
    for cm in (CostModel(), CostModel("dvorak")):
        for q, budget, prefix in itertools.product(texts(8, 12), (0, 7, 32, 64), (False, True)):
            ids, cost, _ = block.search(q, budget, cm, prefix)
            want = {(i, c) for i, t in enumerate(terms) if (c := brute(q, t, cm, prefix)) <= budget}
            assert set(zip(ids.tolist(), cost.tolist())) == want


def test_layouts():
    assert are_neighbours("qwerty", "a", "s") and not are_neighbours("qwerty", "a", "d")
    assert are_neighbours("abnt2", "l", "ç") and are_neighbours("azerty", "m", "ù") and are_neighbours("qwertz", "z", "t")
    for name in LAYOUTS:
        assert all((b, a) in neighbours(name) and a != b for a, b in neighbours(name))
    with pytest.raises(ValueError):
        neighbours("none")


def test_whole_units(spark):
    df = spark.createDataFrame([(c,) for c in (0, 8, 16, 17, 32)], "c int")
    assert [r[0] for r in df.select(whole_units(F.col("c"))).collect()] == [0, 1, 1, 2, 2]
