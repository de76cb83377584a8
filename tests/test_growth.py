"""Searches whose work once grew with all pairs: plans, and results against naive ones."""

import random
import re

import numpy as np
from pyspark.sql import functions as F
from test_other_operators import candidates

from lexaprox.functions.costs import CostModel
from lexaprox.functions.scan import RankedTerms, TermBlock, top
from lexaprox.functions.typo_scores import combined_score, combined_scores, position_curve
from lexaprox.operators import fuzzy_index as fi
from lexaprox.operators import phonetic_search as ps
from lexaprox.operators import search as se
from lexaprox.operators.dictionary import build


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def naive_fuzzy(queries, terms, most, k=2):
    curve, out = position_curve(max(map(len, terms))), set()
    for qid, q in queries:
        hits = [(-float(combined_score(q.encode(), t.encode(), d, curve)), i, d) for i, t in enumerate(terms) if (d := candidates(q, t, k)) is not None]
        words = [w for w in re.split("[ \t\n\r]+", q) if len(w) >= 2]
        if " " in q and len(words) > 1 and len(hits) < most:
            holds = lambda w, t: any(sum(a != b for a, b in zip(w, t[p:])) <= k for p in range(len(t) - len(w) + 1))
            held = {i: sum(holds(w, t) for w in words) for i, t in enumerate(terms)}
            hits += [(-float(np.float32(float(np.float32(0.8) * np.float32(n)) / len(words))), i, k) for i, n in held.items() if n and i not in {h[1] for h in hits}]
        out |= {(qid, r, i, -s, d) for r, (s, i, d) in enumerate(sorted(hits)[:most], 1)}
    return out


def test_copies_are_compared_once(spark, monkeypatch):
    rng = random.Random(3)
    names = [f"{a} {b}" for a in ("red", "blue", "small", "hot") for b in ("ring", "bolt", "gear", "plate")] + ["x", "", "ring", "bolts of steel"]
    terms = [rng.choice(names) for _ in range(300)]
    asked = [(i, n[:1] + n[2:]) for i, n in enumerate(names)] + [(90, "gaer hott blux"), (91, "red  bolt"), (92, "zz yy"), (93, None)]
    index = fi.index_terms(spark.createDataFrame(list(enumerate(terms)), "term_index long, term string"))
    queries = spark.createDataFrame(asked, "qid long, q string")
    for most, limit in ((4, 500_000), (40, 500_000), (40, 5)):
        monkeypatch.setattr(se, "BROADCAST_TERMS", limit)
        monkeypatch.setattr(se, "BLOCK_TERMS", 7)
        monkeypatch.setattr(se, "GROUP_QUERIES", 9)
        hits = fi.fuzzy_search(queries, index, most)
        got = {(r["qid"], r["rank"], r["term_index"], r["score"], r["hamming_distance"]) for r in hits.collect()}
        assert got == naive_fuzzy([x for x in asked if x[1] is not None], terms, most)
        assert not re.search("NestedLoop|Cartesian", plan(hits))


def test_documents_compare_each_value_once(spark, monkeypatch):
    seen = []
    make = fi.FuzzyBlock
    monkeypatch.setattr(fi, "FuzzyBlock", lambda *columns: seen.append(len(columns[0])) or make(*columns))
    docs = fi.melt(spark.range(2000).selectExpr("id", "concat('name ', id % 5) AS name", "concat('kind', id % 3) AS kind"), "id", "name", "kind")
    hits = fi.Documents({"name": 2.0, "kind": 1.0}).search(spark.createDataFrame([(0, "nme 3")], "qid long, q string"), docs).orderBy("rank").collect()
    assert seen == [5, 3] and [h["doc_index"] for h in hits] == list(range(3, 53, 5))


def test_scores_of_many_are_the_scores_of_each():
    rng = random.Random(11)
    text = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(0, 9))).encode()
    for letters in ("ab", "aeqwsdz", "abcXY 19-é"):
        for board in ("qwerty", "azerty", "qwertz"):
            for longest in (0, 4, 12):
                q, ts, curve = text(letters), [text(letters) for _ in range(60)], position_curve(longest)
                distance = np.array([rng.randint(0, 2) for _ in ts])
                want = np.array([combined_score(q, t, int(d), curve, board) for t, d in zip(ts, distance)], dtype=np.float32)
                assert (combined_scores(q, ts, distance, curve, board) == want).all()


def test_index_search_makes_no_row_of_each_pair(spark):
    words = ["".join(x) for x in ((a + b + c) for a in ("th", "an", "er") for b in ("re", "on", "at") for c in ("s", "ly", "ing"))]
    index = fi.index_terms(spark.createDataFrame(list(enumerate(words)), "term_index long, term string"))
    asked = [(i, w[0] + w[2:]) for i, w in enumerate(words)]
    hits = fi.fuzzy_search(spark.createDataFrame(asked, "qid long, q string"), index)
    assert {(r["qid"], r["rank"], r["term_index"], r["score"], r["hamming_distance"]) for r in hits.collect()} == naive_fuzzy(asked, words, 10)
    assert "Generate" not in plan(hits) and "zip_with" not in plan(hits)


def test_lighter_terms_are_searched_within_what_is_left(monkeypatch):
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(2, 6))) for _ in range(900)})
    weights = [rng.randint(1, 40) for _ in words]
    whole, ranked, budgets = TermBlock(range(len(words)), words, weights), RankedTerms(range(len(words)), words, weights, 50, 2), []
    search = TermBlock.search
    for q in ["", "abcd", "dcbaa", "zzzz", *words[::60]]:
        for prefix, ranking, budget in ((False, "coarse", 32), (False, "exact", 32), (True, "coarse", 16), (False, "coarse", 48)):
            ids, cost, weight = whole.search(q, budget, CostModel(), prefix)
            at = top(ids, cost, weight, 10, ranking)
            monkeypatch.setattr(TermBlock, "search", lambda self, q, budget, *rest: budgets.append(budget) or search(self, q, budget, *rest))
            got = ranked.best(q, 10, budget, ranking, CostModel(), prefix)
            monkeypatch.setattr(TermBlock, "search", search)
            assert [x.tolist() for x in got] == [ids[at].tolist(), cost[at].tolist(), weight[at].tolist()]
    assert budgets.count(16) > 20 and budgets.count(0) > 5


def test_rule_search_is_the_search_of_all_pairs(spark):
    words = sorted({a + b + c for a in ("ph", "f", "th") for b in ("ie", "ei", "o") for c in ("ne", "nd", "ld")})
    terms = build(spark.createDataFrame([(i, w, i % 5) for i, w in enumerate(words)], "input_index long, term string, weight int")).cache()
    asked = spark.createDataFrame([(0, "fiend"), (1, "phonne"), (2, "thild"), (3, None)], "qid long, q string")
    rules = spark.createDataFrame([("f", "ph"), ("ie", "ei"), ("nn", "n")], "rule_from string, rule_to string")
    hits = ps.rule_search(asked, terms, rules, k=6, depth=4)
    far = se.ranked(se.within_budget(ps.variants(asked, rules).selectExpr("variant AS q").distinct(), terms, 32, prune=False), 4).selectExpr("q AS variant", "id", "cost + 16 AS cost", "weight")
    every = se.within_budget(asked.select("q"), terms, 32, prune=False).select("q", "id", "cost", "weight").union(ps.variants(asked, rules).join(far, "variant").select("q", "id", "cost", "weight").filter("cost <= 32"))
    want = se.ranked(every.groupBy("q", "id", "weight").agg(F.min("cost").alias("cost")), 6).join(asked, "q")
    assert {tuple(r) for r in hits.select("qid", "rank", "id", "cost").collect()} == {tuple(r) for r in want.select("qid", "rank", "id", "cost").collect()}
    assert "ArrowEvalPython" not in plan(hits)
