import math
import random

import numpy as np
from pyspark.sql import functions as F

from lexaprox.functions import phonetic
from lexaprox.functions.typo_scores import code_distance, codes, combined_score, confusion, position_curve, typo_score
from lexaprox.operators import evaluate as ev
from lexaprox.operators import fuzzy_index as fi
from lexaprox.operators import phonetic_search as ps
from lexaprox.operators.dictionary import build
from lexaprox.sources import text as src


def items(spark, *terms):
    return build(spark.createDataFrame([(i, t, 10 * i) for i, t in enumerate(terms)], "input_index long, term string, weight int"))


def test_sound_keys():
    for word, key in {"knight": "NT", "night": "NT", "phone": "FN", "write": "RT", "wheel": "WL", "thumb": "0M", "nation": "NXN", "edge": "EJ".replace("E", "A"), "school": "SXL", "box": "BKS", "sign": "SN", "aerial": "ERL".replace("E", "A"), "physics": "FSKS", "which": "WX"}.items():
        assert phonetic.sound_key(word) == key, word


def test_rules_and_mining(spark):
    rules = phonetic.spelling_rules()
    assert len(set(phonetic.RULES)) == len(phonetic.RULES) == 62 and len(rules) == 122
    df = spark.createDataFrame([("recieve",), ("fone",)], "q string")
    got = {tuple(r) for r in ps.variants(df, spark.createDataFrame([("ie", "ei"), ("f", "ph"), ("e", "")], "rule_from string, rule_to string")).collect()}
    assert got == {("recieve", "receive"), ("recieve", "rcieve"), ("recieve", "recive"), ("recieve", "reciev"), ("fone", "phone"), ("fone", "fon")}


def mined(t, r):
    p = 0
    while p < min(len(t), len(r)) and t[p] == r[p]:
        p += 1
    s = 0
    while s < min(len(t), len(r)) - p and t[len(t) - 1 - s] == r[len(r) - 1 - s]:
        s += 1
    a, b = len(t) - p - s, len(r) - p - s
    if not 1 <= a <= 3 or b > 3:
        return []
    out = [(t[p - x : len(t) - s + y], r[p - x : len(r) - s + y]) for x, y in ((0, 0), (1, 0), (0, 1), (1, 1)) if p >= x and s >= y]
    return [o for o in out if o[0] != o[1] and len(o[0]) <= 5]


def test_mining_is_brute_force(spark):
    rng = random.Random(2)
    rows = [("".join(rng.choice("abc") for _ in range(rng.randint(1, 6))), "".join(rng.choice("abc") for _ in range(rng.randint(1, 6)))) for _ in range(200)]
    want = {}
    for t, r in rows:
        for rule in mined(t, r):
            want[rule] = want.get(rule, 0) + 1
    got = {(r["rule_from"], r["rule_to"]): r["n"] for r in ps.mine_rules(spark.createDataFrame(rows, "typo string, right string"), 10_000, 1).collect()}
    assert got == want


def test_injection(spark):
    hits = spark.createDataFrame([(0, r, i, 16) for r, i in ((1, 10), (2, 11), (3, 12))], "qid long, rank int, id long, cost int")
    sound = spark.createDataFrame([(0, 1, 12), (0, 2, 99), (0, 3, 98)], "qid long, rank int, id long")
    order = lambda **kw: [r["id"] for r in ps.inject(hits, sound, 2, 4, **kw).orderBy("rank").collect()]
    assert order() == [10, 11, 12, 99] and order(gate=16) == [10, 11, 12]


def test_evaluation(spark):
    pairs = spark.createDataFrame([(0, "helo", "hello"), (1, "wrold", "world"), (2, "abd", "abc")], "qid long, typo string, right string")
    a = spark.createDataFrame([(0, 1, 5, "hello", 8), (1, 1, 6, "word", 8), (1, 2, 7, "world", 8)], "qid long, rank int, id long, norm string, cost int")
    ranks = ev.reciprocal_ranks(pairs, a)
    s = ev.summary(ranks).first()
    assert (s["n"], s["mrr"], s["r_at_1"]) == (3, 0.5, 1 / 3) and s["r_at_10"] == 2 / 3
    b = ev.reciprocal_ranks(pairs, a.filter("qid = 0"))
    d = ev.paired_difference(ranks, b).first()
    assert math.isclose(d["mean"], 0.5 / 3) and d["differ"] == 1 and math.isclose(d["se"], np.std([0, 0.5, 0], ddof=1) / 3**0.5)
    assert ev.ties(a, pairs).first()["ties"] == 1 / 3
    o = {r["qid"]: (r["overlap"], r["identical"]) for r in ev.overlap(a, a.filter("rank = 1"), pairs).collect()}
    assert o == {0: (1.0, True), 1: (0.5, False), 2: (1.0, True)}
    v = spark.createDataFrame([(x,) for x in (5, 1, 3, 2, 4)], "v int")
    assert [ev.percentile_pick(v, "v", p).first()["value"] for p in (0, 0.5, 0.95, 1)] == [1, 3, 5, 5]
    m = ev.macro_average(spark.createDataFrame([(0.1, 0.03, 0.2), (0.3, 0.04, -0.1)], "mean double, se double, high double")).first()
    assert math.isclose(m["macro"], 0.2) and math.isclose(m["se"], 0.025) and m["veto"]


def test_categories(spark):
    rows = [("recieve", "receive"), ("helo", "hello"), ("helllo", "hello"), ("hell", "hello"), ("hexllo", "hello"), ("hrllo", "hello"), ("hzllo", "hello"), ("abcd", "hello"), ("jello", "hello")]
    got = {r["typo"]: (r["category"], r["first_differs"]) for r in ev.classify(spark.createDataFrame(rows, "typo string, right string")).collect()}
    assert [got[t][0] for t, _ in rows] == ["transposition", "missing doubled letter", "extra doubled letter", "missing letter", "extra letter", "neighbouring-key substitution", "other substitution", "two or more edits", "neighbouring-key substitution"]
    assert got["jello"][1] and not got["helo"][1]


def test_usable_and_split(spark):
    terms = items(spark, "hello", "world")
    rows = [("helo", "hello"), ("world", "hello"), ("x", "y"), ("hello", "hello")]
    assert [r["typo"] for r in ev.usable_pairs(spark.createDataFrame(rows, "typo string, right string"), terms).collect()] == ["helo"]
    pairs = spark.createDataFrame([(f"t{i % 40}", f"r{i}") for i in range(100)], "typo string, right string")
    a, b = (set(map(tuple, x.collect())) for x in ev.sample_and_holdout(pairs, 20))
    assert len(a) == len(b) == 20 and not {x for x, _ in a} & {x for x, _ in b}
    assert {r[0] for r in pairs.select(ev.hash_bucket("right").between(0, 99)).collect()} == {True}


def test_older_scores():
    curve = position_curve(20)
    assert typo_score(b"hello", b"hello", curve) == 1 and typo_score(b"", b"a", curve) == 0
    assert typo_score(b"teh", b"the", curve) > typo_score(b"txe", b"the", curve)
    table = codes("qwerty")
    assert table[ord("a")] == 1 and table[ord("s")] == 8 and table[ord("A")] == 1 and table[ord("9")] - table[ord("0")] == 9 and table[ord("-")] == 0
    assert codes("azerty")[ord("a")] == 24 and confusion("qwerty")[0, 18] == np.float32(0.8) and confusion("qwerty")[8, 10] == np.float32(0.3)
    assert code_distance(b"ab", b"abc") == 8 and combined_score(b"abc", b"abc", 0, curve) == 1


def candidates(q, t, k):
    h = sum(a != b for a, b in zip(q, t)) + abs(len(q) - len(t))
    if h <= k:
        return h
    cut = lambda a, b: any(a[:i] + a[i + 1 :] == b for i in range(len(a)))
    if len(t) == len(q) + 1 and cut(t, q) or len(q) == len(t) + 1 and cut(q, t):
        return 1
    fp = sum(abs(q.count(c) - t.count(c)) for c in set(q + t))
    if k >= 2 and abs(len(q) - len(t)) <= 2 and fp <= 2:
        from test_distance import brute

        from lexaprox.functions.distance import UNIT_COSTS

        d = brute(q, t, UNIT_COSTS)
        return d if d <= k else None


def test_older_candidates(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))) for _ in range(120)})
    index = fi.index_terms(spark.createDataFrame(list(enumerate(words)), "term_index long, term string"))
    asked = spark.createDataFrame([(i, w) for i, w in enumerate(words[::9])], "qid long, q string")
    for k in (1, 2):
        got = {(r["q"], r["term_index"]): r["distance"] for r in fi.fuzzy_candidates(asked, index, k).collect()}
        want = {(q, i): d for q in words[::9] for i, t in enumerate(words) if (d := candidates(q, t, k)) is not None}
        assert got == want


def test_older_search_and_documents(spark):
    index = fi.index_terms(spark.createDataFrame([(0, "JavaScript"), (1, "java"), (2, "apple pie chart")], "term_index long, term string"))
    asked = spark.createDataFrame([(0, "javasript"), (1, "aple pie")], "qid long, q string")
    hits = {r["qid"]: r["term"] for r in fi.fuzzy_search(asked, index).filter("rank = 1").collect()}
    assert hits == {0: "JavaScript", 1: "apple pie chart"}
    docs = fi.melt(spark.createDataFrame([(0, "alpha", "tool"), (1, "alpine", "toys"), (2, None, "tool")], "d long, name string, kind string"), "d", "name", "kind")
    got = [(r["doc_index"], round(r["score"], 4)) for r in fi.Documents({"name": 2.0, "kind": 1.0}).search(spark.createDataFrame([(0, "tool")], "qid long, q string"), docs).orderBy("rank").collect()]
    assert got[0] == (0, 0.3333) and got[1] == (2, 0.3333)
    r = spark.createDataFrame([("abxd", "abcde")], "q string, t string").select(fi.match_ranges("q", "t")).first()[0]
    assert [(x["start"], x["end"]) for x in r] == [(0, 2), (3, 4)]


def test_loaders(spark, tmp_path):
    (tmp_path / "d.tsv").write_bytes("Café\t5\r\n plain \nbad\tx\n\t3\nbig\t65536\nlast\t 7 \n".encode())
    got = [tuple(r) for r in src.read_terms(spark, str(tmp_path / "d.tsv")).orderBy("input_index").collect()]
    assert got == [(0, "Café", 5), (1, "plain", 0), (5, "last", 7)]
    (tmp_path / "s.tsv").write_text("a\t1\nb\t2\n")
    assert [tuple(r) for r in src.read_terms_strict(spark, str(tmp_path / "s.tsv")).orderBy("input_index").collect()] == [(0, "a", 1), (1, "b", 2)]
    (tmp_path / "x.tsv").write_text("a\t1\nb\n")
    try:
        src.read_terms_strict(spark, str(tmp_path / "x.tsv")).collect()
        raise SystemExit("no error")
    except Exception as e:
        assert "malformed line 2" in str(e)
    (tmp_path / "p.tsv").write_text("teh\tthe\n")
    assert src.read_pairs(spark, str(tmp_path / "p.tsv")).first()["right"] == "the"
    (tmp_path / "b.dat").write_text("$hello\nhelo\nhelllo\nhe\n$other\nothr\n$world\nwrld\nhello\n")
    terms = items(spark, "hello", "world")
    assert {tuple(r) for r in src.parse_blocks(src.numbered_lines(spark, str(tmp_path / "b.dat")), terms).collect()} == {("helo", "hello"), ("helllo", "hello"), ("wrld", "world")}


def test_builders_and_sinks(spark, tmp_path):
    counts = src.word_counts(spark.createDataFrame([("A b, B",), (None,)], "text string"))
    assert {tuple(r) for r in counts.collect()} == {("a", 1), ("b", 2)}
    weights = src.log_weights(counts)
    assert {r["term"]: r["weight"] for r in weights.collect()} == {"a": round(65535 * math.log(2) / math.log(3)), "b": 65535}
    assert [r["term"] for r in src.sized_dictionary(weights, spark.createDataFrame([("a",)], "term string"), 1).collect()] == ["a"]
    hits = spark.createDataFrame([(0, 2, "b", 16, 1), (0, 1, "a", 8, 2)], "qid long, rank int, term string, cost int, weight int")
    assert src.result_lines(hits).first()["lines"] == ["2\t0", "a\t8\t2", "b\t16\t1"]
    src.write_result_lines(hits, str(tmp_path / "out"))
    rows = [("u1", "qwerty", "full", "en", "The cat sat", "teh cat sat"), ("u2", "qwerty", "laptop", "en", "the cat", "teh cat."), ("u3", "azerty", "full", "en", "the", "teh")]
    got = src.keystroke_slips(spark.createDataFrame(rows, "user string, layout string, keyboard string, language string, expected string, typed string")).collect()
    assert [tuple(r) for r in got] == [("teh", "the", 2, 2)]


def test_typos(spark):
    got = {(r["kind"], r["typo"]) for r in ev.make_typos(items(spark, "hello")).collect()}
    assert got == {("drop", "helo"), ("double", "heello"), ("neighbour", "hrllo"), ("first", "uello"), ("insert", "heello")}
