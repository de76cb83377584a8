"""Each operator against a brute-force version on small tables that hold nulls,
empty and blank texts, ties, repeated rows and extra columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from lexaprox.llm import ann, decontam, langid, lm, neardup, quality, urlrules
from lexaprox.llm._shared import components, lower_words
from lexaprox.llm.licences import KNOWN, known_digests, scan_licences
from lexaprox.llm.linededup import dedup_lines
from lexaprox.llm.mixing import mix_sources

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, cid string, node string"


def documents(spark, rows):
    """rows of (doc_id, text, lang, source), with extra columns of clashing names."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 0.5, "k", "c", "n") for i, t, lang, s in rows], DOCS)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeiorstnlmé") for _ in range(rng.randint(1, 7))) for _ in range(150)]
    sentence = lambda k=None: " ".join(rng.choice(vocabulary) for _ in range(k or rng.randint(1, 14)))
    passages = ["\n".join(sentence(9) for _ in range(4)) for _ in range(3)] + [sentence(40)]
    rows = []
    for i in range(n):
        lines = [sentence() for _ in range(rng.randint(1, 9))]
        if rng.random() < 0.4:
            lines.insert(rng.randint(0, len(lines)), rng.choice(passages))
        if rng.random() < 0.5:
            lines.append("Common line here.")
        rows.append((i, "\n".join(lines), rng.choice(["aa", "bb"]), rng.choice(["s1", "s2", "s3", None])))
    base = [rows[k][1] for k in (3, 7)]
    for k in range(30):
        words = base[k % 2].split(" ")
        words[rng.randrange(len(words))] = "swapped"
        rows.append((n + k, " ".join(words), "aa", "s1"))
    rows += [(200, rows[5][1], "bb", "s2"), (201, rows[5][1].upper(), None, None), (202, None, "aa", "s1"), (203, "", "bb", None), (204, " \n\t ", "aa", "s2"), (205, "two words", "aa", "s3"), (206, "two words", "aa", "s3"), (206, "two words", "aa", "s3"), (None, "a row without an id " * 9, "aa", "s9")]
    return rows


def shingles(text, width):
    w = lower_words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_components(rows, width, percent):
    sets, up = [shingles(t, width) for _, t, *_ in rows], list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[top(i)] = top(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [(d, len(sets[i]), least.get(top(i))) for i, (d, *_) in enumerate(rows)]


@pytest.mark.parametrize("limit", [512, 4])
def test_near_duplicates(spark, monkeypatch, limit):
    monkeypatch.setattr(neardup, "NODE_LIMIT", limit)
    monkeypatch.setattr(neardup, "BLOCK", limit)
    rows = corpus()
    for percent in (85,) if limit == 512 else (80,):
        out = neardup.near_duplicates(documents(spark, rows), percent=percent).collect()
        key = lambda r: tuple(-1 if x is None else x for x in r)
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=key) == sorted(brute_components(rows, 5, percent), key=key)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out if r["doc_id"] is not None)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_in_a_large_family(spark, monkeypatch, percent):
    """800 texts that share 150 of 175 words, each linked with one other; nodes of most of them branch to the deepest level."""
    monkeypatch.setattr(neardup, "NODE_LIMIT", 128)
    both = 6 if percent == 80 else 11
    rows, common = [], [f"c{j}" for j in range(150)]
    for i in range(800):
        pair = [f"p{i // 2}x{j}" for j in range(both)]
        rows.append((i, " ".join(common + pair + [f"o{i}x{j}" for j in range(25 - both)]), "aa", "s1"))
    out = neardup.near_duplicates(documents(spark, rows), width=1, percent=percent).collect()
    assert len(out) == 800 and all(r["component_id"] in (r["doc_id"], r["doc_id"] // 2 * 2) for r in out)
    assert sum(r["component_id"] != r["doc_id"] // 2 * 2 for r in out) <= 1


def test_branching():
    for percent in (20, 30, 50, 80, 85, 90, 100):
        root, deep = neardup.branching(percent, neardup.TREES)
        assert neardup.parted(percent, neardup.TREES, root, deep, 7 if deep else 1) <= 1e-4
    assert neardup.branching(80, neardup.TREES)[0] == neardup.branching(85, neardup.TREES)[0] == 118


def test_common():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 90, rng.integers(1, 60)).astype(np.uint64)) for _ in range(9)]
    for size in (1 << 23, 50):
        got = neardup.common(sets, size)
        assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(9) for j in range(i))


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(documents(spark, [])).collect() == []


@pytest.mark.parametrize("local", [0, 10_000])
def test_components(spark, monkeypatch, local):
    from lexaprox.llm import _shared

    monkeypatch.setattr(_shared, "LOCAL_EDGES", local)
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(12)] + [(5, 5)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    want = {(x, top(x)) for x in up if top(x) != x}
    assert {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def brute_lines(rows, least):
    seqs = sorted({(1 << 62 if d is None else d, t) for d, t, *_ in rows if t is not None})
    first, gone = {}, {}
    for d, t in seqs:
        lines = [(k, x.strip(" \t\r")) for k, x in enumerate(t.split("\n")) if x.strip(" \t\r")]
        size = [len(x.split()) for _, x in lines]
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if sum(size[i:j]) >= least:
                    name = tuple(x for _, x in lines[i:j])
                    if name in first:
                        gone.setdefault((d, t), set()).update(k for k, _ in lines[i:j])
                    else:
                        first[name] = d
    left = lambda d, t: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get((1 << 62 if d is None else d, t), ()))
    return [(d, left(d, t)) for d, t, *_ in rows]


@pytest.mark.parametrize("least", [12, 25])
def test_line_dedup(spark, least):
    rows = corpus(2) + [(300, "x y z\n" * 9, None, None), (301, "q\nx y z\nx y z\nx y z\nx y z\nx y z", None, None)]
    out = dedup_lines(documents(spark, rows), least)
    assert out.columns[:9] == [c.split()[0] for c in DOCS.split(", ")] and out.columns[-1] == "n_removed"
    got = out.select("doc_id", "text", "n_removed").collect()
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got))) == sorted(map(str, brute_lines(rows, least)))
    assert sum(r["n_removed"] for r in got) > 20
    assert dedup_lines(documents(spark, [])).collect() == []


def brute_hits(text, items):
    words, hit, found = decontam.item_words(text), set(), set()
    for i, t in items:
        w = decontam.item_words(t)
        n = min(10, len(w))
        spans = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
        for k in range(len(words) - n + 1) if n else ():
            if tuple(words[k : k + n]) in spans:
                hit.update(range(k, k + n))
                found.add(i)
    names = sorted(str(x) for x in found if x is not None)
    return len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("limit", [decontam.LOCAL_CHARS, 0])
def test_decontamination(spark, limit):
    rows = corpus(3)
    words = [w.decode() for w in decontam.item_words(rows[4][1])]
    items = [(1, " ".join(words[:15])), (2, " ".join(words[2:11]).upper()), (3, "--".join(words[:12])), (4, "two words"), (5, ""), (6, None), (6, "the end"), (11, b" ".join(decontam.item_words(rows[0][1])[:25]).decode()), (12, "word")]
    rows += [(400, "so " + " ".join(words[:14]) + " end", None, None), (401, "Two,WORDS two words", None, None), (402, "é\u00a0 word", None, None)]
    out = decontam.decontaminate(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"), limit).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(str((d, *brute_hits(t, items))) for d, t, *_ in rows)
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in decontam.decontaminate(documents(spark, rows), none, -1 if not limit else limit).collect())


def brute_mix(rows, weights=(1, 2, 3)):
    total = {}
    for _, t, _, s in rows:
        total[s] = total.get(s, 0) + len((t or "").split())
    order = sorted(total, key=lambda s: (s is None, s))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    left, free, target = float(sum(total.values())), set(order), {}
    while free:
        share = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * share >= 3 * total[s]}
        if not over:
            target |= {s: w[s] * share for s in free}
            break
        target |= {s: 3.0 * total[s] for s in over}
        left -= sum(3 * total[s] for s in over)
        free -= over
    return total, target


def test_mixing(spark):
    rows = corpus(4, 300)
    out = mix_sources(documents(spark, rows)).collect()
    total, target = brute_mix(rows)
    source = {(d, len((t or "").split())): s for d, t, _, s in rows}
    assert len(out) == len(rows)
    taken = {}
    for r in out:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == total[s] and abs(r["target"] - target[s]) < 1e-6 * target[s] + 1e-9 and r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[s] = taken.get(s, 0) + r["taken"]
    most = max(r["size"] for r in out)
    assert all(abs(taken[s] - target[s]) <= most for s in total)
    assert sorted(map(str, mix_sources(documents(spark, rows)).collect())) == sorted(map(str, out))
    assert mix_sources(documents(spark, [])).collect() == []


def test_mixing_of_one_blank_source(spark):
    assert [r["taken"] for r in mix_sources(documents(spark, [(1, None, None, None), (2, " ", None, None)])).collect()] == [0, 0]


def test_licences(spark):
    mit = next(t for n, t in KNOWN if n == "MIT")
    rows = [(1, mit, None, None), (2, "Copyright (c) 2001 A. Person\n\n" + mit.upper().replace(" ", "\n "), None, None), (3, mit + " more", None, None), (4, None, None, None), (5, "", None, None), (6, "Licenced under the Apache Licence, version 2.0", None, None), (7, "Copyright 2020 x", None, None), (8, "licence licence", None, None), (9, "license license", None, None)]
    rows += [(10, "Some prose.\n\nReleased under the MIT License.\r\nMore prose;\n  * licensed under the apache licence, VERSION 2.0!\n", None, None), (11, "one line\n" * 3, None, None), (11, mit, None, None), (11, mit, None, None), (12, "x " * 200_000 + "\nLicensed under CC BY 4.0", None, None)]
    out = scan_licences(documents(spark, rows), known_digests(spark)).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert [by[i]["licence"] for i in range(1, 11)] == ["MIT", "MIT", None, None, None, "Apache-2.0", None, None, None, None]
    assert by[4]["digest"] is None and by[5]["digest"] == by[7]["digest"] and by[8]["digest"] == by[9]["digest"]
    assert by[10]["notices"] == "Apache-2.0,MIT" and by[12]["notices"] == "CC-BY-4.0" and by[6]["notices"] == "Apache-2.0" and by[4]["notices"] is None
    assert sorted(str(r["licence"]) for r in out if r["doc_id"] == 11) == ["MIT", "MIT", "None"]
    assert scan_licences(documents(spark, []), known_digests(spark)).collect() == []


def brute_url(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, urlrules.DEFAULT))
    return host, path, best[1], best[2]


def test_url_rules(spark):
    rng = random.Random(6)
    hosts = ["com", "example.com", "EXAMPLE.com", "a.example.com", "www.example.com", "x.www.example.com", "badexample.com", "net", "a.net", "b.a.net", "org", "x-y.com", "x.com", "", ".com", "com.", "net ", "a.net b", "example.com c", "net b", "c.net b", "zz.net", "net!x", "net\x00", "net\x01q", "a.net\x01", "net\t.com", "é.net", "net\x00.com", "com..net"]
    urls = [f"{rng.choice(['http', 'x'])}://{h}{p}" for h in hosts for p in ("", "/", "/en/", "/en/x?y=/fr/", "/es/#a", "?q", "/fr", "#/en/", "/EN/")] + [None, "", "nothing", "a://b://c/", "mailto:x"]
    rules = [*urlrules.RULES, ("a.net", "/", "block"), ("net", "/", "allow"), ("x.com", "/en/", "block"), ("net b", "/", "block"), ("net\x01q", "/en/", "block"), ("net\x00", "/en/", "allow")]
    urls += urls[:3] + ["http://hot.net/es/x"] * 300 + ["http://hot.net b/es/x"] * 200
    pages = spark.createDataFrame([(i, u, "h", "p", "r") for i, u in enumerate(urls)] + [(None, urls[0], "", "", "")], "page_id long, url string, host string, path string, key string")
    for some in (urlrules.RULES, rules, []):
        out = urlrules.judge_urls(pages, spark.createDataFrame(some, "host string, path string, verdict string")).collect()
        want = [(i, *brute_url(u, some)) for i, u in [*enumerate(urls), (None, urls[0])]]
        assert sorted(map(str, map(tuple, out))) == sorted(map(str, want))
    assert urlrules.judge_urls(pages.limit(0), urlrules.rules_frame(spark)).collect() == []


def test_vectors(spark):
    rng = np.random.default_rng(7)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((900, 8)) * rng.uniform(0.5, 2, (900, 1)))]
    rows += [(1000 + i, rows[20][1]) for i in range(60)]
    odd = [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [None] * 8), (2080, [1.0]), (2100, [float("inf")] * 8), (None, rows[0][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumnRenamed("vec_id", "vec_id")
    out = ann.nearest_neighbours(df, df.filter("vec_id % 20 = 0"), 20).collect()
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = (x * x[q]).sum(1)
        score[q] = -np.inf
        want = ids[np.lexsort((ids, -score))[:20]].tolist()
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == ids[q])
        assert [g[0] for g in got] == list(range(1, 21)) and all(abs(s - score[ids.tolist().index(i)]) < 1e-12 for _, i, s in got)
        assert [(-s, i) for _, i, s in got] == sorted((-s, i) for _, i, s in got)
        hits += len(set(want) & {g[1] for g in got})
    assert {r["query_id"] for r in out} == set(ids[ids % 20 == 0].tolist()) and hits >= 0.9 * 20 * (ids % 20 == 0).sum()
    few = df.filter("vec_id < 5")
    assert len(ann.nearest_neighbours(few, few.filter("vec_id = 0")).collect()) == 4
    assert ann.nearest_neighbours(df.limit(0), df.limit(0)).collect() == []


def test_index_is_selective():
    """Of 12000 vectors in 375 lists, of which a query compares few and finds most of its nearest."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((60, 32))
    for name, x, most in (
        ("uniform", rng.standard_normal((12_000, 32)), 0.5),
        ("clusters", centres[rng.integers(0, 60, 12_000)] + 0.35 * rng.standard_normal((12_000, 32)), 0.1),
        ("norms", (centres[rng.integers(0, 60, 12_000)] + 0.35 * rng.standard_normal((12_000, 32))) * rng.uniform(0.5, 1.5, (12_000, 1)), 0.1),
    ):
        largest = np.sqrt((x**2).sum(1).max()) * (1 + 1e-9)
        full = np.concatenate([x, np.sqrt(np.maximum(largest**2 - (x**2).sum(1), 0))[:, None]], 1).astype(np.float32)
        graph = ann.Graph(ann.centroids(full, len(x) // ann.LIST_SIZE))
        member = np.zeros((len(x), len(graph.points)), bool)
        for lo in range(0, len(x), 1000):
            row, lists = ann.lists_of_vectors(graph, x[lo : lo + 1000], largest)
            member[lo + row, lists] = True
        assert len(graph.points) >= 300 and member.any(1).all() and member.sum(1).max() <= ann.REPLICAS
        q = x[:200]
        ratio = ann.fitted_ratio(graph, x[300:556], full[:, :-1], largest, 20)
        row, lists = ann.lists_of_queries(graph, q, largest, ratio, member.sum(0), 168)
        reads = np.zeros((len(q), len(graph.points)), bool)
        reads[row, lists] = True
        seen = (reads.astype(np.float32) @ member.T.astype(np.float32)) > 0
        score = q @ x.T
        score[np.arange(len(q)), np.arange(len(q))] = -np.inf
        want = np.argsort(-score, axis=1)[:, :20]
        assert np.take_along_axis(seen, want, 1).mean() >= 0.9, name
        assert seen.mean() < most and seen.sum(1).min() >= 21, (name, seen.mean())


@pytest.mark.parametrize("single", [False, True])
def test_vectors_in_many_lists(spark, single):
    """The whole operator over 60 lists in 32 packs, with repeated ids, against brute force over all."""
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((12, 16))
    x = (centres[rng.integers(0, 12, 2000)] + 0.3 * rng.standard_normal((2000, 16))).astype(np.float32).astype(float)
    kind = "float" if single else "double"
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows + rows[:50] + [(7, [9.0] * 16)], f"vec_id long, embedding array<{kind}>").repartition(3)
    out = ann.nearest_neighbours(df, df.filter("vec_id % 20 = 0"), 20).collect()
    again = ann.nearest_neighbours(df, df.filter("vec_id % 20 = 0"), 20).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again)) and len(out) == 2000
    if min(rows[7][1]) < 0:
        # Of the two rows of one id one counts.
        assert len({r["score"] for r in out if r["vec_id"] == 7 and r["query_id"] == 0}) <= 1
    hits = 0
    for q in range(0, 2000, 20):
        score = (x * x[q]).sum(1)
        score[q] = -np.inf
        got = [r for r in out if r["query_id"] == q]
        assert sorted(r["rank"] for r in got) == list(range(1, 21)) and len({r["vec_id"] for r in got}) == 20
        hits += len(set(np.argsort(-score)[:20].tolist()) & {r["vec_id"] for r in got})
    assert hits >= 0.9 * 2000

def labelled(n=240):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(["the", "house", "stands", "near", "a", "river"]) for _ in range(40)).capitalize() + "."
    bad = lambda: " ".join(rng.choice(["BUY!!", "$$$", "###", "win%%"]) for _ in range(40))
    return [(i, good() if i % 4 else bad(), int(bool(i % 4))) for i in range(n)]


def test_quality(spark):
    rows = labelled()
    docs = documents(spark, [(i, t, "x", "y") for i, t, _ in rows] + [(900, None, None, None), (901, "", None, None), (None, "no id", None, None)])
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 1), (5000, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    out = quality.quality_scores(docs, labels).collect()
    by, truth = {r["doc_id"]: r for r in out}, {i: q for i, _, q in rows}
    assert len(out) == len(rows) + 3 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in truth) and by[900]["score"] == by[901]["score"]
    assert np.mean([by[i]["predicted"] == q for i, q in truth.items() if by[i]["held_out"]]) > 0.95
    assert {r["score"] for r in quality.quality_scores(docs, labels.filter("quality = 1")).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels).collect() == []


def test_quality_sees_words(spark):
    """Texts of one shape, told apart by their words alone; nulls, blanks and a very long text besides."""
    rng = random.Random(18)
    words = {1: ["river", "stone", "cloud", "field"], 0: ["rivet", "stove", "clout", "fiend"]}
    rows = [(i, " ".join(rng.choice(words[i % 2]) for _ in range(30)), i % 2) for i in range(300)]
    docs = documents(spark, [(i, t, None, None) for i, t, _ in rows] + [(900, "river " * 200_000, None, None), (901, None, None, None), (902, " ", None, None)])
    out = {r["doc_id"]: r for r in quality.quality_scores(docs, spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")).collect()}
    assert np.mean([out[i]["predicted"] == q for i, _, q in rows if out[i]["held_out"]]) > 0.95 and out[900]["predicted"] == 1
    # The score is the logistic of the features' weights around the threshold.
    model = quality.train(docs.filter("pmod(crc32(cast(cast(doc_id AS string) AS binary)), 3) <> 1"), spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int"))
    for i, t, _ in rows[:20]:
        z = np.clip((quality.features(t) - model["mean"]) / model["scale"], -6, 6)
        assert abs(out[i]["score"] - 1 / (1 + np.exp(-(float(z @ model["w"]) - model["threshold"])))) < 1e-6


def test_quality_learns_from_all_labels(spark):
    """Words that only labelled rows beyond the first thousands of hashes hold tell held-out texts apart,
    and the weights are those of all pairs, labels counted as often as they come."""
    ids = spark.range(14_000).selectExpr("id", "xxhash64(id) h", "pmod(crc32(cast(cast(id AS string) AS binary)), 3) = 1 held").orderBy("h").collect()
    rows, seen = [], {0: 0, 1: 0}
    for r in ids:
        q = r["id"] % 2
        late = r["held"] or seen[q] >= 4000
        seen[q] += not r["held"]
        rows.append((r["id"], " ".join(["cloud", ("river", "rivet")[q] if late else ("stone", "stove")[q]] * 3), q))
    assert min(seen.values()) > 4200
    docs, labels = documents(spark, [(i, t, None, None) for i, t, _ in rows]), spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    assert np.mean([out[i]["predicted"] == q for i, _, q in rows if out[i]["held_out"]]) > 0.95
    few = labelled(60) + [(100 + i, t + " BUY!!", 0) for i, t, _ in labelled(9)]
    more = [(i, q) for i, _, q in few] + [(1, 1), (2, 0)]
    model = quality.train(documents(spark, [(i, t, None, None) for i, t, _ in few]), spark.createDataFrame(more, "doc_id long, quality int"))
    texts = {i: t for i, t, _ in few}
    x, y = np.array([quality.features(texts[i]) for i, _ in more]), np.array([q for _, q in more])
    z = np.clip((x - model["mean"]) / model["scale"], -6, 6)
    assert np.allclose(model["mean"], x.mean(0), atol=1e-5)
    s = z @ model["w"]
    pull = 1 / (1 + np.exp(s[y == 1][:, None] - s[y == 0]))
    gradient = quality.RIDGE * model["w"] - (pull.sum(1) @ z[y == 1] - pull.sum(0) @ z[y == 0]) / pull.size
    assert np.abs(gradient).max() < 1e-3 < np.abs(z[y == 1].mean(0) - z[y == 0].mean(0)).max()
    assert abs((s < model["threshold"]).sum() - (y == 0).sum()) <= 1


def test_languages(spark):
    rng = random.Random(9)
    words = {"aa": ["the", "and", "house", "with"], "bb": ["über", "straße", "und", "nicht"], "cc": ["été", "où", "leçon", "que"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(20)), k, "s") for i, k in enumerate(list(words) * 60)]
    extra = [(900, None, "aa", "s"), (901, "123 !?", "aa", "s"), (902, "", "bb", "s"), (903, "und nicht über", None, "s")]
    out = {r["doc_id"]: r for r in langid.identify(documents(spark, rows + extra)).collect()}
    assert all(out[i]["lang_pred"] == k for i, _, k, _ in rows) and all(0 <= r["score"] <= 1 for r in out.values())
    assert [out[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "bb"]
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in out)
    assert langid.identify(documents(spark, [])).collect() == []
    assert langid.identify(documents(spark, [(1, "abc", None, None)])).first()["lang_pred"] == "und"


def test_languages_are_sparse_calibrated_and_none_is_left_out(spark):
    rng = random.Random(12)
    letters = {k: rng.sample("abcdefghijklmnopqrstuvwxyz", 14) for k in "pqrs"}
    word = lambda k: "".join(rng.choice(letters[k]) for _ in range(rng.randint(2, 5)))
    rows = [(i, " ".join(word(k) for _ in range(rng.choice([1, 2, 3, 30]))), k, "s") for i, k in enumerate(rng.choices("pqr", [60, 30, 10], k=900))]
    rows += [(2000 + i, " ".join(word("s") for _ in range(30)), "s", "s") for i in range(12)]
    docs = documents(spark, rows + rows[:20])
    kept = docs.filter("pmod(crc32(cast(cast(doc_id AS string) AS binary)), 5) <> 0")
    model = langid.train(kept, sample=200)
    # The rare language has its rows in the sample.
    assert model["languages"] == ["p", "q", "r", "s"] and (model["w"] == 0).mean() > 0.5
    assert langid.HEATS[0] < model["heat"] < langid.HEATS[-1]
    out = langid.identify(docs).collect()
    truth = {i: k for i, _, k, _ in rows}
    held = [r for r in out if r["held_out"]]
    right = np.array([r["lang_pred"] == truth[r["doc_id"]] for r in held])
    score = np.array([r["score"] for r in held])
    assert len(out) == len(rows) + 20 and right.mean() > 0.8 and abs(right.mean() - score.mean()) < 0.1
    assert sum(r["lang_pred"] == "s" for r in out if r["doc_id"] >= 2000) >= 8


def test_language_model_gradient_and_windows():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in lm.initial(30).items()}
    x, y = rng.integers(0, 30, (3, lm.WINDOW)), rng.integers(0, lm.CLASSES, (3, lm.WINDOW))
    real = rng.random((3, lm.WINDOW)) < 0.8
    _, g = lm.step(p, x, y, real)
    for k in p:
        at = tuple(rng.integers(0, n) for n in p[k].shape) if k != "E" else (x[0, 0], 3)
        e, old = 1e-5, p[k][at]
        p[k][at] = old + e
        up = lm.step(p, x, y, real)[0]
        p[k][at] = old - e
        down = lm.step(p, x, y, real)[0]
        p[k][at] = old
        assert abs((up - down) / (2 * e) - g[k][at]) < 1e-4, k
    p = lm.initial(30)
    for skip in (8, 0):
        assert np.allclose(lm.Scorer(p).states(x, skip).reshape(3, -1, lm.WIDTH), lm.forward(p, x)["U"][:, skip:], atol=1e-4)
    large = {k: v * (20 if k in ("Wq", "Wk") else 1) for k, v in p.items()}
    assert np.allclose(lm.Scorer(large).states(x, 8).reshape(3, -1, lm.WIDTH), lm.forward(large, x)["U"][:, 8:], atol=1e-3)
    # A later id changes nothing before it.
    z = x.copy()
    z[:, 20:] = 0
    assert np.allclose(lm.forward(p, x)["U"][:, :20], lm.forward(p, z)["U"][:, :20], atol=1e-5)
    for n in (1, 5, lm.WINDOW, lm.WINDOW + 1, 200):
        first, scored, stop = lm.windows(np.array([n, 3]))
        places = [k for f, s, e in zip(first, scored, stop) for k in range(s, min(e, f + lm.WINDOW))]
        assert sorted(places) == list(range(n + 3))


def test_language_model_scores(spark):
    rows = corpus(10, 80)
    out = lm.score_texts(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    counts, ends = {}, 0
    for d, t, *_ in rows:
        if d is None or zlib.crc32(str(d).encode()) % 7 != 2:
            ends += 1
            for w in lower_words(t):
                counts[w] = counts.get(w, 0) + 1
    total, distinct, want = sum(counts.values()) + ends, len(counts) + 1, []
    for d, t, *_ in rows:
        c = [counts.get(w, 0) for w in lower_words(t)] + [ends]
        want.append((d, len(c), sum(x > 0 for x in c), total, round(float(sum(np.log10((x + 1) / (total + distinct + 1)) for x in c)), 4)))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4))) for r in out)
    assert all(r["score"] < 0 and np.isfinite(r["score"]) for r in out)
    assert lm.score_texts(documents(spark, [])).collect() == []


def naive_scores(model, texts, train):
    """Score of each text from the definition: one window after the other, one place after the other."""
    p, out, counts, own = {k: v.astype(float) for k, v in model.p.items()}, [], {}, []
    for k, t in enumerate(texts):
        ids = [i for w in lower_words(t) for i in lm.encoder(model.ranks)[0].encode_ordinary(" " + w.decode())] + [model.end]
        before, logs = [model.end, *ids[:-1]], []
        for i in range(len(ids)):
            # The window that scores place i.
            j = 0 if i < lm.WINDOW else 1 + (i - lm.WINDOW) // lm.STRIDE
            x = p["E"][model.row[before[j * lm.STRIDE : i + 1]]]
            x = x + p["P"][: len(x)]
            q, ks, v = x[-1] @ p["Wq"], x @ p["Wk"], x @ p["Wv"]
            a = np.exp(ks @ q / lm.WIDTH**0.5)
            z = x[-1] + (a / a.sum()) @ v @ p["Wo"]
            u = z + np.maximum(z @ p["W1"] + p["b1"], 0) @ p["W2"]
            s = u @ p["Wc"] + p["bc"]
            logs.append((s[model.kind[ids[i]]] - np.log(np.exp(s).sum())) / np.log(10) + model.share[model.kind[before[i]], ids[i]])
        y, parts, start = np.array(ids), [], 0
        with np.errstate(over="ignore"):
            for e in lm.Segments(y, np.array([len(y) - 1]), model.segment).end:
                parts.append((tuple(ids[start : e + 1]), sum(logs[start : e + 1])))
                start = e + 1
        assert start == len(ids)
        for name, _ in parts if train[k] else ():
            counts[name] = counts.get(name, 0) + 1
        own.append(parts)
    total = sum(counts.values())
    for parts in own:
        out.append(sum(np.log10((1 - lm.MIXED) * 10**a + lm.MIXED * max(0, counts.get(n, 0) - 1) / max(1, total)) if a > -250 or counts.get(n, 0) > 1 else np.log10(1 - lm.MIXED) + a for n, a in parts))
    return out


@pytest.mark.parametrize("frequent", [0, 8192])
def test_language_model_against_its_definition(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm, "SEGMENT", 8)
    monkeypatch.setattr(lm, "FREQUENT", frequent or 1)
    monkeypatch.setattr(lm, "BATCH_CHARS", 3000)
    monkeypatch.setattr(lm, "PLACES", 500)
    monkeypatch.setattr(lm, "EVERY", 2)
    rows = corpus(12, 60) + [(700, "a b " * 300, "aa", "s"), (701, "a b " * 300, "aa", "s")]
    kept = {}
    whole = lm.train

    def trained(docs, vocabulary):
        # Tasks get the values of this process.
        kept["model"] = whole(docs, vocabulary)
        return kept["model"]

    monkeypatch.setattr(lm, "train", trained)
    out = lm.score_texts(documents(spark, rows)).collect()
    model = kept["model"]
    train = [d is None or zlib.crc32(str(d).encode()) % 7 != 2 for d, *_ in rows]
    assert model.documents == sum(train)
    want = naive_scores(model, [t for _, t, *_ in rows], train)
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in out)
    for (a, n, x), (b, m, y) in zip(got, sorted((str(d), len(lower_words(t)) + 1, w) for (d, t, *_), w in zip(rows, want))):
        assert a == b and n == m and abs(x - y) < 1e-3 * max(1, abs(y)), (a, x, y)


def test_language_model_learns(spark):
    """Held-out texts get more than from counts of words; a text that the corpus repeats gets more than one it holds once."""
    rng = random.Random(4)
    words = [f"w{chr(97 + i)}{chr(97 + i * 7 % 26)}" for i in range(26)]

    def text(n):
        at, out = rng.randrange(26), []
        for _ in range(n):
            at = (at * 3 + rng.choice([1, 1, 1, 2])) % 26
            out.append(words[at])
        return " ".join(out)

    rows = [(i, text(120), "aa", "s") for i in range(400)]
    rows += [(1000 + i, rows[2 * i][1], "aa", "s") for i in range(40)]
    out = {r["doc_id"]: r for r in lm.score_texts(documents(spark, rows)).collect()}
    per = lambda c, ids: np.array([out[i][c] / out[i]["n_tokens"] for i in ids])
    held = [i for i in range(80, 400) if out[i]["held_out"]]
    assert len(held) > 20 and per("score", held).mean() > per("base_score", held).mean() + 0.3
    once = [i for i in range(80, 400) if not out[i]["held_out"]]
    twice = [2 * i for i in range(40) if not out[2 * i]["held_out"] and not out[1000 + i]["held_out"]]
    assert len(twice) > 20 and per("score", twice).min() > per("score", once).max()


def test_language_model_classes_come_from_all_documents(spark, monkeypatch):
    monkeypatch.setattr(lm, "SAMPLE", 2)
    monkeypatch.setattr(lm, "BATCH_CHARS", 3000)
    rows = corpus(12, 60) + [(700, None, "aa", "s"), (701, " ", "aa", "s")]
    model = lm.train(documents(spark, rows), lm.default_vocabulary())
    counts, pairs = np.zeros(model.end + 1), {}
    for _, t, *_ in rows:
        ids = [model.end] + [i for w in lower_words(t) for i in lm.encoder(model.ranks)[0].encode_ordinary(" " + w.decode())] + [model.end]
        for a, b in zip(ids, ids[1:]):
            counts[b] += 1
            pairs[a, b] = pairs.get((a, b), 0) + 1
    # Whatever the two sampled documents lack has its own embedding all the same.
    assert (model.row[counts > 0] > 0).all() and (model.row[counts == 0] == 0).all()
    own = lm.own_ids(counts)
    assert lm.CLASSES < len(own) < lm.CLUSTERED and list(own) == sorted(own, key=lambda i: (-counts[i], i))
    number, around = {i: k for k, i in enumerate(own)}, np.zeros((len(own), 2 * lm.NEIGHBOURS + 2))
    column = lambda i: min(number.get(i, lm.NEIGHBOURS), lm.NEIGHBOURS)
    for (a, b), n in pairs.items():
        if b in number:
            around[number[b], column(a)] += n
        if a in number:
            around[number[a], lm.NEIGHBOURS + 1 + column(b)] += n
    row, kind = lm.word_classes(counts, around)
    assert (row == model.row).all() and (kind == model.kind).all() and len(set(kind[own])) > 30


def test_segments():
    """Equal runs of ids have equal keys wherever they stand, and others have others."""
    rng = np.random.default_rng(3)
    same = rng.integers(0, 500, 900)
    parts = [np.concatenate([rng.integers(0, 500, k), same, rng.integers(0, 500, 5), [500]]) for k in (0, 1, 40, 333)]
    with np.errstate(over="ignore"):
        g = lm.Segments(np.concatenate(parts), np.cumsum([len(x) for x in parts]) - 1)
    y, seen = np.concatenate(parts), {}
    for a, e, k in zip(g.begin, g.end, g.ids):
        assert seen.setdefault(tuple(y[a : e + 1]), k) == k
    assert len(seen) == len(g.keys) and max(np.bincount(g.ids)) >= 4
    with np.errstate(over="ignore"):
        assert len(lm.Segments(np.array([7]), np.array([0])).keys) == 1


def test_summing_frees_no_group(spark):
    """Keys whose rows go over many batches of Arrow, and blocks of few places."""
    import pyarrow as pa

    class Sent:
        value = type("M", (), {"segments": 10, "most": 50})

    rows = [(b, b"w%d" % k, 1, np.array([b % 7], np.uint16).tobytes(), None) for k in range(40) for b in range(5)]
    whole = lm._rows(0, [b"x"], np.zeros(1, np.int64), [b"\0\0"], None).schema
    batches = [pa.RecordBatch.from_pylist([dict(zip(whole.names, r)) for r in rows[lo : lo + 3]], schema=whole) for lo in range(0, len(rows), 3)]
    got = [r for b in lm._met(iter(batches), Sent) for r in b.to_pylist()]
    assert sum(r["words"] for r in got) == 40 and sum(r["tokens"] for r in got) == 200
    assert sum(np.frombuffer(r["logs"]).sum() for r in got if r["logs"]) == pytest.approx(200 * np.log10(6))


def test_subword_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    kind = rng.integers(0, lm.CLASSES, 500)
    share = lm.shares(rng.integers(0, 5, (lm.CLASSES, 500)).astype(np.float32), kind)
    for c in range(0, lm.CLASSES, 17):
        assert np.allclose(np.bincount(kind, weights=10.0 ** share[c], minlength=lm.CLASSES)[np.unique(kind)], 1, atol=1e-4)
