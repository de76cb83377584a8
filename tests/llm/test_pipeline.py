"""The stages on a small folder of tables, each against what it should leave."""

import random

import pytest
from test_corpus_operators import brute_components, brute_hits, brute_lines, labelled

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d, rng = str(tmp_path_factory.mktemp("sf")), random.Random(1)
    rows = [(i, t, "aa", f"s{i % 3}", len(t)) for i, t, _ in labelled(200)]
    clean = lambda: " ".join("".join(rng.choice("aeiortnsl") for _ in range(rng.randint(2, 7))) for _ in range(60)).capitalize() + "."
    passage = clean()
    item = " ".join(clean().split()[:20])
    rows += [(300 + i, clean() + "\n" + passage, "aa", "s1", 1) for i in range(4)] + [(310, "x " + clean() + " " + item, "aa", None, 1)]
    words = (clean() + " " + clean() + " " + clean()).split()
    rows += [(320 + k, " ".join([*words[: 40 + k], "other", *words[41 + k :]]), "aa", "s2", 1) for k in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, _, q in labelled(200)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
        out = corpus_pipeline.materialize(stage(spark, docs, folder), name)
        after = {r["doc_id"]: r for r in out.collect()}
        assert k == 4 or out.columns == corpus_pipeline.COLUMNS
        assert len(after) == out.count()
        if name == "quality":
            assert set(after) == {d for d, t, _ in before if "$$$" not in t}
        elif name == "line_dedup":
            want = {d: t for d, t in brute_lines(before, 25) if t.strip() or (d, t) in {(x, y) for x, y, _ in before}}
            assert {d: r["text"] for d, r in after.items()} == want and all(r["n_chars"] == len(r["text"]) for d, r in after.items() if 301 <= d <= 303)
        elif name == "near_dedup":
            want = {d for d, _, c in brute_components(before, 5, 80) if d == c}
            assert set(after) ^ want == set() and 320 in after and 321 not in after
        elif name == "decontamination":
            item = [(1, spark.read.parquet(f"{folder}/benchmark.parquet").first()["text"])]
            assert set(after) == {d for d, t, _ in before if not brute_hits(t, item)[-1]} and 310 not in after
        else:
            assert all(r["taken"] > 0 for r in after.values())
        docs = out


def test_run_and_empty(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 50
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_rows_with_one_id(spark, folder):
    """Repeated ids, null ids, nulls and empty texts: each row is judged for itself."""
    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choice("aeiortnsl") for _ in range(5)) for _ in range(40))
    a, b, c = text(), text(), text()
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first()["text"]
    rows = [(1, a, "x", "s", 1), (1, a, "x", "s", 1), (1, a, "y", None, 1), (2, a, "x", "s", 1), (1, b, "x", "t", 1), (None, c, "x", "s", 1), (None, c, None, "s", 1), (None, text(), "x", "s", 1), (3, None, None, None, None), (3, None, None, None, None), (4, "", "x", "s", 0), (None, None, "x", "s", 0), (5, "y " + item, "x", "s", 1), (5, text(), "x", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    left = [tuple(r) for r in corpus_pipeline.near(spark, docs, folder).collect()]
    texts = [t for _, t, *_ in left if t]
    assert len(texts) == len(set(texts)) == 6 and sum(not t for _, t, *_ in left) == 4
    assert (1, a) in {x[:2] for x in left} and len([x for x in left if x[1] == a]) == 1
    left = [tuple(r) for r in corpus_pipeline.decontaminated(spark, docs, folder).collect()]
    assert sorted(map(str, left)) == sorted(str(x) for x in rows if not (x[1] or "").startswith("y "))
    out = corpus_pipeline.mixed(spark, docs, folder)
    got = [tuple(r)[:5] for r in out.collect()]
    assert all(got.count(x) <= rows.count(x) for x in got) and out.columns == [*corpus_pipeline.COLUMNS, "taken", "target"]
    assert not any(x[1] in (None, "") for x in got)
