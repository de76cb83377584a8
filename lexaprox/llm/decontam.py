"""Benchmark decontamination by winnowing.

A span of SPAN = 10 words is hit when it equals 10 consecutive words of an item.
Hashes of GRAM = 5 consecutive words are taken, and in every window of 6 of them
(that is, of 10 words) the smallest is the fingerprint. Equal spans have equal
fingerprints, so joining the fingerprints of documents and items finds every
shared span; each candidate is then extended to its 10 words, compared word by
word. Items of fewer words are one span of their own length.

The fingerprints of the items are sent to the tasks while their texts have at
most LOCAL_CHARS characters, which is checked; beyond, documents and items are
joined on the fingerprint by a shuffle, common fingerprints dealt over tasks, and
each document's text meets the items that share one with it. Both ways give the
same rows.

Defined results: a null or blank text has no words; a document is judged as a
whole, however long; repeated rows are repeated; an empty benchmark hits
nothing; items with a null id are left out of the list of items, but hit; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import chunks, materialize, mix64, release, salted_join, spread_join, text_batches

SPAN, GRAM = 10, 5
#: Items of up to so many characters in all are sent to every task.
LOCAL_CHARS = 4_000_000
_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_MUL = mix64(np.arange(1, SPAN + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def item_words(text: str | None) -> list[bytes]:
    """Words of letters, digits and anything beyond ASCII, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive word hashes, by the first one's place."""
    m = max(0, len(h) - n + 1)
    out = np.full(m, n, dtype=np.uint64)
    for j in range(n if m else 0):
        out += mix64(h[j : j + m] + _MUL[j]) * _MUL[j]
    return mix64(out)


def winnow(h: np.ndarray) -> np.ndarray:
    """The fingerprint of each window of SPAN words, by the first word's place."""
    g = grams(h, GRAM)
    m = max(0, len(g) - (SPAN - GRAM))
    out = g[:m].copy()
    for j in range(1, SPAN - GRAM + 1 if m else 0):
        np.minimum(out, g[j : j + m], out=out)
    return out


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


class Items:
    """The spans of a bounded number of items."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        self.spans: dict[bytes, set] = defaultdict(set)
        marks, short = [], defaultdict(list)
        with np.errstate(over="ignore"):
            for item, text in rows:
                w = item_words(text)
                if len(w) >= SPAN:
                    marks.append(winnow(_hashed(w)))
                    for i in range(len(w) - SPAN + 1):
                        self.spans[b" ".join(w[i : i + SPAN])].add(item)
                elif w:
                    short[len(w)].append(grams(_hashed(w), len(w)))
                    self.spans[b" ".join(w)].add(item)
        self.marks = np.unique(np.concatenate(marks)) if marks else np.empty(0, np.uint64)
        self.short = {n: np.unique(np.concatenate(v)) for n, v in short.items()}

    def hits(self, words: list[bytes], h: np.ndarray) -> tuple[int, set]:
        """How many of a document's words are hit, and by which items."""
        edges: list[tuple[int, int]] = []
        found: set = set()
        looks = [(n, grams(h, n), marks) for n, marks in self.short.items()]
        if len(self.marks):
            looks.append((SPAN, winnow(h), self.marks))
        for n, have, marks in looks:
            for i in np.flatnonzero(_among(have, marks)).tolist():
                if got := self.spans.get(b" ".join(words[i : i + n])):
                    found |= got
                    edges.append((i, i + n))
        hit, upto = 0, 0
        for lo, hi in sorted(edges):
            hit += max(0, hi - max(lo, upto))
            upto = max(upto, hi)
        return hit, found


def _among(have: np.ndarray, sorted_marks: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_marks, have)
    at[at == len(sorted_marks)] = 0
    return sorted_marks[at] == have


def _judge(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            at = 0
            for ids, texts in chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = []
                for i, t in zip(ids, texts):
                    words = item_words(t)
                    hit, found = items.hits(words, _hashed(words))
                    names = sorted(str(x) for x in found if x is not None)
                    out.append((i, len(words), hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0))
                judged = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()))]
                rest = [batch.column(c).slice(at, len(out)) for c in batch.schema.names[2:]]
                at += len(out)
                yield pa.RecordBatch.from_arrays([*judged, *rest], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", *batch.schema.names[2:]])


def _marks(batches: Iterator[pa.RecordBatch], lengths: list[int], whole: bool) -> Iterator[pa.RecordBatch]:
    """(key, mark) of every fingerprint; for short items (whole) of the item,
    for documents of every gram of those lengths."""
    with np.errstate(over="ignore"):
        for batch in batches:
            for keys, texts in chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist(), 1 << 19):
                for k, t in zip(keys, texts):
                    words = item_words(t)
                    h = _hashed(words)
                    parts = [winnow(h)] + [grams(h, n) for n in ([len(words)] if whole and 0 < len(words) < SPAN else [] if whole else lengths)]
                    m = np.unique(np.concatenate(parts)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(m), pa.binary()), pa.array(m)], names=["key", "mark"])


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts with the items that they may hold: how many words are hit, and by which."""
    with np.errstate(over="ignore"):
        for batch in batches:
            for k, t, rows in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "items"))):
                words = item_words(t)
                hit, found = Items([(x["item_id"], x["item_text"]) for x in rows]).hits(words, _hashed(words))
                if hit:
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.binary()), pa.array([hit], pa.int64()), pa.array([sorted(str(x) for x in found if x is not None)], pa.list_(pa.string()))], names=["key", "n_hit", "names"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, local_chars: int = LOCAL_CHARS, keep: list[str] | None = None) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one for
    each of docs (doc_id, text), against benchmark (item_id, text). Columns of docs
    named in keep come with their row, as fields of a struct named row."""
    spark = docs.sparkSession
    text_batches(spark)
    row = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")] if keep else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row)
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text")).filter("item_text IS NOT NULL")
    if (bench.agg(F.sum(F.length("item_text") + 8)).first()[0] or 0) <= local_chars:
        items = spark.sparkContext.broadcast(Items([tuple(r) for r in bench.collect()]))
        return docs.mapInArrow(lambda it: _judge(it, items.value), OUT + (f", row {docs.schema['row'].dataType.simpleString()}" if keep else ""))
    return _by_shuffle(docs, bench)


def _by_shuffle(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Of any number of items: the join on fingerprints by a shuffle."""
    # Copies of a text are judged once; its hash is the key.
    key = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    texts = docs.filter("text IS NOT NULL").select(key.alias("key"), "text")
    named = bench.select(F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("item_id").cast("string"), F.lit("")), "item_text").cast("binary"))).alias("item_key"), "item_id", "item_text").filter("item_text IS NOT NULL")
    item_marks = materialize(named.select("item_key", "item_text").mapInArrow(lambda it: _marks(it, [], True), "key binary, mark long"), "item-marks").withColumnRenamed("key", "item_key")
    # Grams of documents are needed of those lengths only that items have: 1 to SPAN - 1.
    lengths = sorted(r[0] for r in named.select(_counted(F.col("item_text")).alias("n")).filter(f"n BETWEEN 1 AND {SPAN - 1}").distinct().collect())
    doc_marks = texts.mapInArrow(lambda it: _marks(it, lengths, False), "key binary, mark long")
    # Documents' marks that no item has stay out before the join; those of a common passage are dealt out.
    wanted = materialize(item_marks.groupBy("mark").agg(F.count(F.lit(1)).alias("items")), "wanted")
    met = materialize(salted_join(doc_marks, wanted, ["mark"], "key", 8).select("key", "mark"), "met")
    rows = materialize(met.groupBy("mark").agg(F.count(F.lit(1)).alias("rows")).join(item_marks.groupBy("mark").agg(F.collect_set("item_key").alias("item_keys")).hint("merge"), "mark"), "marks")
    pairs = spread_join(met, rows, "mark", "rows", "key").select("key", F.explode("item_keys").alias("item_key")).distinct()
    # A document's text comes once, with all the items that it may hold.
    held = pairs.join(named.hint("merge"), "item_key").groupBy("key").agg(F.collect_list(F.struct("item_id", "item_text")).alias("items"))
    both = texts.groupBy("key").agg(F.min("text").alias("text")).join(held.hint("merge"), "key").select("key", "text", "items")
    hit = materialize(both.mapInArrow(_extend, "key binary, n_hit long, names array<string>"), "hit")
    release(wanted, met, rows)
    counted = docs.select("doc_id", key.alias("key"), _counted(F.col("text")).alias("n_words"), *(["row"] if "row" in docs.columns else []))
    names = F.coalesce(F.col("names"), F.array().cast("array<string>"))
    return counted.join(hit, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), *(["row"] if "row" in docs.columns else []))


def _counted(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark
), own AS (
  SELECT item_id, least({SPAN}, len(w)) AS n, w, unnest(range(1, len(w) - least({SPAN}, len(w)) + 2)) AS i FROM items WHERE len(w) > 0
), spans AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM own
), places AS (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM spans) WHERE len(w) >= n
), hits AS (
  SELECT r, i, n, item_id FROM (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM places) JOIN spans USING (n, s)
), words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r
), names AS (
  SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS names FROM hits WHERE item_id IS NOT NULL GROUP BY r
)
SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(names), 0) AS n_items, sha256(coalesce(array_to_string(names, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN names USING (r)
"""
