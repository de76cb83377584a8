"""The older search: candidates by byte comparisons, scored, over terms or over
the fields of documents. Texts are ASCII; A-Z are lower-cased on both sides."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import BuildError
from ..functions.fuzzy_scan import FuzzyBlock
from ..functions.typo_scores import BOARDS, fingerprint, position_curve, small
from .search import blockwise


def index_terms(terms: DataFrame, k: int = 2) -> DataFrame:
    """(term_index, term, t, n, fp) of terms (term_index, term)."""
    if not 0 <= k <= 4:
        raise BuildError("k must be 0 to 4")
    return terms.withColumn("t", small(F.col("term"))).withColumn("n", F.length("t")).withColumn("fp", fingerprint("t"))


def distinct_texts(index: DataFrame, most: int) -> DataFrame:
    """(id, t, copies): each text once, with its smallest index and up to `most` as its rows."""
    return index.filter("t IS NOT NULL").groupBy("t").agg(F.min("term_index").alias("id"), F.least(F.count(F.lit(1)), F.lit(most)).alias("copies")).select("id", "t", "copies")


def fuzzy_candidates(queries: DataFrame, index: DataFrame, k: int = 2) -> DataFrame:
    """(q, term_index, distance): the first of these that holds - as many places
    differ as k allows; one character more or less; letters that nearly agree and
    k edits at most."""
    asked = queries.select(small(F.col("q")).alias("q")).filter("q IS NOT NULL").distinct()
    texts = distinct_texts(index, 1)

    def scanned(batches: Iterator[pa.RecordBatch], block: FuzzyBlock) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q in batch.column("q").to_pylist():
                at, distance = block.candidates(q, k)
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(at), pa.string()), pa.array([block.texts[i] for i in at], pa.string()), pa.array(distance.astype(np.int32))], names=["q", "t", "distance"])

    found = blockwise(asked, texts, texts.count(), FuzzyBlock, scanned, "q string, t string, distance int")
    return found.join(index.select("term_index", "t"), "t").select("q", "term_index", "distance")


def fuzzy_search(queries: DataFrame, index: DataFrame, most: int = 10, k: int = 2, board: str = "qwerty", threshold: float | None = None) -> DataFrame:
    """(qid, rank, term_index, term, score, hamming_distance): the best `most` of
    each query by score, ties to the smaller index. A query of several words with
    fewer hits is filled up with terms that hold its words nearly. threshold
    drops worse hits after that.

    Equal texts have equal scores, so each is compared once: the `most` best texts,
    ties to the smaller first index, hold the `most` best rows, and no text has
    more of these than its `most` first."""
    if board not in BOARDS:
        raise ValueError(f"unknown keyboard {board!r}")
    texts = distinct_texts(index, most)
    size = texts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.length("t")), F.lit(0)).alias("longest")).first()
    asked = queries.select("qid", small(F.col("q")).alias("q")).filter("q IS NOT NULL")
    longest = size["longest"]

    def scanned(batches: Iterator[pa.RecordBatch], block: FuzzyBlock) -> Iterator[pa.RecordBatch]:
        curve = position_curve(longest)
        for batch in batches:
            for q in batch.column("q").to_pylist():
                found, score, distance, turn = block.best(q, most, k, curve, board)
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(found), pa.string()), pa.array(found, pa.string()), pa.array(score, pa.float32()), pa.array(distance.astype(np.int32)), pa.array(turn.astype(np.int32))], names=["q", "t", "score", "distance", "turn"])

    near = blockwise(asked.select("q").distinct(), texts, size["n"], FuzzyBlock, scanned, "q string, t string, score float, distance int, turn int")
    copy = F.row_number().over(Window.partitionBy("t").orderBy("term_index"))
    rows = index.filter("t IS NOT NULL").select("term_index", "term", "t").withColumn("copy", copy).filter(F.col("copy") <= most).drop("copy")
    hits = F.sum(F.when(F.col("turn") == 0, 1).otherwise(0)).over(Window.partitionBy("q"))
    every = near.join(rows, "t").withColumn("hits", hits).filter(f"turn = 0 OR hits < {most}")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "term_index"))
    best = every.withColumn("rank", rank).filter(F.col("rank") <= most)
    if threshold is not None:
        best = best.filter(F.col("score") >= threshold)
    return asked.join(best, "q").select("qid", "rank", "term_index", "term", "score", F.col("distance").alias("hamming_distance"))


def search_with_sort(queries: DataFrame, index: DataFrame, most: int, *order: Column, **kw) -> DataFrame:
    """Twice as many hits, in an order of one's own, cut to `most`."""
    hits = fuzzy_search(queries, index, 2 * most, **kw)
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).filter(F.col("rank") <= most)


def match_ranges(q: str, t: str) -> Column:
    """Runs of places where both texts have the same character: array of (start, end)."""
    n = f"least(length({q}), length({t}))"
    same = lambda i: f"({i} BETWEEN 1 AND {n} AND substring({q}, {i}, 1) = substring({t}, {i}, 1))"
    starts = f"filter(sequence(1, greatest(1, {n})), i -> {same('i')} AND NOT {same('(i - 1)')})"
    ends = f"filter(sequence(1, greatest(1, {n})), i -> {same('i')} AND NOT {same('(i + 1)')})"
    return F.expr(f"zip_with({starts}, {ends}, (a, b) -> struct(a - 1 AS start, b AS end))")


@dataclass(frozen=True)
class Documents:
    """Fields of documents and their weights."""

    fields: dict[str, float]
    k: int = 2
    board: str = "qwerty"
    threshold: float = 0.0

    def search(self, queries: DataFrame, docs: DataFrame, most: int = 10) -> DataFrame:
        """(qid, rank, doc_index, score, field_matches) for docs (doc_index, key,
        value): of each field's best 2 * most hits the scores, by weight, added up."""
        total, parts = sum(self.fields.values()), []
        for key, weight in self.fields.items():
            values = docs.filter(F.col("key") == key).select(F.col("doc_index").alias("term_index"), F.col("value").alias("term"))
            hits = fuzzy_search(queries, index_terms(values.select("term_index", "term"), self.k), 2 * most, self.k, self.board)
            parts.append(hits.select("qid", F.col("term_index").alias("doc_index"), F.lit(key).alias("key"), "term", "score", (F.col("score") * F.lit(weight / total)).cast("double").alias("part")))
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        summed = every.groupBy("qid", "doc_index").agg(F.sum("part").alias("score"), F.sort_array(F.collect_list(F.struct("key", "term", "score"))).alias("field_matches")).filter(F.col("score") > self.threshold)
        rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_index"))
        return summed.withColumn("rank", rank).filter(F.col("rank") <= most).select("qid", "rank", "doc_index", "score", "field_matches")


def melt(docs: DataFrame, id_col: str, *keys: str) -> DataFrame:
    """(doc_index, key, value) of a table's columns; nulls are left out."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys]))
    return docs.select(F.col(id_col).alias("doc_index"), each.alias("f")).select("doc_index", "f.key", "f.value").filter("value IS NOT NULL")
