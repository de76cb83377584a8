"""Deleting repeated runs of lines by a suffix array over line ids.

The corpus is a sequence of lines (blank ones left out), a document after the
other in the order of doc_id. Suffixes are ranked by prefix doubling: a line's
id is its rank at depth 1, and the ranks of two neighbouring blocks of n lines
give, sorted, the rank of the block of 2n. Only suffixes whose block repeats go
on to the next depth. Ranks at depth n are the suffix array's order as far as n
lines tell it, and suffixes of one rank are an interval of the array whose
longest common prefix is at least n.

A run is repeated when it has MIN_WORDS words or more and occurs earlier. Its
interval is named by two overlapping blocks of 2^k lines. To delete every line
of every such run it is enough to look, at each line, at the shortest run of
MIN_WORDS words that begins there and the shortest that ends there: a longer run
is the union of these. As they have MIN_WORDS lines at most, the number of
rounds has a bound that does not depend on the corpus.

Defined results: null texts stay null, blank lines stay; lines are compared
without white space at either end; the first copy in order of doc_id stays (of
rows that are equal in doc_id and text both do, as one document); a run that
overlaps its own earlier copy keeps one period; every line that the corpus has
is left somewhere; a null doc_id comes last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Temporary, materialize, release, salted_join

#: Runs of at least so many words are deleted where they come again.
MIN_WORDS = 25
_KEY = ["ord", "dk"]


def _ranks(blocks: DataFrame, by: list[str], label: str) -> DataFrame:
    """Of blocks that occur more than once: a rank in their order by `by`. The
    ids of a range-partitioned, sorted table ascend with the key; the table is
    written, so they don't change when a task runs again."""
    again = blocks.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return materialize(again.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("above", F.monotonically_increasing_id()), label)


def _windows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """From each document's repeated lines (place, words): the shortest runs of
    consecutive places with `least` words that begin or end at a line."""
    for batch in batches:
        for o, d, lines in zip(*(c.to_pylist() for c in batch.columns)):
            at = sorted((x["i"], x["words"]) for x in lines)
            i, w = (np.array(c, dtype=np.int64) for c in zip(*at))
            found = []
            for part in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i) > 1) + 1):
                upto = np.concatenate([[0], np.cumsum(w[part])])
                n, first = len(part), i[part[0]]
                end = np.searchsorted(upto, upto[:-1] + least)  # exclusive end of the run from each line
                begin = np.searchsorted(upto, upto[1:] - least, side="right") - 1  # first line of the run up to each line
                s = np.arange(n)
                found.append(np.stack([s[end <= n] + first, (end - s)[end <= n]], 1))
                found.append(np.stack([begin[begin >= 0] + first, (s + 1 - begin)[begin >= 0]], 1))
            out = np.unique(np.concatenate(found), axis=0)
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array([o] * len(out), pa.int64()), pa.array([d] * len(out), pa.int64()), pa.array(out[:, 0]), pa.array(out[:, 1])], names=["ord", "dk", "s", "len"])


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, tmp: Temporary | None = None) -> DataFrame:
    """Later copies of repeated runs: rows (ord, dk, line_no), a row for each line to delete;
    (ord, dk) is a document's place and the hash of its row. What it is made of is
    in the tables of tmp."""
    tmp = tmp or Temporary()
    split = F.expr(r"filter(transform(split(text, '\n'), (x, i) -> struct(i AS line_no, trim(BOTH ' \t\r' FROM x) AS line)), x -> x.line <> '')")
    lines = docs.filter("text IS NOT NULL").select(*place(), F.posexplode(split).alias("i", "x")).select(*_KEY, F.col("i").cast("long").alias("i"), F.col("x.line_no").alias("line_no"), F.regexp_count("x.line", F.lit(r"\S+")).alias("words"), F.xxhash64("x.line").alias("h1"), F.xxhash64(F.lit(1), "x.line").alias("h2"))
    lines = materialize(lines.filter("words > 0"), "lines")
    level = _ranks(lines, ["h1", "h2"], "ranks")
    active = tmp(salted_join(lines.withColumn("salt", F.xxhash64(*_KEY, "i")), level, ["h1", "h2"], "salt").select(*_KEY, "i", "line_no", "words", F.col("above").alias("rank")).distinct(), "level")
    per_doc = active.groupBy(*_KEY).agg(F.collect_list(F.struct("i", "words")).alias("lines"))
    runs = tmp(per_doc.mapInArrow(lambda it: _windows(it, min_words), "ord long, dk long, s long, len long"), "runs")
    release(level, lines)
    ranks, at, k, later = active.select(*_KEY, "i", "rank"), active.select(*_KEY, "i", "line_no"), 0, None
    deepest = runs.agg(F.max("len")).first()[0] or 0
    while (1 << k) <= deepest:
        here = runs.filter(f"len >= {1 << k} AND len < {2 << k}")
        ends = here.join(ranks.select(*_KEY, F.col("i").alias("s"), F.col("rank").alias("ra")).hint("merge"), [*_KEY, "s"]).withColumn("i", F.expr(f"s + len - {1 << k}")).join(ranks.select(*_KEY, "i", F.col("rank").alias("rb")).hint("merge"), [*_KEY, "i"])
        ends = tmp(ends.select(*_KEY, "s", "len", "ra", "rb"), "intervals")
        first = ends.groupBy("len", "ra", "rb").agg(F.min(F.struct(*_KEY, "s")).alias("first"), F.max(F.struct(*_KEY, "s")).alias("last")).filter("first <> last").drop("last")
        copies = salted_join(ends.withColumn("salt", F.xxhash64(*_KEY, "s")), first, ["len", "ra", "rb"], "salt").filter(F.struct(*_KEY, "s") > F.col("first")).select(*_KEY, "s", "len")
        later = copies if later is None else later.union(copies)
        # The next depth: two neighbouring blocks.
        pair = ranks.join(ranks.select(*_KEY, F.expr(f"i - {1 << k}").alias("i"), F.col("rank").alias("next")).hint("merge"), [*_KEY, "i"])
        pair = materialize(pair, "pairs")
        level = _ranks(pair, ["rank", "next"], "ranks")
        ranks = tmp(salted_join(pair.withColumn("salt", F.xxhash64(*_KEY, "i")), level, ["rank", "next"], "salt").select(*_KEY, "i", F.col("above").alias("rank")), "level")
        release(pair, level)
        k += 1
    if later is None:
        return at.select(*_KEY, "line_no").limit(0)
    gone = later.select(*_KEY, F.explode(F.expr("sequence(s, s + len - 1)")).alias("i")).distinct()
    return gone.join(at.hint("merge"), [*_KEY, "i"]).select(*_KEY, "line_no")


def place() -> list[F.Column]:
    """A document's place in the order, and the hash that tells its row from others."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("ord"), F.xxhash64(F.col("doc_id").cast("string"), "text").alias("dk")]


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs (doc_id, text and any others) with the later copies of repeated runs
    of lines deleted from text, and the number of lines deleted as n_removed."""
    tmp = Temporary()
    gone = repeated_runs(docs.select("doc_id", "text"), min_words, tmp).groupBy(*_KEY).agg(F.collect_list("line_no").alias("gone"))
    names = {c: f"_{k}" for k, c in enumerate(docs.columns)}
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], *place())
    gone = materialize(gone, "gone")
    tmp.clear()
    both = own.join(gone.hint("merge"), _KEY, "left")
    text = names["text"]
    # Kept places, by a hash set, then their lines.
    lines = both.withColumn("lines", F.when(F.col("gone").isNotNull(), F.split(F.col(text), "\n")))
    left = F.expr("array_join(transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i]), '\n')")
    out = lines.withColumn(text, F.when(F.col("gone").isNull(), F.col(text)).otherwise(left)).withColumn("n_removed", F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long"))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], "n_removed")
