"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash of its id and text. Per source, the sizes are
summed by the first BITS bits of the hash; the budget ends within one of these
buckets. Only documents of that bucket are looked at again, by the next bits,
until the bucket holds one hash. Everything below the threshold found is taken,
so the documents are filtered, never sorted, and a larger budget takes a
superset. A histogram has at most 2^BITS rows a source and is summed before it
is shuffled, so a source with a third of all rows costs what any other does.

Defined results: a null or blank text has size 0 and is taken 0 times its size;
null sources are one source, the last; repeated rows have one hash and are taken
or left together; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize, release

WORD = r"[^\\x20\\x09-\\x0D]+"
BITS, ROUNDS = 12, 5
#: No source is repeated more often than this.
REPEATS = 3


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = REPEATS) -> DataFrame:
    """Targets of sources: totals has (source, source_size), a row each.

    Sources in code point order, null last, weigh as in `weights`, repeating.
    They share all words by weight, each up to `repeats` times its size; the
    excess is shared again by weight. In order of size per weight the sources
    at their limit come first, so the share per weight of the others follows
    from running sums."""
    every, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = totals.withColumn("weight", w.cast("long")).withColumn("most", F.col("source_size") * repeats)
    t = t.withColumn("ratio", F.col("most") / F.col("weight"))
    before, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0))
    share = left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    t = t.withColumn("share", share).withColumn("full", F.col("ratio") <= F.col("share"))
    level = F.first(F.when(~F.col("full"), F.col("share")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return t.withColumn("target", F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("weight") * level)).select("source", "source_size", "target")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), keep: list[str] | None = None) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken), one for each of docs.

    size is the number of words, target the source's share (source_targets),
    taken the words that the mix takes of the document, all its repeats counted.
    A source's taken words differ from its target by half a document at most,
    that being the one at the threshold. Columns of docs named in keep come with
    their row, as fields of a struct named row."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    text = F.coalesce(F.col("text"), F.lit(""))
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), text)
    row = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")] if keep else []
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", key.alias("key"), F.expr(f"CAST(regexp_count(coalesce(text, ''), '{WORD}') AS LONG)").alias("size"), F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10).cast("long").alias("h"), *row)
    sized = materialize(every.drop("row"), "sized")
    totals = sized.groupBy("source", "key").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals.select("source", "source_size"), weights)
    copies = F.when(F.col("source_size") > 0, F.least(F.lit(REPEATS), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    targets = targets.withColumn("copies", copies).withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
    plan = materialize(targets.withColumn("key", key).drop("source"), "targets")
    # (key, low): the first hash of the bucket in which the budget ends; budget: what is left there.
    edge = plan.select("key", F.lit(0).cast("long").alias("low"), "budget")
    for k in range(ROUNDS):
        shift = 60 - BITS * (k + 1)
        inside = sized.join(edge, "key").filter(F.shiftright(F.col("h"), shift + BITS) == F.shiftright(F.col("low"), shift + BITS))
        bucket = F.shiftleft(F.shiftright(F.col("h"), shift), shift)
        hist = inside.groupBy("key", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.first("budget").alias("budget"), F.min("h").alias("first"), F.max("h").alias("last"))
        upto = Window.partitionBy("key").orderBy("bucket")
        hist = hist.withColumn("above", F.sum("words").over(upto)).filter("above > budget")
        ends = hist.groupBy("key").agg(F.min_by(F.struct("bucket", "words", "above", "budget", "first", "last"), "bucket").alias("e"))
        new = materialize(ends.select("key", F.col("e.bucket").alias("low"), (F.col("e.budget") - F.col("e.above") + F.col("e.words")).alias("budget"), F.col("e.words").alias("words"), (F.col("e.first") == F.col("e.last")).alias("one")), "edge")
        if k:
            release(edge)
        edge = new
        if not edge.filter("NOT one").limit(1).count():
            break
    # The documents of the last bucket have one hash: they are taken if that comes nearer.
    stop = edge.select("key", F.when(F.col("words") - F.col("budget") < F.col("budget"), F.col("low") + F.lit(1 << shift)).otherwise(F.col("low")).alias("below"))
    cut = plan.join(stop, "key", "left")
    whole = F.col("below").isNull() & (F.col("budget") > 0)
    extra = F.when(whole | (F.col("h") < F.col("below")), F.col("size")).otherwise(0)
    # Rows with their texts are read again: that costs less than to write them with their sizes.
    return (every if keep else sized).join(cut, "key").select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size") + extra).cast("long").alias("taken"), *(["row"] if keep else []))


SQL = """
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS key, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents
), totals AS (
  SELECT key, source, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL
), weighed AS (
  SELECT *, [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 3 * source_size AS most FROM totals
), shared AS (
  SELECT *, most::DOUBLE / weight AS ratio, (sum(source_size) OVER () - coalesce(sum(most) OVER before, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS share
  FROM weighed WINDOW before AS (ORDER BY most::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT *, CASE WHEN ratio <= share THEN most::DOUBLE ELSE weight * (SELECT arg_min(share, (ratio, coalesce(source, ''), source IS NULL)) FROM shared WHERE ratio > share) END AS target FROM shared
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)) ELSE 0 END::BIGINT AS copies FROM targets
), budgets AS (
  SELECT *, target - copies * source_size AS budget FROM plan
), running AS (
  SELECT key, h, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY key ORDER BY h) AS above FROM d GROUP BY key, h
), ends AS (
  SELECT key, min(h) AS h FROM running JOIN budgets USING (key) WHERE above > budget GROUP BY key
), cut AS (
  SELECT key, CASE WHEN words < 2 * (budget - above + words) THEN h + 1 ELSE h END AS below FROM ends JOIN running USING (key, h) JOIN budgets USING (key)
)
SELECT doc_id, size, source_size, target, copies * size + CASE WHEN below IS NULL AND budget > 0 OR h < below THEN size ELSE 0 END AS taken
FROM d JOIN budgets USING (key) LEFT JOIN cut USING (key)
"""
