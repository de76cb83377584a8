"""Top-k search of mistyped queries in a dictionary.

The search is a theta join on `cost <= budget` and a top k of each query. search()
scans blocks of terms for each distinct query with numpy, the heaviest terms first
and the others within what the k best leave of the budget, so what is shuffled is
k rows a query and block. within_budget() is
the same join as a DataFrame plan that returns every pair: an equi join on the
term's length, the query's being widened by budget / 8, then bounds that no pair
within the budget fails, then the distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..errors import BudgetTooLargeError, QueryTooLongError
from ..functions.costs import MAX_QUERY, UNIT, CostModel, least_cost, symbol_mask, symbol_parts, whole_units
from ..functions.distance import distance
from ..functions.normalize import normalize
from ..functions.scan import RankedTerms

#: Dictionaries of up to so many terms are sent to every task.
BROADCAST_TERMS = 500_000
#: Blocks of a larger one, and groups of queries that meet each.
BLOCK_TERMS, GROUP_QUERIES = 200_000, 20_000
#: In joins, larger ones are dealt into so many parts for each length.
PARTS = 64


@dataclass(frozen=True)
class SearchConfig:
    """k best terms within a budget. ranking: `coarse` compares costs in whole
    edits, then weights; `exact` compares costs. max_nodes and tsb belong to an
    index walk that this engine has not; they are accepted and change nothing."""

    k: int = 10
    budget: int = 32
    ranking: str = "coarse"
    tsb: bool = True
    max_nodes: int = 100_000

    @classmethod
    def high_recall(cls) -> SearchConfig:
        return cls(budget=48)

    def merged(self, **over) -> SearchConfig:
        return replace(self, **{k: v for k, v in over.items() if v is not None})

    def check(self, cm: CostModel) -> None:
        if self.ranking not in ("coarse", "exact"):
            raise ValueError("ranking must be 'coarse' or 'exact'")
        if self.k < 0 or self.budget < 0:
            raise ValueError("k and budget must not be negative")
        if self.budget > cm.max_budget:
            raise BudgetTooLargeError(f"budget {self.budget} is over {cm.max_budget}")


def candidates(queries: DataFrame, dictionary: DataFrame, budget: int, cm: CostModel = CostModel(), prefix: bool = False, prune: bool = True, terms: int | None = None) -> DataFrame:
    """Pairs of queries (q) and terms that pass the bounds. prune=False: all pairs."""
    q = queries.withColumn("m", F.length("q"))
    if not prune:
        return q.crossJoin(dictionary)
    band, each = budget // cm.c_indel_min, cm.c_min
    q = q.withColumn("qmask", symbol_mask("q")).withColumn("qparts", symbol_parts("q", cm))
    dictionary = dictionary.withColumn("parts", symbol_parts("norm", cm))
    top = 0
    if prefix:
        top = dictionary.agg(F.max("n")).first()[0] or 0
        lengths = F.sequence(F.greatest(F.lit(1), F.col("m") - band), F.greatest(F.lit(1), F.col("m") - band, F.lit(top)))
    else:
        lengths = F.sequence(F.greatest(F.lit(1), F.col("m") - band), F.greatest(F.lit(1), F.col("m") + band))
    terms = dictionary.count() if terms is None else terms
    q = q.withColumn("n", F.explode(lengths))
    if terms <= BROADCAST_TERMS:
        both = q.join(F.broadcast(dictionary), "n")
    else:
        parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
        both = q.withColumn("part", parts).join(dictionary.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")), ["n", "part"]).drop("part")
    lacks = F.bit_count(F.col("qmask").bitwiseAND(F.bitwise_not("mask"))) * each <= budget
    if not prefix:
        lacks &= F.bit_count(F.col("mask").bitwiseAND(F.bitwise_not("qmask"))) * each <= budget
    # The masks alone are quick; what they leave is bounded more closely.
    lacks &= least_cost("qparts", "mask", cm) <= budget
    if not prefix:
        lacks &= least_cost("parts", "qmask", cm) <= budget
    return both.filter(lacks).drop("qparts", "parts")


def within_budget(queries: DataFrame, dictionary: DataFrame, budget: int, cm: CostModel = CostModel(), prefix: bool = False, prune: bool = True, terms: int | None = None) -> DataFrame:
    """Every pair with its cost, if that is within the budget."""
    pairs = candidates(queries, dictionary, budget, cm, prefix, prune, terms)
    # A prefix of more than m + band symbols can't be the best within the budget.
    term = F.expr(f"substring(norm, 1, m + {budget // cm.c_indel_min})") if prefix else F.col("norm")
    scored = pairs.withColumn("cost", distance(F.col("q"), term, cm, prefix))
    return scored.filter(F.col("cost") <= budget)


def ranked(hits: DataFrame, k: int, ranking: str = "coarse", by: str = "q") -> DataFrame:
    """The k best hits of each query with their rank, from 1."""
    key = whole_units(F.col("cost")) if ranking == "coarse" else F.col("cost")
    rank = F.row_number().over(Window.partitionBy(by).orderBy(key, F.desc("weight"), "id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k)


def _scanned(batches: Iterator[pa.RecordBatch], terms: RankedTerms, config: SearchConfig, cm: CostModel, prefix: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for q, budget in zip(batch.column("q").to_pylist(), batch.column("budget").to_pylist()):
            ids, cost, weights = terms.best(q, config.k, budget, config.ranking, cm, prefix)
            yield pa.RecordBatch.from_arrays([pa.array([q] * len(ids), pa.string()), pa.array(ids), pa.array(cost.astype(np.int32)), pa.array(weights.astype(np.int32))], names=["q", "id", "cost", "weight"])


def scan(asked: DataFrame, dictionary: DataFrame, config: SearchConfig, cm: CostModel, prefix: bool) -> DataFrame:
    """(q, id, cost, weight): the k best of each query, and of each block of terms.

    A dictionary of up to BROADCAST_TERMS terms, which is counted first, is sent to
    the tasks. Of a larger one the heaviest are, up to BLOCK_TERMS; the lighter ones
    are dealt into blocks of that size, each with all queries in groups, and are
    searched for what costs less than the worst of the k that a query has by then.
    A query's hits of all blocks are ranked afterwards."""
    out = "q string, id long, cost int, weight int"
    terms, asked = dictionary.select("id", "norm", "weight"), asked.withColumn("budget", F.lit(config.budget))
    scanned = lambda it, block: _scanned(it, block, config, cm, prefix)
    n = terms.count()
    if n <= BROADCAST_TERMS or not config.k:
        return blockwise(asked, terms, n, RankedTerms, scanned, out)
    heavy, lightest = 0, None
    for weight, some in terms.groupBy("weight").count().orderBy(F.desc("weight")).collect():
        if heavy + some > BLOCK_TERMS:
            break
        heavy, lightest = heavy + some, weight
    if not heavy:
        return blockwise(asked, terms, n, RankedTerms, scanned, out)
    first = blockwise(asked, terms.filter(F.col("weight") >= lightest), heavy, RankedTerms, scanned, out).persist()
    worst = F.max(whole_units(F.col("cost"))) * UNIT if config.ranking == "coarse" else F.max("cost")
    full = first.groupBy("q").agg(F.count(F.lit(1)).alias("hits"), (worst - (UNIT if config.ranking == "coarse" else 1)).alias("less")).filter(F.col("hits") == config.k)
    left = asked.join(full, "q", "left").select("q", F.least("budget", "less").cast("int").alias("budget")).filter("budget >= 0")
    return first.unionByName(blockwise(left, terms.filter(F.col("weight") < lightest), n - heavy, RankedTerms, scanned, out, dealt=True))


def blockwise(asked: DataFrame, terms: DataFrame, n: int, make, scanned, out: str, dealt: bool = False) -> DataFrame:
    """Rows `out` that scanned(batches of asked (q, ...), block) yields for each query and
    each block, which make() builds of the three columns of n terms, ids first.
    dealt: blocks are not sent to every task even if there are few terms."""
    spark, (key, *rest) = asked.sparkSession, terms.columns
    if n <= BROADCAST_TERMS and not dealt:
        rows = terms.collect()
        block = spark.sparkContext.broadcast(make(*([r[i] for r in rows] for i in range(3))))
        some = asked.repartition(max(2, 2 * spark.sparkContext.defaultParallelism), "q")
        return some.mapInArrow(lambda it: scanned(it, block.value), out)
    blocks, groups = max(1, -(-n // BLOCK_TERMS)), max(1, -(-asked.count() // GROUP_QUERIES))
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = asked.withColumn("group", F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int")).withColumn("block", each(blocks))
    right = terms.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).withColumn("group", each(groups))
    schema = to_arrow_schema(_parse_datatype_string(out))
    # So many parts that few hold two blocks; small ones would be put together else.
    parts = min(2000, 8 * blocks * groups)
    left, right = (x.repartition(parts, "block", "group") for x in (left, right))

    def run(qs: pa.Table, ts: pa.Table) -> pa.Table:
        block = make(*(ts.column(c).to_pylist() for c in (key, *rest)))
        found = [b.cast(schema) for b in scanned(iter(qs.drop_columns(["block", "group"]).to_batches()), block)]
        return pa.Table.from_batches(found, schema)

    return left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(run, out)


def search(queries: DataFrame, dictionary: DataFrame, config: SearchConfig = SearchConfig(), cm: CostModel = CostModel(), prefix: bool = False, observation: Observation | None = None) -> DataFrame:
    """(qid, rank, id, term, norm, cost, weight, input_index) for queries (qid, q),
    which are taken as they are; see search_text.

    A null query has no hit; an empty one only prefixes. Queries of over 128 code
    points are an error, as is a budget over the cost model's limit."""
    config.check(cm)
    if queries.filter(F.length("q") > MAX_QUERY).limit(1).count():
        raise QueryTooLongError(f"a query has more than {MAX_QUERY} code points")
    asked = queries.filter("q IS NOT NULL")
    hits = scan(asked.select("q").distinct(), dictionary, config, cm, prefix)
    if observation:
        hits = hits.observe(observation, F.count(F.lit(1)).alias("kept"))
    best = ranked(hits, config.k, config.ranking).join(dictionary.select("id", F.col("source").alias("term"), "norm", "input_index"), "id")
    return asked.select("qid", "q").join(best, "q").select("qid", "rank", "id", "term", "norm", "cost", "weight", "input_index")


def search_text(queries: DataFrame, dictionary: DataFrame, config: SearchConfig = SearchConfig(), cm: CostModel = CostModel(), fold_case: bool = True, fold_diacritics: bool = True, prefix: bool = False) -> DataFrame:
    """search on queries folded as the dictionary's terms are."""
    return search(queries.withColumn("q", normalize(F.col("q"), fold_case, fold_diacritics)), dictionary, config, cm, prefix)


def search_prefix(queries: DataFrame, dictionary: DataFrame, config: SearchConfig = SearchConfig(), cm: CostModel = CostModel()) -> DataFrame:
    """Autocomplete: a term costs what its best prefix costs; the hit is the whole term."""
    return search(queries, dictionary, config, cm, prefix=True)


def baseline_osa2(queries: DataFrame, dictionary: DataFrame, k: int = 10, most: int = 2) -> DataFrame:
    """The plain method: two ordinary edits at most, then heavier, then earlier terms."""
    from ..functions.distance import UNIT_COSTS

    pairs = queries.select("q").distinct().filter("q IS NOT NULL").withColumn("m", F.length("q")).withColumn("n", F.explode(F.sequence(F.greatest(F.lit(1), F.col("m") - most), F.col("m") + most))).join(dictionary, "n")
    hits = pairs.withColumn("cost", distance("q", "norm", UNIT_COSTS)).filter(F.col("cost") <= most)
    rank = F.row_number().over(Window.partitionBy("q").orderBy("cost", F.desc("weight"), "input_index"))
    best = hits.withColumn("rank", rank).filter(F.col("rank") <= k)
    return queries.select("qid", "q").join(best.select("q", "rank", "id", F.col("source").alias("term"), "cost", "weight", "input_index"), "q").drop("q")


def deletions(text: str) -> F.Column:
    """The text and every one with a character taken out, each once."""
    return F.expr(f"array_distinct(concat(array({text}), transform(filter(sequence(1, length({text}) + 1), i -> i <= length({text})), i -> concat(substring({text}, 1, i - 1), substring({text}, i + 1)))))")


def deletion_join(queries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(q, id, norm) of pairs that share a text with one character taken out at
    most on either side: an equi join on these. All pairs of distance 1 are there."""
    left = queries.select("q").distinct().select("q", F.explode(deletions("q")).alias("variant"))
    right = dictionary.select("id", "norm", F.explode(deletions("norm")).alias("variant"))
    return left.join(right, "variant").select("q", "id", "norm").distinct()


def swaps(text: str) -> F.Column:
    """Every text with two different neighbours swapped."""
    return F.expr(f"filter(transform(filter(sequence(1, length({text})), i -> i < length({text})), i -> concat(substring({text}, 1, i - 1), substring({text}, i + 1, 1), substring({text}, i, 1), substring({text}, i + 2))), x -> x <> {text})")


def within_levenshtein(queries: DataFrame, dictionary: DataFrame, most: int = 2) -> DataFrame:
    """(q, id, norm, d): pairs within an ordinary edit distance, built in."""
    pairs = queries.select("q").distinct().withColumn("n", F.explode(F.expr(f"sequence(greatest(1, length(q) - {most}), length(q) + {most})"))).join(dictionary.select("id", "norm", "n"), "n")
    return pairs.withColumn("d", F.levenshtein("q", "norm", most)).filter("d >= 0").select("q", "id", "norm", "d")
