"""Candidates by sound and by spelling rule, and their place among the hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.costs import MAX_QUERY, UNIT, CostModel, whole_units
from ..functions.distance import unit_osa
from .search import SearchConfig, ranked, scan


def same_sound(queries: DataFrame, dictionary: DataFrame, key, k: int = 10) -> DataFrame:
    """(qid, rank, id, norm, osa, weight): terms with the query's key, an equi join,
    nearest first by ordinary edits, then heavier ones."""
    asked = queries.select("q").distinct().withColumn("key", key("q"))
    pairs = asked.join(dictionary.select("id", "norm", "weight").withColumn("key", key("norm")), "key").withColumn("osa", unit_osa("q", "norm"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy("osa", F.desc("weight"), "id"))
    return queries.select("qid", "q").join(pairs.withColumn("rank", rank).filter(F.col("rank") <= k).drop("key"), "q").drop("q")


def inject(hits: DataFrame, phonetic: DataFrame, m: int, k: int = 10, gate: int | None = None) -> DataFrame:
    """(qid, rank, id): the first k - m hits, up to m phonetic ones that are not
    among them, then the other hits; k in all. gate: only where the best hit
    costs more."""
    ahead = hits.select("qid", "id", F.when(F.col("rank") <= k - m, 0).otherwise(2).alias("turn"), "rank", "cost")
    add = phonetic
    if gate is not None:
        best = hits.groupBy("qid").agg(F.min("cost").alias("best"))
        add = add.join(best, "qid", "left").filter(F.col("best").isNull() | (F.col("best") > gate))
    fresh = add.join(ahead.filter("turn = 0").select("qid", "id"), ["qid", "id"], "left_anti")
    turn = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    fresh = fresh.withColumn("_t", turn).filter(F.col("_t") <= m).select("qid", "id", F.lit(1).alias("turn"), "rank", F.lit(None).cast("int").alias("cost"))
    every = ahead.unionByName(fresh).groupBy("qid", "id").agg(F.min(F.struct("turn", "rank")).alias("o"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("o.turn", "o.rank", "id"))
    return every.withColumn("rank", place).filter(F.col("rank") <= k).select("qid", "rank", "id")


def variants(queries: DataFrame, rules: DataFrame) -> DataFrame:
    """(q, variant): every occurrence of a rule's `rule_from` rewritten to its `rule_to`."""
    some = queries.select("q").distinct().join(F.broadcast(rules), F.expr("locate(rule_from, q) > 0"))
    at = F.expr("filter(sequence(1, length(q)), i -> substring(q, i, length(rule_from)) = rule_from)")
    each = some.select("q", "rule_from", "rule_to", F.explode(at).alias("i"))
    return each.select("q", F.expr("concat(substring(q, 1, i - 1), rule_to, substring(q, i + length(rule_from)))").alias("variant")).filter(f"variant <> '' AND variant <> q AND length(variant) <= {MAX_QUERY}").distinct()


def rule_search(queries: DataFrame, dictionary: DataFrame, rules: DataFrame, rule_cost: int = 16, budget: int = 32, k: int = 10, depth: int = 30, cm: CostModel = CostModel()) -> DataFrame:
    """(qid, rank, id, norm, cost, weight): the best of a plain search and of the
    searches of all rewritten queries, whose hits cost rule_cost more."""
    var = variants(queries, rules)
    own = scan(queries.select("q").filter("q IS NOT NULL").distinct(), dictionary, SearchConfig(k, budget), cm, False)
    # The best `depth` in whole edits that can stay within the budget come before all others.
    reach = min(budget, max(0, -(-(budget - rule_cost) // UNIT)) * UNIT)
    far = ranked(scan(var.select(F.col("variant").alias("q")).distinct(), dictionary, SearchConfig(depth, reach), cm, False), depth).select(F.col("q").alias("variant"), "id", "weight", "cost")
    more = var.join(far, "variant").select("q", "id", (F.col("cost") + rule_cost).alias("cost"), "weight").filter(F.col("cost") <= budget)
    best = own.union(more).groupBy("q", "id", "weight").agg(F.min("cost").alias("cost"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(whole_units(F.col("cost")), F.desc("weight"), "id"))
    kept = best.withColumn("rank", rank).filter(F.col("rank") <= k).join(dictionary.select("id", "norm"), "id")
    return queries.select("qid", "q").join(kept, "q").select("qid", "rank", "id", "norm", "cost", "weight")


def mine_rules(pairs: DataFrame, top: int = 100, min_count: int = 2) -> DataFrame:
    """(rule_from, rule_to, n): rules that misspellings (typo, right) show most."""
    from ..functions.phonetic import residues

    each = pairs.select(F.explode(residues("typo", "right")).alias("r")).select("r.*")
    return each.groupBy("rule_from", "rule_to").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count).orderBy(F.desc("n"), "rule_from", "rule_to").limit(top)
