"""How well searches find what was meant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import unit_osa
from ..functions.layout import neighbours


def usable_pairs(pairs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Pairs (typo, right) whose right word is a term and whose typo is none."""
    terms = dictionary.select("norm")
    return pairs.filter("typo <> right").join(terms, pairs["right"] == terms["norm"], "left_semi").join(terms, pairs["typo"] == terms["norm"], "left_anti")


def reciprocal_ranks(pairs: DataFrame, hits: DataFrame, depth: int = 10) -> DataFrame:
    """pairs (qid, right, ...) with rank, null if the word is not found, and rr."""
    found = hits.filter(F.col("rank") <= depth).groupBy("qid", F.col("norm").alias("right")).agg(F.min("rank").alias("rank"))
    return pairs.join(found, ["qid", "right"], "left").withColumn("rr", F.coalesce(1 / F.col("rank"), F.lit(0.0)))


def summary(ranks: DataFrame, *by: str) -> DataFrame:
    """n, MRR and the shares found first and at all, over all or by columns."""
    return ranks.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("rr").alias("mrr"), F.avg(F.when(F.col("rank") == 1, 1.0).otherwise(0.0)).alias("r_at_1"), F.avg(F.when(F.col("rank").isNotNull(), 1.0).otherwise(0.0)).alias("r_at_10"))


def paired_difference(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """Mean, standard error and 95 % interval of rr in a less rr in b, by qid, and
    how many differ. With fewer than two pairs there is no error."""
    both = a.select("qid", "rr", *by).join(b.select("qid", F.col("rr").alias("other")), "qid").withColumn("d", F.col("rr") - F.col("other"))
    out = both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), (F.stddev_samp("d") / F.sqrt(F.count(F.lit(1)))).alias("se"), F.sum(F.when(F.col("d") != 0, 1).otherwise(0)).alias("differ"))
    return out.withColumn("low", F.col("mean") - 1.96 * F.col("se")).withColumn("high", F.col("mean") + 1.96 * F.col("se"))


def macro_average(differences: DataFrame) -> DataFrame:
    """Over corpora, from paired_difference by corpus: the mean of means, its
    error, and whether a corpus is surely worse (veto)."""
    return differences.agg(F.count(F.lit(1)).alias("corpora"), F.avg("mean").alias("macro"), (F.sqrt(F.sum(F.col("se") * F.col("se"))) / F.count(F.lit(1))).alias("se"), F.max(F.col("high") < 0).alias("veto"))


def percentile_pick(values: DataFrame, value: str, p: float, *by: str) -> DataFrame:
    """The value at place floor(n * p) of the sorted ones, not interpolated."""
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    placed = values.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_at", F.row_number().over(w.orderBy(value)) - 1)
    return placed.filter(F.col("_at") == F.least(F.floor(F.col("_n") * p), F.col("_n") - 1)).select(*by, F.col(value).alias("value"))


def ties(hits: DataFrame, queries: DataFrame, depth: int = 10) -> DataFrame:
    """The share of queries two of whose best hits cost the same."""
    per = hits.filter(F.col("rank") <= depth).groupBy("qid").agg((F.count(F.lit(1)) > F.count_distinct("cost")).alias("tied"))
    return queries.select("qid").join(per, "qid", "left").agg(F.count(F.lit(1)).alias("queries"), F.avg(F.coalesce(F.col("tied").cast("int"), F.lit(0))).alias("ties"))


def overlap(a: DataFrame, b: DataFrame, queries: DataFrame, depth: int = 10) -> DataFrame:
    """For each query: the share of common hits, and whether the lists are equal."""
    ordered = lambda df, name: df.filter(F.col("rank") <= depth).groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias(name))
    none = F.array().cast("array<bigint>")
    both = queries.select("qid").join(ordered(a, "x"), "qid", "left").join(ordered(b, "y"), "qid", "left").withColumn("x", F.coalesce("x", none)).withColumn("y", F.coalesce("y", none))
    most = F.greatest(F.size("x"), F.size("y"))
    return both.select("qid", F.when(most == 0, 1.0).otherwise(F.size(F.array_intersect("x", "y")) / most).alias("overlap"), (F.col("x") == F.col("y")).alias("identical"))


def one_removed(longer: str, shorter: str) -> tuple[Column, Column]:
    """Whether taking a letter out of `longer` gives `shorter`, and whether that
    letter can be one of a double."""
    cut = f"filter(sequence(1, length({longer})), i -> concat(substring({longer}, 1, i - 1), substring({longer}, i + 1)) = {shorter})"
    twin = f"exists({cut}, i -> i > 1 AND substring({longer}, i, 1) = substring({longer}, i - 1, 1) OR i < length({longer}) AND substring({longer}, i, 1) = substring({longer}, i + 1, 1))"
    return F.expr(f"size({cut}) > 0"), F.expr(twin)


def classify(pairs: DataFrame, layout: str = "qwerty", typo: str = "typo", right: str = "right") -> DataFrame:
    """pairs with osa, category and first_differs."""
    touching = F.array(*[F.lit(a + b) for a, b in sorted(neighbours(layout))])
    place = f"array_min(filter(sequence(1, greatest(1, length({typo}))), i -> substring({typo}, i, 1) <> substring({right}, i, 1)))"
    differ = F.expr(f"size(filter(sequence(1, greatest(1, length({typo}))), i -> substring({typo}, i, 1) <> substring({right}, i, 1)))")
    near = F.array_contains(touching, F.expr(f"concat(substring({typo}, {place}, 1), substring({right}, {place}, 1))"))
    out = pairs.withColumn("osa", unit_osa(typo, right))
    same, less = F.length(typo) == F.length(right), F.length(typo) < F.length(right)
    missing, extra = one_removed(right, typo)[1], one_removed(typo, right)[1]
    kind = (F.when(F.col("osa") == 0, "same").when(F.col("osa") >= 2, "two or more edits").when(same & (differ == 1) & near, "neighbouring-key substitution").when(same & (differ == 1), "other substitution").when(same, "transposition")
            .when(less & missing, "missing doubled letter").when(less, "missing letter").when(extra, "extra doubled letter").otherwise("extra letter"))
    return out.withColumn("category", kind).withColumn("first_differs", F.substring(typo, 1, 1) != F.substring(right, 1, 1))


def by_category(ranks: DataFrame) -> DataFrame:
    """summary for each category, and for pairs whose first letter differs."""
    overlay = F.filter(F.array("category", F.when(F.col("first_differs"), "first letter differs")), lambda x: x.isNotNull())
    return summary(ranks.withColumn("category", F.explode(overlay)), "category")


def reachability(pairs: DataFrame, key, budgets: tuple[int, ...] = (32, 48, 64)) -> DataFrame:
    """By unit distance: how many pairs (osa, cost, typo, right) are within each
    budget, and how many have the same phonetic key."""
    return pairs.groupBy("osa").agg(F.count(F.lit(1)).alias("pairs"), *[F.count_if(F.col("cost") <= b).alias(f"within_{b}") for b in budgets], F.count_if(key("typo") == key("right")).alias("same_key"))


def hash_bucket(word: str, salt: str = "") -> Column:
    """A bucket of 0..99 of a word, the same wherever it is computed."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col(word)).cast("binary")), 1, 12), 16, 10).cast("long"), F.lit(100)).cast("int")


def sample_and_holdout(pairs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """n unique pairs in the order of a hash, and as many others that share
    neither a pair nor a typo with them."""
    unique = pairs.select("typo", "right").distinct().withColumn("_h", F.md5(F.concat_ws("\t", "typo", "right").cast("binary")))
    first = unique.orderBy("_h", "typo", "right").limit(n)
    rest = unique.join(first.select("typo"), "typo", "left_anti").orderBy("_h", "typo", "right").limit(n)
    return first.drop("_h"), rest.drop("_h")


TYPOS = {
    "drop": ("length(w) >= 3", "concat(substring(w, 1, 2), substring(w, 4))"),
    "swap": ("length(w) >= 4 AND substring(w, 3, 1) <> substring(w, 4, 1)", "concat(substring(w, 1, 2), substring(w, 4, 1), substring(w, 3, 1), substring(w, 5))"),
    "double": ("length(w) >= 2", "concat(substring(w, 1, 2), substring(w, 2))"),
    "neighbour": ("length(w) >= 2", "concat(substring(w, 1, 1), translate(substring(w, 2, 1), 'qwertyuiopasdfghjklzxcvbnm', 'wertyuiopqsdfghjklaxcvbnmz'), substring(w, 3))"),
    "first": ("length(w) >= 2", "concat(translate(substring(w, 1, 1), 'abcdefghijklmnopqrstuvwxyz', 'nopqrstuvwxyzabcdefghijklm'), substring(w, 2))"),
    "insert": ("length(w) >= 2", "concat(substring(w, 1, 2), 'e', substring(w, 3))"),
}


def make_typos(words: DataFrame, word: str = "norm") -> DataFrame:
    """(typo, right, kind): one of each kind for each word that is long enough."""
    made = [words.select(F.expr(text.replace("(w,", f"({word},").replace("w)", f"{word})")).alias("typo"), F.col(word).alias("right"), F.lit(kind).alias("kind")).filter(F.expr(when.replace("(w", "(right"))) for kind, (when, text) in TYPOS.items()]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out.filter("typo <> right")
