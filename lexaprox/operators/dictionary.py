"""Building dictionaries: normalise, merge, number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import BuildError, EmptyTermError
from ..functions.costs import symbol_mask
from ..functions.normalize import normalize

#: Bytes of a normalised term.
MOST_BYTES = 65535


def build(items: DataFrame, fold_case: bool = True, fold_diacritics: bool = True, strict: bool = True) -> DataFrame:
    """(id, norm, source, weight, input_index, n, mask) from items (input_index,
    term, weight).

    Terms that are equal when normalised are merged: the heaviest stays, of
    those the first. Ids count the normalised terms in the order of their bytes.
    strict: a term that is null, empty, or empty when normalised, one that is too
    long, or a weight outside 0..65535 is an error; else it is left out."""
    named = items.select(F.col("input_index").cast("long").alias("input_index"), F.col("term").alias("source"), F.col("weight").cast("int").alias("weight"), normalize(F.col("term"), fold_case, fold_diacritics).alias("norm"))
    empty, bad = "norm IS NULL OR norm = ''", f"octet_length(norm) > {MOST_BYTES} OR weight IS NULL OR weight NOT BETWEEN 0 AND 65535"
    if strict:
        wrong = named.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr(empty)).alias("empty"), F.count_if(F.expr(bad)).alias("bad")).first()
        if not wrong["n"]:
            raise BuildError("the dictionary is empty")
        if wrong["empty"]:
            raise EmptyTermError(f"{wrong['empty']} terms are empty or fold to nothing")
        if wrong["bad"]:
            raise BuildError(f"{wrong['bad']} terms are too long or have a weight outside 0..65535")
    good = named.filter(f"NOT ({empty}) AND NOT ({bad})")
    best = good.groupBy("norm").agg(F.min_by(F.struct("source", "weight", "input_index"), F.struct(-F.col("weight"), "input_index")).alias("b"))
    merged = best.select("norm", "b.*")
    return number(merged).select("id", "norm", "source", "weight", "input_index", F.length("norm").alias("n"), symbol_mask("norm").alias("mask"))


def number(terms: DataFrame) -> DataFrame:
    """terms (norm, ...) with id, their place in byte order.

    Blocks of terms that begin with the same two characters are counted, and the
    counts summed up; places within a block then need that block only. So there
    is no task with all terms, only one with all blocks."""
    block = F.substring("norm", 1, 2)
    sizes = terms.groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select("block", F.coalesce(F.sum("size").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("block").orderBy("norm")) - 1
    return terms.withColumn("block", block).join(before, "block").withColumn("id", (within + F.col("before")).cast("long")).drop("block", "before")


def prefixes(dictionary: DataFrame) -> DataFrame:
    """(prefix, terms, max_weight, len_min, len_max, below_mask) of every prefix,
    the empty one included: a row for each node of a trie of the terms.
    below_mask has the symbols that come after the prefix."""
    each = dictionary.select("norm", "weight", "n", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("k"))
    cut = each.select(F.expr("substring(norm, 1, k)").alias("prefix"), "weight", "n", F.expr("substring(norm, k + 1)").alias("rest"))
    return cut.groupBy("prefix").agg(F.count(F.lit(1)).alias("terms"), F.max("weight").alias("max_weight"), F.min("n").alias("len_min"), F.max("n").alias("len_max"), F.bit_or(symbol_mask("rest")).alias("below_mask"))


def node_count(dictionary: DataFrame) -> int:
    return prefixes(dictionary).count()


def add_items(items: DataFrame, more: DataFrame) -> DataFrame:
    """items followed by more, numbered on."""
    last = items.agg(F.coalesce(F.max("input_index") + 1, F.lit(0)).alias("offset"))
    moved = more.crossJoin(F.broadcast(last)).withColumn("input_index", F.col("input_index") + F.col("offset")).drop("offset")
    return items.unionByName(moved)


def remove_items(items: DataFrame, condition) -> tuple[DataFrame, int]:
    """items without those that meet a condition, numbered anew from 0; how many went."""
    gone = items.filter(condition).count()
    rest = items.filter(~F.coalesce(condition, F.lit(False)))
    block = F.shiftright("input_index", 16)
    sizes = rest.groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select("block", F.coalesce(F.sum("size").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("block").orderBy("input_index")) - 1 + F.col("before")
    return rest.withColumn("block", block).join(before, "block").withColumn("input_index", place.cast("long")).drop("block", "before"), gone
