"""Dictionaries, typo pairs and hits as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of the files of a path: each file's lines in their order,
    which Spark keeps within a file that is read as a whole; files by name."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.expr("split(value, '\n')").alias("lines"))
    each = whole.select("file", F.expr("IF(element_at(lines, -1) = '', slice(lines, 1, size(lines) - 1), lines)").alias("lines"))
    sizes = each.select("file", F.size("lines").alias("size"))
    before = sizes.select("file", F.coalesce(F.sum("size").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return each.join(before, "file").select("before", F.posexplode("lines").alias("at", "line")).select((F.col("before") + F.col("at")).cast("long").alias("line_no"), F.regexp_replace("line", "\r$", "").alias("line"))


def parse_terms(lines: DataFrame) -> DataFrame:
    """(input_index, term, weight) of lines (line_no, line) `term[TAB weight]`.

    Both are trimmed; without a tab the weight is 0. Lines without a term, or with
    a weight that is none from 0 to 65535, are left out."""
    cut = lines.select("line_no", F.trim(F.split_part("line", F.lit("\t"), F.lit(1))).alias("term"), F.when(F.contains("line", F.lit("\t")), F.trim(F.substr("line", F.locate("\t", F.col("line")) + 1))).otherwise("0").alias("w"))
    kept = cut.withColumn("weight", F.when(F.col("w").rlike(r"^\+?[0-9]{1,9}$"), F.expr("try_cast(w AS INT)"))).filter("term <> '' AND weight BETWEEN 0 AND 65535")
    return kept.select(F.col("line_no").alias("input_index"), "term", "weight")


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    return parse_terms(numbered_lines(spark, path))


def read_terms_strict(spark: SparkSession, path: str) -> DataFrame:
    """(input_index, term, weight); a line that is not `term TAB weight` fails."""
    cut = numbered_lines(spark, path).withColumn("p", F.split("line", "\t"))
    good = (F.size("p") == 2) & F.element_at("p", -1).rlike("^[0-9]{1,5}$")
    weight = F.when(good, F.element_at("p", 2).cast("int"))
    failed = F.raise_error(F.concat(F.lit("malformed line "), F.col("line_no") + 1))
    return cut.select(F.col("line_no").alias("input_index"), F.element_at("p", 1).alias("term"), F.when(weight <= 65535, weight).otherwise(failed.cast("int")).alias("weight"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(typo, right) of lines `typo TAB right`."""
    return spark.read.csv(path, sep="\t", schema="typo string, right string", mode="FAILFAST", quote="")


def read_slips(spark: SparkSession, path: str) -> DataFrame:
    """Finger slips with a header and six columns."""
    return spark.read.csv(path, sep="\t", header=True, schema="typo string, correct string, category string, first int, count long, users long", mode="FAILFAST", quote="")


def parse_blocks(lines: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(typo, right) of blocks: `$word`, then its misspellings, a line each. Words
    of three small letters or more, the right one a term, the typo none."""
    parts = 1024
    # The last heading before each line: within parts of the lines, then over the parts.
    head = F.when(F.startswith("line", F.lit("$")), F.lower(F.trim(F.substr("line", F.lit(2)))))
    dealt = lines.withColumn("head", head).withColumn("part", F.floor(F.col("line_no") / parts))
    last = dealt.groupBy("part").agg(F.max_by("head", F.when(F.col("head").isNotNull(), F.col("line_no"))).alias("h"))
    carried = last.select("part", F.last("h", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    within = F.last("head", ignorenulls=True).over(Window.partitionBy("part").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    pairs = dealt.withColumn("own", within).join(carried, "part").filter("head IS NULL").select(F.lower(F.trim("line")).alias("typo"), F.coalesce("own", "carried").alias("right"))
    good = pairs.filter("typo RLIKE '^[a-z]{3,}$' AND right RLIKE '^[a-z]{3,}$' AND typo <> right").distinct()
    terms = dictionary.select("norm")
    return good.join(terms, good["right"] == terms["norm"], "left_semi").join(terms, good["typo"] == terms["norm"], "left_anti")


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(term, n) of the words of small letters in lower-cased texts."""
    words = F.explode(F.regexp_extract_all(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("[a-z]+"), F.lit(0)))
    return texts.select(words.alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def log_weights(counts: DataFrame) -> DataFrame:
    """(term, weight): counts on a logarithmic scale up to 65535."""
    most = counts.agg(F.max("n").alias("most"))
    return counts.crossJoin(F.broadcast(most)).select("term", F.round(65535 * F.log1p("n") / F.log1p("most")).cast("int").alias("weight"))


def sized_dictionary(weights: DataFrame, targets: DataFrame, size: int | None) -> DataFrame:
    """The heaviest terms, `size` in all, with every target (term) among them."""
    wanted = weights.join(targets.select("term").distinct(), "term", "left_semi").withColumn("first", F.lit(0))
    rest = weights.join(targets.select("term").distinct(), "term", "left_anti").withColumn("first", F.lit(1))
    every = wanted.union(rest).orderBy("first", F.desc("weight"), "term")
    return (every if size is None else every.limit(size)).drop("first")


def keystroke_slips(sentences: DataFrame) -> DataFrame:
    """(typo, correct, count, users) from typed sentences (user, layout, keyboard,
    language, expected, typed): English QWERTY typists on full keyboards, the same
    number of words, words that differ and hold letters only."""
    some = sentences.filter("layout = 'qwerty' AND keyboard IN ('full', 'laptop') AND language = 'en'")
    words = lambda c: F.transform(F.filter(F.split(c, " "), lambda w: w != ""), lambda w: F.lower(F.regexp_replace(w, r"^\p{Punct}+|\p{Punct}+$", "")))
    both = some.select("user", words("typed").alias("a"), words("expected").alias("b")).filter("size(a) = size(b)")
    pairs = both.select("user", F.explode(F.arrays_zip("a", "b")).alias("p")).select("user", F.col("p.a").alias("typo"), F.col("p.b").alias("correct"))
    return pairs.filter("typo <> correct AND typo RLIKE '^[a-z]+$' AND correct RLIKE '^[a-z]{3,}$'").groupBy("typo", "correct").agg(F.count(F.lit(1)).alias("count"), F.count_distinct("user").alias("users"))


def result_lines(hits: DataFrame) -> DataFrame:
    """(qid, lines): a query's hits as `term TAB cost TAB weight`, best first, after
    a line with their number and 0 (nothing is ever cut short)."""
    line = F.struct("rank", F.concat_ws("\t", "term", "cost", "weight").alias("line"))
    rows = F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"])
    return hits.groupBy("qid").agg(F.concat(F.array(F.concat_ws("\t", F.count(F.lit(1)).cast("string"), F.lit("0"))), rows).alias("lines"))


def write_result_lines(hits: DataFrame, path: str) -> None:
    result_lines(hits).select(F.array_join("lines", "\n").alias("value")).write.text(path)
