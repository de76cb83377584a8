"""From raw documents to a training mix: a chain of five corpus operators.

Each stage takes (spark, docs, sf_dir), docs being what its predecessor kept,
and returns the columns of documents; the last one also says how many words the
mix takes of each. run() writes each stage's rows to the shared folder and reads
them again as the next one's docs. A stage's input can be empty; nulls are
treated as its operator says. Decisions are made by row: rows with one doc_id
and different texts are different documents, and so are rows with a null doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexaprox.llm._shared import materialize, release
from lexaprox.llm.decontam import decontaminate
from lexaprox.llm.linededup import dedup_lines
from lexaprox.llm.mixing import mix_sources
from lexaprox.llm.neardup import near_duplicates
from lexaprox.llm.quality import score_quality, train

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on all labels, accepts."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs.select(*COLUMNS), model).filter("score >= 0.5").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated runs of lines; a document of which
    nothing is left goes."""
    out = dedup_lines(docs.select(*COLUMNS)).filter(r"n_removed = 0 OR text RLIKE '\\S'")
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest
    (doc_id, hash of the text), null ids last; of its repeated rows the first in
    the order of the other columns. Texts without words are in no group and stay."""
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_at"), F.col("doc_id").isNull().alias("_no")]
    first = near_duplicates(docs, percent=80).filter("first").select(*key, F.col("text_hash").alias("_h"), (F.col("n_shingles") > 0).alias("_words")).distinct()
    both = docs.select(*COLUMNS, *key, F.xxhash64("text").alias("_h")).join(first.hint("merge"), ["_at", "_no", "_h"])
    turn = F.row_number().over(Window.partitionBy("_at", "_no", "_h").orderBy("lang", "source", "n_chars"))
    return both.withColumn("_turn", turn).filter("_turn = 1 OR NOT _words").select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a span of a benchmark item, each row judged for itself."""
    judged = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=COLUMNS)
    return judged.filter("NOT contaminated").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix: taken words, repeats counted, of each row."""
    return mix_sources(docs, keep=COLUMNS).filter("taken > 0").select("row.*", "taken", "target")


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near), ("decontamination", decontaminated), ("mixing", mixed)]
#: The quality stage learns a model, which SQL can't express; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        release(before)
    return docs
