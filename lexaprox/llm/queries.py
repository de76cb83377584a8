"""The queries of this subpackage with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, licences, mixing, neardup, urlrules
from .ann import nearest_neighbours
from .decontam import decontaminate
from .langid import identify
from .licences import known_digests, scan_licences
from .linededup import dedup_lines
from .lm import score_texts
from .mixing import mix_sources
from .neardup import near_duplicates
from .quality import quality_scores
from .urlrules import judge_urls, rules_frame


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores from preference pairs of labelled documents."""
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log10 probability of each text by a causal self-attention model."""
    return score_texts(_table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with at least 85 % of common 5-word shingles."""
    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op1_balanced_postings_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors of largest inner product, of every twentieth vector."""
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.filter("vec_id % 20 = 0"), 20)


def op5_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence that a document's whole text is."""
    return scan_licences(_table(spark, sf_dir, "documents"), known_digests(spark))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources mixed to the weights 1, 2, 3."""
    return mix_sources(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated runs of lines."""
    return dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents in 10-word spans of benchmark items."""
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each text."""
    return identify(_table(spark, sf_dir, "documents"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest rule of each url."""
    return judge_urls(_table(spark, sf_dir, "pages"), rules_frame(spark))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_balanced_postings_ann, op2_pairwise_quality, op3_attention_lm, op4_minhash_near_dedup, op5_licence_digests, op6_source_mixing, op7_line_dedup, op8_winnowing_decontamination, op9_language_id, op10_url_rules]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op4_minhash_near_dedup": neardup.SQL, "op5_licence_digests": licences.SQL, "op6_source_mixing": mixing.SQL, "op8_winnowing_decontamination": decontam.SQL, "op10_url_rules": urlrules.SQL}
