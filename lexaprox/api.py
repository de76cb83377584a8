"""A dictionary as an object, searched by one query or by a table of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.costs import CostModel
from .operators.dictionary import build
from .operators.highlight import highlight
from .operators.search import SearchConfig, search_text


class Index:
    """items: (term, weight) pairs, or a DataFrame (input_index, term, weight)."""

    def __init__(self, items, *, fold_case: bool = True, fold_diacritics: bool = True, spark: SparkSession | None = None, layout: str = "qwerty"):
        if not isinstance(items, DataFrame):
            spark = spark or SparkSession.getActiveSession()
            rows = [(i, t, w) for i, (t, w) in enumerate(items)]
            items = spark.createDataFrame(rows, "input_index long, term string, weight int")
        self.spark, self.fold, self.cost_model = items.sparkSession, {"fold_case": fold_case, "fold_diacritics": fold_diacritics}, CostModel(layout)
        self.dictionary = build(items, **self.fold).cache()

    def __len__(self) -> int:
        return self.dictionary.count()

    def search(self, query: str | DataFrame, k: int | None = None, budget: int | None = None, ranking: str | None = None, *, config: SearchConfig | None = None, prefix: bool = False):
        """Hits of a DataFrame (qid, q) as a DataFrame, of a string as a list of rows."""
        one = isinstance(query, str)
        asked = self.spark.createDataFrame([(0, query)], "qid long, q string") if one else query
        settings = (config or SearchConfig()).merged(k=k, budget=budget, ranking=ranking)
        hits = search_text(asked, self.dictionary, settings, self.cost_model, prefix=prefix, **self.fold)
        return sorted(hits.collect(), key=lambda r: r["rank"]) if one else hits

    def search_prefix(self, query: str | DataFrame, **kw):
        return self.search(query, prefix=True, **kw)

    def highlight(self, queries: DataFrame, hits: DataFrame, prefix: bool = False) -> DataFrame:
        """hits with a column `highlight` over their source text."""
        both = hits.join(queries.select("qid", "q"), "qid")
        return both.withColumn("highlight", highlight(F.col("q"), F.col("term"), F.col("norm"), F.col("cost"), self.cost_model, prefix, normalized_query=True, **self.fold))
