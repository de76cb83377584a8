"""Searching a stream of queries in a fixed dictionary. The top k of a query is a
window without a time, so each micro-batch is searched as a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.costs import CostModel
from ..operators.search import SearchConfig, search


def search_stream(queries: DataFrame, dictionary: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, config: SearchConfig = SearchConfig(), cm: CostModel = CostModel(), prefix: bool = False) -> StreamingQuery:
    """Start a query that hands the hits of each micro-batch of queries (qid, q) to
    sink(hits, batch_id). A sink that overwrites what it wrote for a batch_id makes
    it exactly once."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            sink(search(batch, dictionary, config, cm, prefix), batch_id)
        finally:
            batch.unpersist()

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
