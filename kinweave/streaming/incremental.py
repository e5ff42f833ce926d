"""Incremental linkage: new source people are matched as they arrive, with the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import linkage


def link_stream(arrivals: DataFrame, target: DataFrame, out: str, checkpoint: str, least: float = 60.0) -> StreamingQuery:
    """Write the best matches of each micro-batch of arrivals (people by id, each id once) below `out`.

    A batch has a folder of its own that a repeated attempt overwrites, so each batch counts once.
    """

    def one(batch: DataFrame, number: int) -> None:
        linkage.best_matches(batch.dropDuplicates(["id"]), target, least).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arrivals.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
