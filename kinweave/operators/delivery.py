"""Sends updates in batches and keeps account of them in shared storage, so that a stopped run goes on where it was.

Each distinct pair of person and content is sent until it is done. What failed is tried again in the next run, who is forbidden is never tried again. A batch counts once its
outcomes are written as a whole; the digest of a row is the key by which a receiver can tell a repeated delivery, as Spark may run a task twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

OUTCOME = "src_id string, digest string, outcome string, reason string"


class Forbidden(Exception):
    """Raised by a sender for someone who must not be tried again."""


def _sending(send: Callable[[dict], None]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                outcome, reason = "done", None
                if row["dst_id"] is None:
                    outcome, reason = "failed", "no profile"
                else:
                    try:
                        send(row)
                    except Forbidden as error:
                        outcome, reason = "skipped", str(error)
                    except Exception as error:  # noqa: BLE001 - whatever a receiver raises is an outcome
                        outcome, reason = "failed", str(error)
                rows.append((row["src_id"], row["digest"], outcome, reason))
            yield pd.DataFrame(rows, columns=["src_id", "digest", "outcome", "reason"])

    return run


class Delivery:
    """path: a shared folder that belongs to one list of updates."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = ship(spark), path.rstrip("/")
        spark.createDataFrame([], OUTCOME).write.mode("ignore").parquet(f"{self.path}/outcomes/run=0/batch=0")

    def outcomes(self) -> DataFrame:
        return self.spark.read.schema(f"{OUTCOME}, run int, batch int").parquet(f"{self.path}/outcomes")

    def state(self) -> DataFrame:
        """src_id, digest, outcome and reason of the last attempt, attempts."""
        last = F.max_by(F.struct("outcome", "reason"), "run")
        return self.outcomes().groupBy("src_id", "digest").agg(last.alias("l"), F.count("*").alias("attempts")).select("src_id", "digest", "l.*", "attempts")

    def pending(self, nodes: DataFrame) -> DataFrame:
        """src_id, dst_id, payload and digest of what is still to be sent. nodes: src_id, dst_id, payload; repeated rows count once."""
        rows = nodes.select(*[F.col(c).cast("string").alias(c) for c in ("src_id", "dst_id", "payload")]).where("src_id is not null")
        rows = rows.withColumn("digest", F.sha2(F.to_json(F.struct("src_id", "dst_id", "payload")), 256)).dropDuplicates(["src_id", "digest"])
        state = self.state()
        return rows.join(state.where("outcome = 'done'").select("src_id", "digest"), ["src_id", "digest"], "left_anti").join(state.where("outcome = 'skipped'").select("src_id"), "src_id", "left_anti")

    def run(self, nodes: DataFrame, send: Callable[[dict], None], batches: int = 8, partitions: int | None = None) -> int:
        """Sends what is pending and returns the number of the run. Rows of a batch are sent by many tasks; `partitions` bounds how many at once, for receivers that limit rates."""
        number = self.outcomes().agg(F.coalesce(F.max("run"), F.lit(0))).first()[0] + 1
        while self._exists(f"queue/run={number}"):
            number += 1
        queue = f"{self.path}/queue/run={number}"
        self.pending(nodes).withColumn("batch", F.pmod(F.xxhash64("src_id", "digest"), F.lit(batches)).cast("int")).repartition("batch", F.pmod(F.xxhash64("digest"), F.lit(64))).write.partitionBy("batch").parquet(queue)
        rows = self.spark.read.schema("src_id string, dst_id string, payload string, digest string, batch int").parquet(queue)
        for batch in range(batches):
            part = rows.where(F.col("batch") == batch).drop("batch")
            part = part.coalesce(partitions) if partitions else part
            part.mapInPandas(_sending(send), OUTCOME).write.parquet(f"{self.path}/outcomes/run={number}/batch={batch}")
        return number

    def finished(self) -> bool:
        """Nothing failed; the folder can go."""
        return not self.state().where("outcome = 'failed'").limit(1).count()

    def clear(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _exists(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
