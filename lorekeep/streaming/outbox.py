"""An outbox kept as two logs: what came in, and what became of it; the oldest rows are taken first.

Each batch has a folder of its own in either log, and reads only those of earlier batches. A batch that is run again after a failure replaces its
folders, so every row's outcome is there once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorekeep.operators.rows import settled
from lorekeep.streaming.feeds import outcomes

LEFT = ("abandoned", "orphaned", "succeeded")


class Outbox:
    """memory_id and enqueued_at of rows that wait for vectors, under `path`. size: rows that a drain takes; most: attempts that a row has."""

    def __init__(self, spark: SparkSession, path: str, size: int = 1000, most: int = 5):
        self.spark, self.path, self.size, self.most = spark, path, size, most

    def _log(self, name: str, schema: str, before: int | None) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        store = folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not store.exists(folder):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.path}/{name}")
        return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch")

    def waiting(self, before: int | None = None) -> DataFrame:
        """memory_id, enqueued_at, attempts of what is still in the outbox; a row that came twice is there once."""
        came = self._log("came", "memory_id long, enqueued_at timestamp", before).groupBy("memory_id").agg(F.min("enqueued_at").alias("enqueued_at"))
        done = self.results(before).groupBy("memory_id").agg(F.max("attempts").alias("attempts"), F.bool_or(F.col("outcome").isin(*LEFT)).alias("left"))
        met = came.join(done, "memory_id", "left").where(~F.coalesce("left", F.lit(False)))
        return met.select("memory_id", "enqueued_at", F.coalesce("attempts", F.lit(0)).alias("attempts"))

    def results(self, before: int | None = None) -> DataFrame:
        """memory_id, outcome, attempts, vector of all batches."""
        return self._log("done", "memory_id long, outcome string, attempts int, vector array<double>", before)

    def enqueue(self, rows: DataFrame, batch: int) -> None:
        rows.select("memory_id", "enqueued_at").write.mode("overwrite").parquet(f"{self.path}/came/batch={batch}")

    def drain(self, memories: DataFrame, embed: Callable[[DataFrame], DataFrame], batch: int) -> None:
        """Take the oldest rows that wait, and write what becomes of them (see `feeds.outcomes`); embed gives memory_id, vector for rows (memory_id).

        Rows that are not tried again, for their attempts or as their memory is gone, are not embedded.
        """
        oldest = settled(self.waiting(before=batch).orderBy("enqueued_at", "memory_id").limit(self.size).select("memory_id", "attempts"))
        known = memories.select(F.col("id").alias("memory_id")).distinct()
        asked = oldest.where(F.col("attempts") < self.most).join(known, "memory_id", "left_semi").select("memory_id")
        found = outcomes(oldest, memories, embed(asked), self.most)
        found.select("memory_id", "outcome", F.col("attempts").cast("int").alias("attempts"), "vector").write.mode("overwrite").parquet(f"{self.path}/done/batch={batch}")


def follow(outbox: Outbox, arrivals: DataFrame, memories: Callable[[], DataFrame], embed: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Drain the outbox once for each micro-batch of arrivals (memory_id, enqueued_at), which are enqueued after that. memories gives those that there are now."""

    def step(batch: DataFrame, number: int) -> None:
        outbox.drain(memories(), embed, number)
        outbox.enqueue(batch, number)

    return arrivals.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
