"""Incremental upkeep with Structured Streaming: counters, deduplicated intake, outbox drain, change feeds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def counters(events: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Running calls and sums by key, for update mode (memory grows with the keys, not with the events)."""
    return events.groupBy(*keys).agg(F.count("*").alias("calls"), F.sum(value).alias("total"))


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Counts of time windows; events later than `late` behind the newest are dropped with their state."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("start"), *keys, "n"
    )


def new_rows(events: DataFrame, ident: str, time: str, late: str) -> DataFrame:
    """Each id once within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([ident])


def drain(outbox: DataFrame, handle: Callable[[DataFrame], DataFrame], done: str, checkpoint: str) -> StreamingQuery:
    """Handle the rows of an outbox in micro-batches and write the results under `done`, a folder per batch.

    A batch that is run again after a failure replaces its own folder, so each row's result is there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        handle(batch).write.mode("overwrite").parquet(f"{done}/batch={number}")

    return outbox.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def since(changes: DataFrame, sequence: str, seen: int) -> DataFrame:
    """Changes after a watermark in their sequence."""
    return changes.where(F.col(sequence) > seen)


def outcomes(batch: DataFrame, memories: DataFrame, vectors: DataFrame, most: int = 5) -> DataFrame:
    """memory_id, outcome, attempts, vector: what becomes of the rows of an outbox (memory_id, attempts).

    memories: id; vectors: memory_id, vector: what the model gave, for as many as it could, so that one failure does not fail the others.
    A row that was tried `most` times is abandoned, one whose memory is gone orphaned (both leave the outbox), one with a vector succeeded, any
    other failed; that counts as an attempt, and it stays.
    """
    there = memories.select(F.col("id").alias("memory_id"), F.lit(True).alias("there")).distinct()
    met = batch.join(there, "memory_id", "left").join(vectors, "memory_id", "left")
    outcome = (
        F.when(F.col("attempts") >= most, "abandoned").when(F.col("there").isNull(), "orphaned").when(F.col("vector").isNotNull(), "succeeded").otherwise("failed")
    )
    done = F.col("outcome") == "succeeded"
    counted = F.when(F.col("outcome") == "failed", F.col("attempts") + 1).otherwise(F.col("attempts"))
    return met.withColumn("outcome", outcome).select("memory_id", "outcome", counted.alias("attempts"), F.when(done, F.col("vector")).alias("vector"))
