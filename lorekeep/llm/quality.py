"""Quality selection by importance resampling.

Two generative models over hashed word n-grams, one of target text and one of all text, give each document a
log importance weight: the sum of its n-grams' log likelihood ratios. Adding Gumbel noise and keeping the k
largest draws k documents without replacement in proportion to the weights.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import slices, stash, whole_text

PIECE = regex.compile(r"\w+|[^\w\s]+")
#: Bins of one pass of the search for the k-th key; rows it may end with.
BINS, ENOUGH = 1024, 10_000


@dataclass(frozen=True)
class Settings:
    """sample: the most labelled documents that the target model takes, those of smallest hash. smooth is added
    to every count; keep is the fraction of the documents that is drawn."""

    buckets: int = 10_000
    sample: int = 10_000
    smooth: float = 1.0
    keep: float = 0.85
    seed: int = 11


@functools.lru_cache(maxsize=200_000)
def _hash(piece: str) -> int:
    return zlib.crc32(piece.encode("utf-8", "surrogatepass"))


def buckets_of(text: str, buckets: int) -> np.ndarray:
    """The bucket of each word and of each pair of neighbours, repeats included."""
    one = np.fromiter(map(_hash, PIECE.findall(text.lower())), np.uint64)
    two = one[:-1] * np.uint64(0x9E3779B1) + one[1:] * np.uint64(0x85EBCA6B)
    two = (two ^ (two >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)
    return np.concatenate([one % np.uint64(buckets), two % np.uint64(buckets)]).astype(np.int64)


def ngram_counts(marked: DataFrame, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each bucket over the target rows and over all rows, from rows (text, target).

    Tasks count into arrays of settings.buckets numbers; only their sums come to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, settings.buckets), np.int64)
        for batch in batches:
            for text, target in zip(batch.column("text"), batch.column("target"), strict=True):
                found = np.bincount(buckets_of(text.as_py(), settings.buckets), minlength=settings.buckets)
                totals[1] += found
                if target.as_py():
                    totals[0] += found
        seen = np.flatnonzero(totals[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen), pa.array(totals[0, seen]), pa.array(totals[1, seen])], ["bucket", "target", "every"]
        )

    sums = marked.mapInArrow(count, "bucket long, target long, every long").groupBy("bucket").agg(
        F.sum("target").alias("target"), F.sum("every").alias("every")
    )
    out = np.zeros((2, settings.buckets), np.int64)
    for row in sums.collect():  # at most settings.buckets rows
        out[:, row.bucket] = row.target, row.every
    return out[0], out[1]


def log_ratios(target: np.ndarray, every: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log of the target model's over the raw model's probability, for each bucket."""
    target, every = target + smooth, every + smooth
    return np.log(target / target.sum()) - np.log(every / every.sum())


def fit(docs: DataFrame, good: DataFrame, settings: Settings = Settings(), text: str = "text", doc_id: str = "doc_id") -> np.ndarray:
    """The ratios for documents against those whose ids (column doc_id of good) are target examples.

    The raw model counts all documents, the target model a bounded sample of the examples. Without examples (or
    documents) all ratios are zero. Null ids are no examples, an id of several rows makes all of them examples, a
    repeated example counts once; an id of no document takes no place among the sample. Null texts are empty; other columns are ignored.
    """
    ids = good.select(F.col(doc_id).alias("_good")).where("_good IS NOT NULL").distinct()
    ids = ids.join(docs.select(F.col(doc_id).alias("_good")).distinct(), "_good", "left_semi")
    ids = ids.orderBy(F.xxhash64(F.lit(settings.seed), "_good"), "_good").limit(settings.sample)
    # At most settings.sample ids, so the join shuffles no text.
    marked = docs.select(F.col(doc_id).alias("_id"), whole_text(text).alias("text")).join(
        F.broadcast(ids), F.col("_id") == F.col("_good"), "left"
    )
    counts = ngram_counts(marked.select("text", F.col("_good").isNotNull().alias("target")), settings)
    if not counts[0].any():
        return np.zeros(settings.buckets)
    return log_ratios(*counts, settings.smooth)


def gumbel(seed: int, *idents: Column) -> Column:
    """Standard Gumbel noise that depends on the seed and the row alone."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *idents), 11).cast("double") + 0.5) / 2.0**53
    return -F.log(-F.log(uniform))


def kth_largest(rows: DataFrame, k: int) -> tuple[float, int] | None:
    """The k-th largest (key, tie) of rows; None for no rows or a k below 1.

    Each pass counts keys in bins of the range that holds the k-th; rows are ordered only once few are left,
    or equal keys keep them together.
    """
    low, high, n = rows.agg(F.min("key"), F.max("key"), F.count("*")).first()
    if k < 1 or not n:
        return None
    part, left = rows, min(k, n)
    while n > ENOUGH and low < high:
        width = (high - low) / BINS
        bin_ = F.least(F.floor((F.col("key") - low) / width), F.lit(BINS - 1)).alias("bin")
        counts = {r.bin: r for r in part.groupBy(bin_).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()}
        for place in sorted(counts, reverse=True):
            if counts[place].n >= left:
                break
            left -= counts[place].n
        before, (n, low, high) = n, (counts[place].n, counts[place].low, counts[place].high)
        part = rows.where(F.col("key").between(low, high))
        if n == before:
            break
    last = part.orderBy(F.desc("key"), F.desc("tie")).limit(left).agg(F.min(F.struct("key", "tie")).alias("x")).first().x
    return last.key, last.tie


def select(
    docs: DataFrame, ratios: np.ndarray, settings: Settings = Settings(), text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """One row per input row: doc_id, n_features, log_weight, log_ratio (the mean), gumbel_key, selected.

    The round(keep * rows) rows of largest key are selected; ties are broken by a hash of id and text, and
    equal rows go together. Null and empty texts have weight zero; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # settings.buckets numbers

    @F.arrow_udf("struct<n: long, log_weight: double>")
    def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in slices(batches):
            found = [shared.value[buckets_of(x.as_py(), settings.buckets)] for x in batch]
            yield pa.StructArray.from_arrays(
                [pa.array([len(f) for f in found], pa.int64()), pa.array([float(f.sum()) for f in found], pa.float64())],
                ["n", "log_weight"],
            )

    plain = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    weighed = plain.select("doc_id", F.xxhash64("doc_id", "text").alias("tie"), weigh("text").alias("w"))
    rows = stash(
        weighed.select("doc_id", "tie", F.col("w.n").alias("n_features"), "w.log_weight").withColumn(
            "key", F.col("log_weight") + gumbel(settings.seed, F.col("tie"))
        )
    )
    last = kth_largest(rows, round(settings.keep * rows.count()))
    chosen = F.lit(False) if last is None else F.struct("key", "tie") >= F.struct(F.lit(last[0]), F.lit(last[1]))
    mean = F.when(F.col("n_features") > 0, F.col("log_weight") / F.col("n_features")).otherwise(0.0)
    return rows.select(
        "doc_id", "n_features", "log_weight", mean.alias("log_ratio"), F.col("key").alias("gumbel_key"), chosen.alias("selected")
    )
