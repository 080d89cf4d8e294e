"""Shards of near equal size from indivisible groups, by Karmarkar-Karp differencing.

Groups of documents with equal texts stay together. Groups of at least 1 / BUNDLES of all bytes (fewer than BUNDLES, then)
are items of their own; lighter ones are first gathered, by a hash, into BUNDLES bundles. So what is differenced has a
bound whatever the input. Each item starts as a partial partition (its size and otherwise empty shards); the two of largest spread
are combined, the fullest shards of one with the emptiest of the other, until one partition is left. Documents learn their
shard from broadcast items and are not shuffled for it; their numbers within a shard come from one order by ranges.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import ranked, stash, whole_text

#: Bundles of light groups. Two times so many items are the most that are differenced.
BUNDLES = 4096


def differenced(sizes: Sequence[int], shards: int) -> list[int]:
    """A shard (0 to shards - 1) for each size, by largest differencing; equal spreads are taken in the order they arose.

    The fullest shard is 0. No sizes give no shards; zero sizes are allowed.
    """
    # A partition is its shards' sums less the least of them, fullest first, and how it came about: an item's
    # number, or two partitions with the second's shard that went to each of the first's. `places` follow the sums.
    heap = [(-size, i, (size, *(0,) * (shards - 1)), i) for i, size in enumerate(sizes)] if shards > 1 else []
    if not heap:
        return [0] * len(sizes)
    heapq.heapify(heap)
    made: list[tuple[int, int, tuple[int, ...]]] = []
    while len(heap) > 1:
        _, _, first, a = heapq.heappop(heap)
        _, _, second, b = heapq.heappop(heap)
        sums = [x + y for x, y in zip(first, reversed(second))]
        places = sorted(range(shards), key=sums.__getitem__, reverse=True)
        least = sums[places[-1]]
        made.append((a, b, tuple(places)))
        at = len(sizes) + len(made) - 1
        heapq.heappush(heap, (least - sums[places[0]], at, tuple(sums[p] - least for p in places), at))
    out = [0] * len(sizes)
    names: dict[int, list[int]] = {heap[0][3]: list(range(shards))}  # of a partition's shards, in its order
    for at in range(len(sizes) + len(made) - 1, len(sizes) - 1, -1):
        a, b, places = made[at - len(sizes)]
        own, first = names.pop(at), [0] * shards
        for name, place in zip(own, places):
            first[place] = name
        names[a], names[b] = first, first[::-1]
    for i in range(len(sizes)):
        out[i] = names[i][0]
    return out


def items(groups: DataFrame, bundles: int = BUNDLES) -> DataFrame:
    """digest (of a heavy group) or bundle (of light ones), bytes; of groups (digest, bytes), settled. No groups, no items."""
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    heavy = F.col("bytes") * bundles >= total
    own = groups.where(heavy).select("digest", F.lit(None).cast("long").alias("bundle"), "bytes")
    light = groups.where(~heavy).groupBy(F.pmod(F.xxhash64("digest"), F.lit(bundles)).alias("bundle")).agg(F.sum("bytes").alias("bytes"))
    return own.unionByName(light, allowMissingColumns=True)


def assign(rows: DataFrame, shards: int, bundles: int = BUNDLES) -> DataFrame:
    """rows (digest, size and others) with `shard`; rows of equal digest share one."""
    groups = stash(rows.groupBy("digest").agg(F.sum("size").alias("bytes")))
    # At most 2 * bundles rows; the order makes the result the same whatever the partitioning.
    found = items(groups, bundles).orderBy(F.desc("bytes"), "bundle", "digest").collect()
    dealt = differenced([r.bytes for r in found], shards)
    spark = rows.sparkSession
    own = [(bytes(r.digest), s) for r, s in zip(found, dealt) if r.digest is not None]
    rest = [(r.bundle, s) for r, s in zip(found, dealt) if r.digest is None]
    heavy = spark.createDataFrame(own, "digest binary, heavy int")
    light = spark.createDataFrame(rest, "bundle long, light int")
    marked = rows.join(F.broadcast(heavy), "digest", "left").withColumn("bundle", F.pmod(F.xxhash64("digest"), F.lit(bundles)))
    marked = marked.join(F.broadcast(light), "bundle", "left")
    return marked.withColumn("shard", F.coalesce("heavy", "light")).drop("bundle", "heavy", "light")


def shard(docs: DataFrame, shards: int = 16, bundles: int = BUNDLES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot.

    size is the text's UTF-8 bytes plus one (null: one; null and empty texts are equal). Equal texts share a shard. slot numbers
    the rows of a shard from 0 without gaps, by doc_id (null first), rows of equal doc_id in the order they were read. A group
    of over 1 / shards of all bytes makes its shard larger than others, as it is not divided. An empty table gives no rows; other
    columns, whatever their names, are ignored.
    """
    said = whole_text(text)
    rows = stash(docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.octet_length(said) + 1).cast("long").alias("size"),
        F.crc32(said.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(said, 256)).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    ))
    placed = ranked(assign(rows, shards, bundles).drop("digest"), ["shard", "doc_id", "row"], "rank", "range")
    starts = placed.groupBy("shard").agg(F.min("rank").alias("start"))  # a row for each shard
    return placed.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("start")).alias("slot"))
