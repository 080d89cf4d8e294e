"""Exact deduplication with a heavy-hitter split, in DataFrame operations only.

A Misra-Gries summary (the counter map behind Spark's ``approx_top_k``, kept per task and merged) proposes
the digests that may be frequent. Their exact counts are then taken, and those that do hold at least
1 / HEAVY_SHARE of all rows are the winners: at most HEAVY_SHARE rows, so broadcasting them is safe at any
input size. Rows of a winner are settled on the map side; all others meet by an ordinary shuffle, where no
group can exceed that share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import BLANK, HOT as HEAVY_SHARE, own_name, stash, whole_text, without

#: Counters of the summary. Its error is below 3.5 / TRACKED of the rows, so no heavy digest escapes it.
TRACKED = 10_000


def text_digest(text: Column) -> Column:
    """SHA-256, as 32 bytes, of the text with each run of white space made one space."""
    return F.unhex(F.sha2(F.regexp_replace(text, BLANK, " "), 256))


def heavy_digests(rows: DataFrame) -> DataFrame:
    """digest, keep_id, group_size of the digests that hold over 1 / HEAVY_SHARE of the rows (doc_id, digest)."""
    summary = rows.agg(
        F.expr(f"approx_top_k(xxhash64(digest), {HEAVY_SHARE}, {TRACKED})").alias("top"), F.count("*").alias("n")
    )
    candidates = summary.select("n", F.explode("top.item").alias("h"))
    return (
        rows.withColumn("h", F.xxhash64("digest"))
        .join(F.broadcast(candidates), "h")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.first("n").alias("n"))
        .where((F.col("group_size") > 1) & (F.col("group_size") * HEAVY_SHARE > F.col("n")))
        .drop("n")
    )


def groups(rows: DataFrame, winners: DataFrame) -> DataFrame:
    """Settle rows (doc_id, digest) by the heavy digests' winners: adds keep_id and group_size."""
    winners = F.broadcast(winners)
    settled = rows.join(winners, "digest")
    rest = rows.join(winners, "digest", "left_anti")
    light = rest.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return settled.unionByName(rest.join(light, "digest"))


def duplicate_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest.

    Null texts are empty texts; a null doc_id orders after all others, so it is kept only in a group without
    any id. Rows that repeat the smallest id of their group are one document listed again and are all marked
    kept (`deduplicate` leaves one of them). An empty table gives an empty table. Other columns are ignored.
    """
    rows = stash(docs.select(F.col(doc_id).alias("doc_id"), text_digest(whole_text(text)).alias("digest")))
    return groups(rows, stash(heavy_digests(rows))).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"
    )


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that stay, one of each group of equal texts, with the columns of docs.

    Cases are as in `duplicate_groups`. Rows of a heavy digest that do not stay go on the map side, by the broadcast
    winners. Of all others, only rows of groups of two or more (and a few that a bitmap cannot tell from them) are shuffled.
    """
    digest, keep, own = (own_name(docs, x) for x in ("digest", "keep", "own"))
    rows = stash(docs.select(F.col(doc_id).alias("doc_id"), text_digest(whole_text(text)).alias("digest")))
    winners = stash(heavy_digests(rows))
    few = winners.select(F.col("digest").alias(digest), F.struct("keep_id").alias(keep))
    marked = docs.withColumns({digest: text_digest(whole_text(text)), own: F.col(doc_id)}).join(F.broadcast(few), digest, "left")
    marked = marked.where(F.col(keep).isNull() | F.col(own).eqNullSafe(F.col(f"{keep}.keep_id")))
    settled = groups(rows, winners).where("group_size > 1")
    copies = settled.groupBy("digest", "doc_id", "keep_id").agg(F.count("*").alias("times"))
    goes = ~F.col("doc_id").eqNullSafe(F.col("keep_id"))
    light = copies.join(F.broadcast(winners.select("digest")), "digest", "left_anti").where(goes)
    again = copies.where(~goes & (F.col("times") > 1))
    decided = light.withColumn("goes", F.lit(True)).unionByName(again.withColumn("goes", F.lit(False)))
    decided = decided.select(F.col("digest").alias(digest), F.col("doc_id").alias(own), "goes")
    return without(marked, decided, [digest, own]).select(docs.columns)
