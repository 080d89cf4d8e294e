"""The recall query: many questions answered in one batch of channels, fusion and collapse."""

from __future__ import annotations

import datetime
from enum import Enum
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import text
from lorekeep.functions import vectors as vector
from lorekeep.operators import graph, search
from lorekeep.operators.rows import Snapshot, settled

CHANNEL_LIMIT = 10
#: Share of the best score at which a cluster comes in by its claims.
INJECTED = 0.85


class Mode(Enum):
    """How far a recall goes: hits as fused; collapsed as well; or those laid out as the context for a model's answer."""

    EVIDENCE = "evidence"
    ANALYZED = "analyzed"
    SYNTHESIZED = "synthesized"


def parse_snapshot(as_of: str, known_as_of: str, sequence: int, now: datetime.datetime) -> Snapshot:
    """A snapshot from instants that must name their offset; what was known may not lie in the future."""
    moments = [datetime.datetime.fromisoformat(x.replace("Z", "+00:00")) for x in (as_of, known_as_of)]
    if any(m.tzinfo is None for m in moments):
        raise ValueError("an instant needs an offset")
    if moments[1] > now:
        raise ValueError("known_as_of lies in the future")
    return Snapshot(*(m.astimezone(datetime.UTC).date().isoformat() for m in moments), sequence)


def recall(questions: DataFrame, memories: DataFrame, limit: int = 10, mode: Mode = Mode.ANALYZED) -> DataFrame:
    """query_id, id, score, source, place of the best memories (id, content, topic_key, known) for questions (query_id, said).

    Channels: full text, and exact topic keys by their order in the question, newest first. The limit comes last. For a synthesized
    answer the result is query_id, context: one line for each of the memories, in order.
    """
    asked = questions.select("query_id", text.query_terms(F.col("said")).alias("terms"))
    hits = search.ranked(search.bm25(memories, asked), CHANNEL_LIMIT, [F.desc(F.round("score", 9)), F.col("id")])
    keys = asked.select("query_id", F.posexplode(text.topic_keys(F.col("terms"))).alias("place", "topic_key"))
    exact = memories.where("topic_key IS NOT NULL").select("id", "topic_key", "known").join(keys, "topic_key")
    exact = search.ranked(exact, CHANNEL_LIMIT, [F.col("place"), F.desc("known"), F.col("id")])
    fused = search.fuse(search.channel(hits, "fts").unionByName(search.channel(exact, "exact")))
    if mode is not Mode.EVIDENCE:
        listed = search.ranked(fused, 2 * CHANNEL_LIMIT, [F.desc(F.round("score", 12)), F.col("id")])
        held = listed.join(memories.select("id", "content"), "id")  # few rows; shingles are made of those alone
        fused = search.collapse(held.withColumn("shingles", text.shingles(F.col("content"))).drop("content")).drop("rank")
    top = search.ranked(fused, limit, [F.desc(F.round("score", 12)), F.col("id")])
    found = top.select("query_id", "id", "score", "source", F.col("rank").alias("place"))
    return context(found, memories) if mode is Mode.SYNTHESIZED else found


def fused(channels: dict[str, DataFrame]) -> DataFrame:
    """query_id, id, score, source: the channels' hits (query_id, id, rank), by name, fused with the channels' weights."""
    return search.fuse(reduce(DataFrame.unionByName, (search.channel(hits, name) for name, hits in channels.items())))


def context(hits: DataFrame, memories: DataFrame, most: int = 200) -> DataFrame:
    """query_id, context: a query's hits (query_id, id, place), a top-k list, as lines of at most `most` characters of their texts."""
    said = F.trim(F.regexp_replace("content", r"\s+", " "))
    line = F.concat(F.lit("- "), F.when(F.length(said) > most, F.concat(F.left(said, F.lit(most)), F.lit("…"))).otherwise(said))
    lines = hits.join(memories.select("id", "content"), "id").select("query_id", F.struct("place", line.alias("line")).alias("x"))
    laid = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n")
    return lines.groupBy("query_id").agg(laid.alias("context"))


def rerank_by_label(hits: DataFrame) -> DataFrame:
    """Hits (query_id, id, rank, label) with essential ones first, then related ones, in rank order; the others go.

    A query without any essential or related hit keeps its hits as they were.
    """
    useful = F.col("label").isin("essential", "related")
    some = hits.groupBy("query_id").agg(F.bool_or(useful).alias("some"))
    bucket = F.when(F.col("label") == "essential", 0).when(F.col("label") == "related", 1).otherwise(2)
    kept = hits.join(some, "query_id").where(~F.col("some") | useful)
    order = [F.when(F.col("some"), bucket).otherwise(0), F.col("rank")]
    return search.ranked(kept.withColumnRenamed("rank", "old").withColumn("rank", F.col("old")), 1 << 30, order).select("query_id", "id", "rank")


def complementary(candidates: DataFrame, coverage: DataFrame) -> DataFrame:
    """query_id, id, action, place: which of a query's hits add evidence to those before them.

    candidates: query_id, id, rank (each once), cluster (whether the hit is a summary of others); coverage: query_id, id, source, the
    originals that a summary's claims cover for the query. An original stands for itself. In rank order, a hit is `selected` if any of its
    originals is not represented yet, else `suppressed`; summaries without coverage come last, in rank order (`fallback`). place numbers what is listed.

    What a suppressed hit has is represented already, so an original is represented from the first rank on that has it, selected or not: one
    minimum for each, and no pass in order.
    """
    own = candidates.where("NOT cluster").select("query_id", "id", "rank", F.col("id").alias("source"))
    told = candidates.where("cluster").select("query_id", "id", "rank").join(coverage.select("query_id", "id", "source").distinct(), ["query_id", "id"])
    evidence = own.unionByName(told)
    first = evidence.groupBy("query_id", "source").agg(F.min("rank").alias("first"))
    new = evidence.join(first, ["query_id", "source"]).groupBy("query_id", "id", "rank").agg(F.bool_or(F.col("first") == F.col("rank")).alias("new"))
    met = candidates.join(new, ["query_id", "id", "rank"], "left")
    action = F.when(F.col("new"), "selected").when(F.col("new").isNull(), "fallback").otherwise("suppressed")
    listed = F.when(F.col("action") != "suppressed", F.struct(F.col("action") == "fallback", "rank"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("listed").asc_nulls_last()))  # of a top-k list
    found = met.withColumn("action", action).withColumn("listed", listed)
    return found.select("query_id", "id", "action", F.when(F.col("listed").isNotNull(), place).cast("long").alias("place"))


def spread(first: DataFrame, edges: DataFrame, seeds: int, depth: int, fanout: int, named: DataFrame | None = None) -> DataFrame:
    """query_id, id, hop: memories by how near their edges come to the entities that a question names (named: query_id, entity) and those of a first
    wave's best `seeds` hits (query_id, id, rank); of either, the first `seeds` that there are, by name.

    edges have a column memory, the id of the memory that tells of them.
    """
    ends = edges.select("memory", F.explode(F.array("source", "target")).alias("entity"))
    best = first.where(F.col("rank") <= seeds).select("query_id", F.col("id").alias("memory"))
    from_hits = search.ranked(ends.join(best, "memory").select("query_id", "entity").distinct(), seeds, [F.col("entity")])
    start = from_hits.select("query_id", "entity")
    if named is not None:
        known = named.distinct().join(ends.select("entity").distinct(), "entity", "left_semi")
        start = start.unionByName(search.ranked(known, seeds, [F.col("entity")]).select("query_id", "entity"))
    around = graph.walk(edges, start, depth, fanout)
    return ends.join(around, "entity").groupBy("query_id", F.col("memory").alias("id")).agg(F.min("hop").alias("hop"))


def code_graph(
    first: DataFrame, payloads: DataFrame, names: DataFrame, symbols: DataFrame, edges: DataFrame, known: DataFrame, seeds: int = 8, depth: int = 1, fanout: int = 20, limit: int = 10
) -> tuple[DataFrame, DataFrame]:
    """What the graph of code says of questions: memories (query_id, id, rank), and lines of evidence (query_id, line, rank).

    first: query_id, id, rank, the first wave's hits; payloads: id, symbols (an array); names: query_id, name, what a question names; symbols: symbol, name;
    edges: source, target, relation, sure (whether the target is resolved), of the confidence that is asked for; known: id, created, symbols of the memories that may be found.
    A walk begins at the symbols that the question names, `seeds` at most, and at those in the hits' payloads, in rank order, until four times as many are
    found. Lines come from the edges at the named symbols, or at all seeds where none is named: sure ones first, then by relation, source and target.
    """
    met = names.distinct().join(symbols, "name").select("query_id", "symbol").distinct()
    named = settled(search.ranked(met, seeds, [F.col("symbol")]).select("query_id", F.col("symbol").alias("entity"), F.lit(0).alias("at"), F.lit(0).alias("spot")))
    told = first.join(payloads, "id").select("query_id", F.col("rank").alias("at"), F.posexplode("symbols").alias("spot", "entity"))
    every = named.unionByName(told.select("query_id", "entity", "at", "spot")).groupBy("query_id", "entity").agg(F.min(F.struct("at", "spot")).alias("x"))
    start = settled(search.ranked(every, 4 * seeds, [F.col("x"), F.col("entity")]).select("query_id", "entity"))
    unnamed = start.join(named.select("query_id").distinct(), "query_id", "left_anti")
    asked = named.select("query_id", "entity").unionByName(unnamed)
    ends = F.explode(F.array_distinct(F.array("source", F.coalesce("target", "source")))).alias("entity")
    touching = edges.select("*", ends).join(asked, "entity").select("query_id", "source", "relation", "target", "sure").distinct()
    order = [F.desc("sure"), F.col("relation"), F.col("source"), F.col("target")]
    line = F.concat("source", F.lit(" -"), "relation", F.lit("-> "), F.coalesce("target", F.lit("?")))
    lines = search.ranked(touching, fanout, order).select("query_id", line.alias("line"), "rank")
    reached = graph.symbol_walk(edges, start, depth, fanout)
    held = known.select("id", "created", F.explode("symbols").alias("entity"))
    hits = held.join(reached.select("query_id", "entity"), "entity").select("query_id", "id", "created").distinct()
    return search.ranked(hits, limit, [F.desc("created"), F.col("id")]).select("query_id", "id", "rank"), lines


def claimed_clusters(
    claims: DataFrame, hidden: DataFrame, asked: DataFrame, vectors: DataFrame, asked_vectors: DataFrame, limit: int = 30, cosine: float = 0.78
) -> DataFrame:
    """query_id, cluster, rank: clusters for questions by their claims (cluster, id, content) and the claims' vectors (id, v).

    asked: query_id, terms; asked_vectors: query_id, q; hidden: clusters that are not eligible. Clusters with a claim that has a term come first, by
    their latest claim (the greatest id); then those whose claims are among the nearest vectors and reach the cosine, nearest first. Three
    times `limit` of each are looked at, 300 at most.
    """
    looked = min(300, 3 * limit)
    words = claims.select("cluster", "id", F.explode(F.array_distinct(text.tokens(F.col("content")))).alias("term"))
    met = words.join(asked.select("query_id", F.explode("terms").alias("term")), "term")
    latest = met.groupBy("query_id", "cluster").agg(F.max("id").alias("latest"))
    worded = search.ranked(latest, looked, [F.desc("latest"), F.col("cluster")]).select("query_id", "cluster", F.col("rank").alias("place"))
    near = search.nearest(vectors, asked_vectors, looked).join(vectors, "id").join(asked_vectors, "query_id")
    near = near.where(F.round(vector.cosine(F.col("v"), F.col("q")), 9) >= cosine).join(claims.select("id", "cluster"), "id")
    near = near.groupBy("query_id", "cluster").agg((F.min("rank") + 1000).alias("place"))
    both = worded.unionByName(near).groupBy("query_id", "cluster").agg(F.min("place").alias("place"))
    open_ = both.join(hidden.select("cluster").distinct(), "cluster", "left_anti")
    return search.ranked(open_, limit, [F.col("place"), F.col("cluster")]).select("query_id", "cluster", "rank")
