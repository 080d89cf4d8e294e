"""Graph walks as bounded loops of joins over edges (source, relation, target, memory_id, sequence)."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators.rows import settled

#: Rows of a frontier up to which it is broadcast to the edges, so that these are not shuffled.
FEW = 10_000
#: Levels of a descent that are kept apart; more are written as one.
APART = 8


def _front(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.limit(FEW + 1).count() <= FEW else rows


def incident(edges: DataFrame) -> DataFrame:
    """Each edge seen from both ends: entity, direction, other, and the edge's columns."""
    ends = F.array(
        F.struct(F.col("source").alias("entity"), F.lit("out").alias("direction"), F.col("target").alias("other")),
        F.struct(F.col("target").alias("entity"), F.lit("in").alias("direction"), F.col("source").alias("other")),
    )
    return edges.select("*", F.explode(ends).alias("x")).select("x.*", *edges.columns)


def neighborhood(edges: DataFrame, seeds: DataFrame, depth: int, fanout: int, follow: Column | None = None) -> DataFrame:
    """entity, hop: entities reached from seeds (column entity, hop 0) within depth, over the edges that `follow` admits.

    `follow` is a condition over entity, direction, relation and other. Each hop follows the `fanout` newest edges of the whole
    frontier (sequence descending, then source, relation and target); an edge to an entity seen before still spends its place.
    """
    one = seeds.select(F.lit(0).alias("query_id"), "entity")
    return walk(edges, one, depth, fanout, follow).select("entity", "hop")


def walk(edges: DataFrame, seeds: DataFrame, depth: int, fanout: int, follow: Column | None = None) -> DataFrame:
    """query_id, entity, hop: the neighbourhoods of many queries' seeds (query_id, entity) at once, each as in `neighborhood`.

    A query's frontier after the seeds has at most `fanout` entities. Each level is checkpointed, so the plan does not grow with depth;
    edges are cut to a query's newest within tasks before they are shuffled.
    """
    both = incident(edges)
    both = both if follow is None else both.where(follow)
    seen = front = settled(seeds.select("query_id", "entity").distinct().withColumn("hop", F.lit(0)))
    order = [F.desc("sequence"), F.col("source"), F.col("relation"), F.col("target"), F.col("direction")]
    for hop in range(1, depth + 1):
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
        met = both.join(_front(front.select("query_id", "entity")), "entity")
        # An edge between two entities of the frontier is met from both, and spends two places as in a union of both ends.
        followed = met.withColumn("_rank", rank).where(F.col("_rank") <= fanout)
        reached = followed.select("query_id", F.col("other").alias("entity")).distinct()
        new = reached.join(seen.select("query_id", "entity"), ["query_id", "entity"], "left_anti")
        front = settled(new.select("query_id", "entity", F.lit(hop).alias("hop")))
        seen = settled(seen.unionByName(front))
    return seen


def symbol_walk(edges: DataFrame, seeds: DataFrame, depth: int, fanout: int) -> DataFrame:
    """query_id, entity, hop: what the seeds (query_id, entity) of each query reach over edges (source, target), whichever way they point.

    A hop takes the first `fanout` names, in their order, of all neighbours of the frontier. A name counts once, however many edges lead to it; one that was
    reached before takes up a place but is not walked from again, so cycles end. Edges without a target lead nowhere. To follow
    edges of some confidence only, give those. Each level is checkpointed, and a frontier after the seeds has `fanout` names at most.
    """
    known = edges.where("target IS NOT NULL").select("source", "target")
    both = known.unionByName(known.select(F.col("target").alias("source"), F.col("source").alias("target")))
    steps = settled(both.select(F.col("source").alias("entity"), F.col("target").alias("next")).distinct())
    seen = front = settled(seeds.select("query_id", "entity").distinct().withColumn("hop", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("next"))
    for hop in range(1, depth + 1):
        met = front.join(steps, "entity").select("query_id", "next").distinct().withColumn("_rank", rank).where(F.col("_rank") <= fanout)
        new = met.select("query_id", F.col("next").alias("entity")).join(seen, ["query_id", "entity"], "left_anti")
        front = settled(new.withColumn("hop", F.lit(hop)))
        seen = settled(seen.unionByName(front))
    return seen


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (column entity)."""
    ends = nodes.select("entity").distinct()
    return edges.join(ends.withColumnRenamed("entity", "source"), "source", "left_semi").join(
        ends.withColumnRenamed("entity", "target"), "target", "left_semi"
    ).select(edges.columns)


def descend(edges: DataFrame, roots: DataFrame, levels: int | None = None) -> DataFrame:
    """root, entity, level: all that is reached along edges from each root (column entity), at its least level.

    Cycles end where an entity was already reached. Without a bound it goes on until nothing new is reached. What a level reached is written once.
    """
    front = settled(roots.select(F.col("entity").alias("root"), "entity", F.lit(0).alias("level")))
    steps = settled(edges.select(F.col("source").alias("entity"), F.col("target").alias("next")).distinct())
    held = [front]
    for level in count(1) if levels is None else range(1, levels + 1):
        step = front.join(steps, "entity").select("root", F.col("next").alias("entity")).distinct()
        reached = reduce(DataFrame.unionByName, held).select("root", "entity")
        front = settled(step.join(reached, ["root", "entity"], "left_anti").select("root", "entity", F.lit(level).alias("level")))
        if front.isEmpty():
            break
        held.append(front)
        held = held if len(held) <= APART else [settled(reduce(DataFrame.unionByName, held))]
    return reduce(DataFrame.unionByName, held)


def ascend(edges: DataFrame, held: DataFrame, levels: int) -> DataFrame:
    """child, parent: the edges (source to target) by which anything held (column entity) is under a parent, within levels.

    Paths that meet go on as one, so a level is at most as large as the edges are.
    """
    steps = settled(edges.select(F.col("source").alias("child"), F.col("target").alias("parent")).distinct())
    front = held.select(F.col("entity").alias("child")).distinct()
    climbed = None
    for _ in range(levels):
        taken = settled(front.join(steps, "child"))
        climbed = taken if climbed is None else climbed.unionByName(taken)
        front = taken.select(F.col("parent").alias("child")).distinct()
    return climbed.distinct()


def resolve(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """references (name, file, ...) with the symbol that each means: one of that name in the same file, else the first anywhere.

    symbols: symbol, name, file. Of several the smallest counts; a name that nothing has resolves to null.
    """
    near = symbols.groupBy("name", "file").agg(F.min("symbol").alias("near"))
    far = symbols.groupBy("name").agg(F.min("symbol").alias("far"))
    met = references.join(near, ["name", "file"], "left").join(far, "name", "left")
    return met.withColumn("symbol", F.coalesce("near", "far")).drop("near", "far")


def redirect_ends(redirects: DataFrame) -> DataFrame:
    """page, canonical: where each redirect (page, to; a page has one at most) ends. A cycle raises ValueError.

    Each round doubles the length of the steps, until none goes further. A chain has no more steps than there
    are redirects, so what still moves after that many rounds goes round in a cycle.
    """
    hops = settled(redirects.select("page", "to"))
    for _ in range(hops.count().bit_length() + 1):
        further = hops.select(F.col("page").alias("to"), F.col("to").alias("on"))
        stepped = settled(hops.join(further, "to", "left").select("page", F.coalesce("on", "to").alias("to"), F.col("on").isNotNull().alias("moved")))
        if stepped.where("moved").isEmpty():
            return hops.select("page", F.col("to").alias("canonical"))
        hops = stepped.select("page", "to")
    raise ValueError("redirect cycle")
