"""Changes to a DAG of clusters: which of a batch may be made, and the DAG and revisions after it.

A membership is a row (cluster, kind, child), kind `cluster` or `memory`. A batch is looked at as one graph, the current one with all
changes made. Whatever breaks a limit there is refused, its cluster goes back to its current members, and the rest is looked at again,
until nothing breaks any. The current graph keeps the limits, so whatever breaks one uses a membership that a change added, and only
changes that added one are refused. A batch of one change is thereby judged as a store would judge that change alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.rows import settled

ROW = ["cluster", "kind", "child"]
#: Levels of a walk that are kept apart; more are written as one.
APART = 8


@dataclass(frozen=True)
class Limits:
    """members and parents are direct ones; levels counts the clusters of a longest path; originals the distinct memories below a cluster."""

    members: int = 20
    parents: int = 5
    levels: int = 4
    originals: int = 500


def _steps(graph: DataFrame) -> DataFrame:
    return graph.where("kind = 'cluster'").select("cluster", F.col("child").alias("below"))


def cyclic(steps: DataFrame) -> DataFrame:
    """The steps (cluster, below) that are left once clusters without a step in or out are taken away again and again.

    None is left of a graph without cycles; else those on cycles and on paths between them.
    """
    left, n = settled(steps.distinct()), -1
    while (now := left.count()) and now != n:
        n = now
        under, over = left.select(F.col("below").alias("cluster")).distinct(), left.select(F.col("cluster").alias("below")).distinct()
        left = settled(left.join(under, "cluster", "left_semi").join(over, "below", "left_semi").select("cluster", "below"))
    return left


def heights(steps: DataFrame, end: str, start: str, most: int) -> DataFrame:
    """`end`, height: the clusters of the longest path of steps that begins with each, along `start`, counted up to most + 1.

    Clusters without a step have no row; their height is one. The steps may not be cyclic.
    """
    found = steps.select(end).distinct().withColumn("height", F.lit(2))
    for _ in range(most - 1):
        below = settled(found).withColumnRenamed(end, start)
        longest = steps.join(below, start, "left").groupBy(end).agg(F.max(F.coalesce("height", F.lit(1))).alias("height"))
        found = longest.select(end, F.least(F.col("height") + 1, F.lit(most + 1)).alias("height"))
    return settled(found)


def originals(graph: DataFrame, limits: Limits) -> DataFrame:
    """cluster, ids: the distinct memories at or below each cluster, of which one more than the limit are kept at most.

    The graph has the limits of members and levels, so a row gathers no more than members times originals ids.
    """
    own = graph.where("kind = 'memory'").groupBy("cluster").agg(F.collect_set("child").alias("ids"))
    steps = settled(_steps(graph))
    found = own
    for _ in range(limits.levels - 1):
        found = settled(found)
        below = steps.join(found.withColumnRenamed("cluster", "below"), "below").select("cluster", "ids")
        every = own.unionByName(below).groupBy("cluster").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
        found = every.select("cluster", F.slice("ids", 1, limits.originals + 1).alias("ids"))
    return settled(found)


def _faulty(proposed: DataFrame, changed: DataFrame, states: DataFrame, sources: DataFrame, limits: Limits) -> DataFrame:
    """cluster, reason: the changes that are wrong by themselves."""
    known = states.select(F.col("cluster").alias("child"), F.lit("cluster").alias("kind"), "state")
    named = settled(proposed.where("kind = 'memory'").select("child").distinct())
    seen = sources.select("child").join(named, "child", "left_semi").distinct().select("child", F.lit("memory").alias("kind"), F.lit("active").alias("state"))
    met = proposed.join(known.unionByName(seen), ["child", "kind"], "left")
    is_cluster, state = F.col("kind") == "cluster", F.col("state")

    def some(fault: Column) -> Column:
        return F.coalesce(F.bool_or(fault), F.lit(False))

    facts = met.groupBy("cluster").agg(
        ((F.count("*") > limits.members) | (F.count("*") > F.count_distinct("kind", "child"))).alias("members"),
        some(is_cluster & (F.col("child") == F.col("cluster"))).alias("self"),
        some(is_cluster & state.isNull()).alias("unknown child"),
        some(is_cluster & (state != "active")).alias("dissolved child"),
        some(~is_cluster & state.isNull()).alias("unknown source"),
    )
    first = F.coalesce(*(F.when(F.col(r), r) for r in facts.columns[1:]))
    return facts.join(changed, "cluster", "left_semi").select("cluster", first.alias("reason")).where("reason IS NOT NULL")


def _reached(steps: DataFrame, start: DataFrame, end: str, other: str) -> DataFrame:
    """cluster: the start (cluster, distinct) and all that is reached from it along steps from `end` to `other`; a cycle ends where it was before."""
    held, front = [start], start
    while True:
        seen = reduce(DataFrame.unionByName, held)
        step = steps.join(front.withColumnRenamed("cluster", end), end, "left_semi").select(F.col(other).alias("cluster")).distinct()
        front = settled(step.join(seen, "cluster", "left_anti"))
        if front.isEmpty():
            return seen
        held = [*held, front] if len(held) < APART else [settled(seen), front]


def _concerned(members: DataFrame, made: DataFrame, added: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A function that cuts memberships to those on which it depends whether what was added breaks a limit.

    These are all of the clusters above those that added something and of all clusters below these, and of other clusters those that name a child that was added,
    as its parents are counted. Cycles, longest paths and originals that use a membership that was added lie within the former.
    """
    steps = settled(_steps(members.unionByName(made)).distinct())
    above = settled(_reached(steps, settled(added.select("cluster").distinct()), "below", "cluster"))
    within = settled(_reached(steps, above, "cluster", "below"))
    named = settled(added.select("kind", "child").distinct())

    def cut(rows: DataFrame) -> DataFrame:
        own = rows.join(within, "cluster", "left_semi").select(*ROW)
        beside = rows.join(named, ["kind", "child"], "left_semi").join(within, "cluster", "left_anti").select(*ROW)
        return settled(own.unionByName(beside))

    return cut


def _broken(graph: DataFrame, added: DataFrame, limits: Limits) -> DataFrame:
    """cluster, reason: the changes that added (cluster, kind, child) to what breaks the first limit that the graph breaks; none if it is sound."""
    crowded = graph.groupBy("kind", "child").agg(F.count_distinct("cluster").alias("n")).where(F.col("n") > limits.parents)
    found = settled(added.join(crowded, ["kind", "child"], "left_semi").select("cluster", F.lit("parents").alias("reason")).distinct())
    if not found.isEmpty():
        return found
    steps, new = settled(_steps(graph).distinct()), _steps(added)
    loops = cyclic(steps)
    found = settled(new.join(loops, ["cluster", "below"], "left_semi").select("cluster", F.lit("cycle").alias("reason")).distinct())
    if not found.isEmpty():
        return found
    down = heights(steps, "cluster", "below", limits.levels).select(F.col("cluster").alias("below"), F.col("height").alias("down"))
    up = heights(steps, "below", "cluster", limits.levels).select(F.col("below").alias("cluster"), F.col("height").alias("up"))
    through = new.join(up, "cluster", "left").join(down, "below", "left")
    deep = through.where(F.coalesce("up", F.lit(1)) + F.coalesce("down", F.lit(1)) > limits.levels)
    found = settled(deep.select("cluster", F.lit("levels").alias("reason")).distinct())
    if not found.isEmpty():
        return found
    blamed = front = settled(originals(graph, limits).where(F.size("ids") > limits.originals).select("cluster"))
    for _ in range(limits.levels - 1):
        front = settled(steps.join(front, "cluster", "left_semi").select(F.col("below").alias("cluster")).distinct())
        blamed = blamed.unionByName(front)
    return settled(added.join(blamed, "cluster", "left_semi").select("cluster", F.lit("originals").alias("reason")).distinct())


def admit(members: DataFrame, states: DataFrame, changed: DataFrame, proposed: DataFrame, sources: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """cluster, reason: each changed cluster, with why its proposal is refused (null where it is admitted).

    members: the current memberships of active clusters; states: cluster, state of all; changed: cluster, each once; proposed: the memberships
    that they shall have instead; sources: child, the memories that there are. A round looks at what its changes concern only. Reasons in order: members (too many, or one
    twice), self, unknown child, dissolved child, unknown source, parents, cycle, levels, originals.
    """
    members, proposed = settled(members.select(*ROW)), settled(proposed.select(*ROW))
    refused = settled(_faulty(proposed, changed, states, sources, limits))
    while True:
        open_ = settled(changed.select("cluster").join(refused, "cluster", "left_anti"))
        made = proposed.join(open_, "cluster", "left_semi").select(*ROW)
        added = settled(made.join(members, ROW, "left_anti"))
        if added.isEmpty():
            break
        cut = _concerned(members, made, added)
        members, proposed = cut(members), cut(made)
        graph = settled(members.join(open_, "cluster", "left_anti").unionByName(proposed))
        broken = _broken(graph, added, limits)
        if broken.isEmpty():
            break
        refused = settled(refused.unionByName(broken))
    return changed.select("cluster").join(refused, "cluster", "left")


def apply_structure(
    heads: DataFrame, members: DataFrame, changes: DataFrame, proposed: DataFrame, sources: DataFrame, limits: Limits = Limits()
) -> tuple[DataFrame, DataFrame]:
    """The heads after a batch of changes (cluster, revision, state, title, outcome, reason), and the memberships of active clusters.

    heads: cluster, revision, state, title; changes: cluster (each once), kind (create, edit, dissolve, restore), expected (the revision that
    its author saw), title; proposed: memberships for all but dissolves; sources: child, the memories that are valid. Dissolves come first: a
    cluster that is dissolved leaves its active parents, which get a revision for each such child, so that changes that saw an earlier one conflict.
    Then the others are admitted together. Outcomes: done, same (nothing would change), conflict, missing, invalid (not active),
    refused (with the reason); null where nothing was asked; detached for parents that only lost children.
    """
    now = heads.select("cluster", "revision", "state", "title")
    asked = changes.select("cluster", F.col("kind").alias("asked"), "expected", F.col("title").alias("new_title"))
    met = now.join(asked, "cluster", "left")
    gone = settled(met.where("asked = 'dissolve' AND state = 'active' AND expected = revision").select("cluster"))
    memberships = settled(members.select(*ROW).join(gone, "cluster", "left_anti"))
    lost = memberships.join(gone.select(F.col("cluster").alias("child"), F.lit("cluster").alias("kind")), ["child", "kind"], "left_semi")
    lost = settled(lost.select(*ROW))
    kept = settled(memberships.join(lost, ROW, "left_anti"))
    detached = lost.groupBy("cluster").agg(F.count("*").alias("lost"))
    every = asked.join(now, "cluster", "full").join(detached, "cluster", "left").join(gone.withColumn("gone", F.lit(True)), "cluster", "left")
    every = settled(every.fillna(0, ["lost"]).fillna(False, ["gone"]).withColumn("at", F.col("revision") + F.col("lost")))
    asked_, there = F.col("asked"), F.col("revision").isNotNull()
    verdict = (
        F.when(F.col("gone"), "done")
        .when(asked_ == "create", F.when(there, "conflict"))
        .when(~there, "missing")
        .when(~F.col("expected").eqNullSafe(F.col("at")), "conflict")
        .when((asked_ != "restore") & (F.col("state") != "active"), "invalid")
    )
    judged = settled(every.withColumn("verdict", F.when(asked_.isNotNull(), verdict)))
    open_ = judged.where("asked IS NOT NULL AND verdict IS NULL").select("cluster")
    states = judged.where(there).select("cluster", F.when(F.col("gone"), "dissolved").otherwise(F.col("state")).alias("state"))
    wanted = settled(proposed.select(*ROW).join(open_, "cluster", "left_semi"))
    reasons = settled(admit(kept, states, open_, wanted, sources, limits))
    taken = reasons.where("reason IS NULL").select("cluster")
    final = kept.join(taken, "cluster", "left_anti").unionByName(wanted.join(taken, "cluster", "left_semi"))
    differs = wanted.join(kept, ROW, "left_anti").select("cluster").unionByName(kept.join(open_, "cluster", "left_semi").join(wanted, ROW, "left_anti").select("cluster"))
    found = judged.join(reasons, "cluster", "left").join(differs.distinct().withColumn("differs", F.lit(True)), "cluster", "left")
    same = (asked_ == "edit") & F.col("differs").isNull() & F.col("new_title").eqNullSafe(F.col("title"))
    late = F.when(F.col("reason").isNotNull(), "refused").when(same, "same").otherwise("done")
    outcome = F.when(asked_.isNull(), F.when(F.col("lost") > 0, "detached")).otherwise(F.coalesce("verdict", late))
    done = F.coalesce(F.col("outcome") == "done", F.lit(False))
    after = found.withColumn("outcome", outcome).select(
        "cluster",
        F.when(done, F.coalesce("at", F.lit(0)) + 1).otherwise(F.col("at")).cast("long").alias("revision"),
        F.when(F.col("gone"), "dissolved").when(done, "active").otherwise(F.col("state")).alias("state"),
        F.when(done & ~F.col("gone"), F.coalesce("new_title", "title")).otherwise(F.col("title")).alias("title"),
        "outcome",
        "reason",
    )
    return after, final
