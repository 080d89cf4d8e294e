"""Validity over time: which of a group's overlapping assertions holds when."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators import ranges
from lorekeep.operators.rows import settled


def prioritised(assertions: DataFrame, group: str = "fact_group") -> DataFrame:
    """assertions with `priority`, a struct that orders those of a group; `resolve_segments` says how.

    Where they have a column source_order, it counts before the id.
    """
    bucket = Window.partitionBy(group, "start")
    dated = F.count_if(F.col("stated_on").isNull()).over(bucket) == 0
    priority = F.struct(
        "start",
        F.when(dated, F.col("stated_on")).alias("stated"),
        F.when(~dated, F.col("transaction_id")).alias("transaction"),
        *(["source_order"] if "source_order" in assertions.columns else []),
        "revision_id",
    )
    return assertions.withColumn("priority", priority)


#: Rows of a sweep: the start of an assertion, a mere point in time, one that holds when its range begins, and where the next range begins.
STARTS, POINT, HELD, NEXT = range(4)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, of, revision_id, valid_from, valid_to, edge: the stretches of each range of a group, from rows in order of time.

    Whatever starts later outranks what started before, so those that may still hold are a stack.
    """
    own, kinds = None, None
    out: list[tuple] = []
    stack: list[tuple] = []  # (priority, stop, revision) in ascending order
    new: list[tuple] = []
    first = now = following = None
    held: tuple | None = None  # revision and since when

    def flush() -> None:
        """What holds from `now` on, all that starts then being known."""
        nonlocal held
        stack.extend(sorted(new, key=lambda x: x[0]))
        new.clear()
        best = stack[-1][2] if stack else None
        if held is not None and held[0] != best:
            out.append((*own, *held, now, held[1] == first))
            held = None
        if held is None and best is not None:
            held = best, now

    def close() -> None:
        nonlocal held, first, now, following
        if now is not None:
            flush()
        if held is not None:
            out.append((*own, *held, following, held[1] == first or following is not None))
        stack.clear()
        held = first = now = following = None

    def table() -> pa.RecordBatch:
        columns = [pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, ["block", "of", "revision_id", "valid_from", "valid_to", "edge"])

    for batch in batches:
        field = batch.schema.field
        kinds = [field("block").type, field("of").type, field("revision_id").type, field("at").type, field("at").type, pa.bool_()]
        columns = (batch.column(c).to_pylist() for c in ("block", "of", "at", "kind", "stop", "priority", "revision_id"))
        for block, of, at, kind, stop, priority, revision in zip(*columns, strict=True):
            if (block, of) != own:
                close()
                own = block, of
            rank = priority and tuple(priority.values())
            if kind == NEXT:
                following = stop
            elif kind == HELD:
                new.append((rank, stop, revision))
            else:
                if at != now:
                    if now is not None:
                        flush()
                    else:
                        stack.extend(sorted(new, key=lambda x: x[0]))
                        new.clear()
                        first = at
                    now = at
                    while stack and stack[-1][1] is not None and stack[-1][1] <= at:
                        stack.pop()
                if kind == STARTS:
                    new.append((rank, stop, revision))
        if len(out) >= 4096:
            yield table()
    close()
    if out:
        yield table()


def resolve_segments(assertions: DataFrame, group: str = "fact_group") -> DataFrame:
    """group, revision_id, valid_from, valid_to: the segments in which each assertion holds.

    assertions: group, revision_id, start, stop (null: open; after the start), stated_on, transaction_id. At any time the
    assertion of latest start holds; of those that start together, the one stated last, or, if any of them is
    undated, the one of the last transaction; then the greatest source order, where there is one, and the greatest id. Adjacent segments of one
    assertion are one.

    Times are dealt out in order by sampled ranges, and each range is swept by itself, so a group of any size is spread over tasks. A range knows
    of what started before it: assertions that stop in it, which are sent to it, and of those that outlast it the one that ranks highest (see `ranges.spread_maxima`).
    """
    rows = prioritised(assertions, group).select(F.col(group).alias("of"), "revision_id", "start", "stop", "priority")
    # Of those with the same bounds only the one that ranks highest can hold.
    best = rows.groupBy("of", "start", "stop").agg(F.max("priority").alias("priority"))
    times = F.array(F.struct(F.col("start").alias("at"), F.lit(STARTS).alias("kind")), F.struct(F.col("stop").alias("at"), F.lit(POINT).alias("kind")))
    events = best.select("*", F.explode(times).alias("x")).select("of", "x.at", "x.kind", "start", "stop", "priority").where("at IS NOT NULL")
    dealt = ranges.in_ranges(events, ["of", "at"])
    cut = settled(ranges.of_several(dealt, "of"))
    extra = []
    if not cut.isEmpty():  # groups of several ranges
        keyed = dealt.withColumn("key", F.struct("of"))
        mine = settled(keyed.join(F.broadcast(cut.select(F.struct("of").alias("key")).distinct()), "key"))
        ends = mine.groupBy("key").agg(F.max("block").alias("end"))
        begun = mine.groupBy("key", "start", "stop", "priority").agg(F.max(F.when(F.col("kind") == STARTS, F.col("block"))).alias("b"), F.max(F.when(F.col("kind") == POINT, F.col("block"))).alias("e"))
        spans = settled(begun.join(F.broadcast(ends), "key"))  # a row for each range at most
        come = spans.where("e > b").select("key", F.col("e").alias("block"), "stop", "priority")
        covers = spans.select("key", (F.col("b") + 1).alias("first"), F.coalesce(F.col("e") - 1, "end").alias("last"), "priority")
        over = ranges.spread_maxima(covers, "key", "priority")
        open_stop = F.lit(None).cast(rows.schema["stop"].dataType).alias("stop")
        held = come.unionByName(over.select("key", F.col("block").cast("int").alias("block"), open_stop, "priority")).withColumn("kind", F.lit(HELD))
        along = Window.partitionBy("key").orderBy("block")
        after = mine.groupBy("key", "block").agg(F.min("at").alias("first")).select("key", "block", F.lead("first").over(along).alias("stop")).where("stop IS NOT NULL")
        extra = [held, after.withColumns({"priority": F.lit(None).cast(best.schema["priority"].dataType), "kind": F.lit(NEXT)})]
    feed = dealt.select("of", "block", "at", "kind", "stop", "priority")
    for part in extra:
        feed = feed.unionByName(part.select(F.col("key.of").alias("of"), "block", F.lit(None).cast(rows.schema["start"].dataType).alias("at"), "kind", "stop", "priority"))
    feed = feed.withColumn("revision_id", F.col("priority.revision_id")).repartition("block").sortWithinPartitions("block", "of", "at", "kind")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"block int, of {kinds['of']}, revision_id {kinds['revision_id']}, valid_from {kinds['start']}, valid_to {kinds['start']}, edge boolean"
    swept = feed.mapInArrow(_sweep, schema)
    if not extra:
        return swept.select(F.col("of").alias(group), "revision_id", "valid_from", "valid_to")
    swept = settled(swept.withColumn("key", F.struct("of")).join(F.broadcast(cut.select(F.struct("of").alias("key"), "block", F.lit(True).alias("cut"))), ["key", "block"], "left"))
    at_edge = F.coalesce("cut", F.lit(False)) & F.col("edge")
    along = Window.partitionBy("key").orderBy("valid_from")  # two rows a range at most
    follows = (F.lag("revision_id").over(along) == F.col("revision_id")) & (F.lag("valid_to").over(along) == F.col("valid_from"))
    edges = swept.where(at_edge).withColumn("new", F.when(follows, 0).otherwise(1)).withColumn("island", F.sum("new").over(along))
    joined = edges.groupBy("key", "island", "revision_id").agg(F.min("valid_from").alias("low"), F.max_by("valid_to", "valid_from").alias("valid_to"))
    inner = swept.where(~at_edge).select(F.col("of").alias(group), "revision_id", "valid_from", "valid_to")
    return inner.unionByName(joined.select(F.col("key.of").alias(group), "revision_id", F.col("low").alias("valid_from"), "valid_to"))


def revise(revisions: DataFrame, changes: DataFrame) -> DataFrame:
    """changes (fact_group, expected, new_start, new_stop) against the latest revisions (fact_group, revision_id, start, stop).

    One row per change: fact_group, outcome, start, stop. A change that expects another revision than the latest is a
    conflict, one whose bounds are not in order is invalid; neither takes effect.
    """
    latest = revisions.groupBy("fact_group").agg(F.max(F.struct("revision_id", "start", "stop")).alias("now"))
    met = changes.join(latest, "fact_group", "left")
    outcome = (
        F.when(~F.col("now.revision_id").eqNullSafe(F.col("expected")), "conflict")
        .when(F.col("new_stop") <= F.col("new_start"), "invalid")
        .otherwise("revised")
    )
    done = outcome == "revised"
    return met.select(
        "fact_group",
        outcome.alias("outcome"),
        F.when(done, F.col("new_start")).otherwise(F.col("now.start")).alias("start"),
        F.when(done, F.col("new_stop")).otherwise(F.col("now.stop")).alias("stop"),
    )


def supersedes(rows: DataFrame, key: str, stated: str, order: str) -> DataFrame:
    """rows (id, ...) with `supersedes`, the id of the row of the same key that was current when the row came (by `order`), and `stale`.

    Current is the row that was stated last so far, the later one of equals. A row that was stated before it supersedes
    nothing and is stale: an older truth that arrives late never replaces a newer one. Without a statement a row
    is not known to be older, and what has none is replaced by anything. Keys are dealt out by ranges of `order`, each of which is handed what was current before it.
    """
    dealt = ranges.in_ranges(rows.withColumn("_key", F.struct(key)), ["_key", order], "_block")
    mark = F.struct(F.col(stated).alias("stated"), F.col(order).alias("at"), F.col("id"))
    cut = F.broadcast(settled(ranges.of_several(dealt, "_key", "_block")))  # two rows a range at most
    along = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    handed = dealt.join(cut, ["_key", "_block"]).groupBy("_key", "_block").agg(F.max(mark).alias("_m"))
    handed = handed.select("_key", "_block", F.max("_m").over(along).alias("_before"))
    within = Window.partitionBy("_block", "_key").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    met = dealt.join(F.broadcast(handed), ["_key", "_block"], "left").withColumn("_here", F.max(mark).over(within))
    current = F.when(F.col("_here").isNull() | (F.col("_before") > F.col("_here")), F.col("_before")).otherwise(F.col("_here"))
    found = met.withColumn("current", current)
    older = F.coalesce(F.col(stated) < F.col("current.stated"), F.lit(False))
    return found.withColumns({"supersedes": F.when(~older, F.col("current.id")), "stale": older}).select(*rows.columns, "supersedes", "stale")


def history(revisions: DataFrame, segments: DataFrame, day: Column) -> DataFrame:
    """revisions (fact_group, revision_id, transaction_id, ...) with place, valid_from, valid_to, selected: a row for each stretch in which
    one holds, or one without bounds; place counts within the fact by transaction, selected says whether it holds on the day."""
    held = segments.select("fact_group", "revision_id", "valid_from", "valid_to")
    met = revisions.join(held, ["fact_group", "revision_id"], "left")
    on = (F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (day < F.col("valid_to")))
    return ranges.numbered(met, "fact_group", ["transaction_id", "valid_from"], "place").withColumn("selected", F.coalesce(on, F.lit(False)))


def append(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """fact_group, revision_id, start, stop, closed: stored revisions and those of `incoming` that are not among them.

    incoming: fact_group (its own), revision_id, start, stop, predecessor, corrects (revision ids or null). A correction of a stored
    revision joins its fact, begins when it did unless it says otherwise, and closes it. Others join their predecessor's
    fact if that is stored, else their own. What is appended is to be resolved again by fact.
    """
    new = incoming.dropDuplicates(["revision_id"]).join(stored.select("revision_id"), "revision_id", "left_anti")
    target = stored.select(F.col("revision_id").alias("corrects"), F.col("fact_group").alias("target"), F.col("start").alias("began"))
    before = stored.select(F.col("revision_id").alias("predecessor"), F.col("fact_group").alias("before"))
    met = new.join(target, "corrects", "left").join(before, "predecessor", "left")
    made = met.select(
        F.coalesce("target", "before", "fact_group").alias("fact_group"), "revision_id", F.coalesce("start", "began").alias("start"), "stop", F.lit(False).alias("closed")
    )
    closed = met.where("target IS NOT NULL").select(F.col("corrects").alias("revision_id"), F.lit(True).alias("shut")).distinct()
    kept = stored.join(closed, "revision_id", "left")
    return kept.select("fact_group", "revision_id", "start", "stop", F.coalesce("shut", F.lit(False)).alias("closed")).unionByName(made)
