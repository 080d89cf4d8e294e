"""The prefix trie of conversations, as one table of nodes, in DataFrame operations only.

A node is a sequence of first turns. Its key is the number of its turns and two sums, over them, of hashes of a turn's place
and digest, so keys come from running sums: conversations are dealt out by sampled ranges, summed range by range, and what
a range hands on to the next is added. Each range's turns make a partial trie, a table of nodes in which equal ones are
combined; partial tries are merged by key, MERGED ranges at a time, until one is left: members are summed up, and lists of
ends are joined. Sums over subtrees then go bottom-up by doubling: in round k each node adds its sums to the node 2^k
above, so rounds grow with the logarithm of the depth. Nodes of one member need none of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import HOT, meet, ranked, stash, straddlers, whole_text

#: Partial tries that one round merges into one.
MERGED = 64
#: Ids of an end list that are kept together: those that agree but for the last so many values. No part holds more.
PART = 4096
#: Leading characters of a text that take part in the order of turns of equal number.
LEADING = 64
KEY = ["depth", "k1", "k2"]
ABOVE = ["parent_depth", "p1", "p2"]


def steps(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, step (from 1), d1, d2, size, n_steps: the turns in their order, each by its digest and its code points.

    Turns are ordered by number (null first), then role, then text (its first 64 code points, then its digest); equal rows are
    all counted. Null roles and texts are empty. Rows without a conversation id belong to none and are left out; an empty
    table gives no rows; other columns, whatever their names, are ignored. No text is shuffled but its beginning.
    """
    who, said = F.coalesce(F.col(role).cast("string"), F.lit("")), whole_text(text)
    digest = F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said), 256)
    lanes = [F.conv(F.substring(digest, at, 16), 16, -10).cast("long").alias(name) for name, at in (("d1", 1), ("d2", 17))]
    narrow = turns.where(F.col(conversation).isNotNull()).select(
        F.col(conversation).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        who.alias("role"),
        F.left(said, F.lit(LEADING)).alias("lead"),
        *lanes,
        F.length(said).cast("long").alias("size"),
        F.monotonically_increasing_id().alias("row"),
    )
    placed = ranked(narrow, ["conv_id", "turn", "role", "lead", "d1", "d2", "row"], "rank", "block")
    whole = placed.groupBy("conv_id").agg(F.min("rank").alias("first"), F.count("*").alias("n_steps"))
    met = meet(placed, stash(whole), ["conv_id"], F.col("n_steps") * HOT > placed.count())
    return met.select("conv_id", (F.col("rank") - F.col("first") + 1).alias("step"), "d1", "d2", "size", "n_steps")


def share_beginnings(rows: DataFrame, skip: Column, group: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations (see `steps`) rebuilt on the beginning of the first one of their group of ids: (steps, all ids).

    The first `skip` turns (an expression of conv_id, at most `most`) of conversation conv_id - conv_id % group, or all if
    it has fewer, take the place of the own first `skip` turns. The second frame names every conversation, those left without turns too.
    """
    rows = stash(rows)
    heads = rows.where((F.col("conv_id") % group == 0) & (F.col("step") <= most)).groupBy("conv_id")
    heads = heads.agg(F.array_sort(F.collect_list(F.struct("step", "d1", "d2", "size"))).alias("head"))
    own = rows.where("step = 1").select("conv_id", "n_steps", (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    plan = own.join(heads.withColumnRenamed("conv_id", "base"), "base", "left").withColumn("skip", skip)
    plan = plan.withColumn("head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("skip")))
    plan = stash(plan.select("conv_id", "skip", "head", F.col("n_steps").alias("n")))
    shift = plan.select("conv_id", "skip", F.size("head").alias("taken"), "n")
    tails = meet(rows, shift, ["conv_id"], F.col("n") * HOT > rows.count()).where("step > skip")
    tails = tails.select("conv_id", (F.col("step") - F.col("skip") + F.col("taken")).alias("step"), "d1", "d2", "size")
    begun = plan.select("conv_id", F.explode("head").alias("x")).select("conv_id", F.col("x.step").cast("long").alias("step"), "x.d1", "x.d2", "x.size")
    return begun.unionByName(tails), plan.select("conv_id")


def _key(sums: tuple[Column, Column], names: list[str]) -> list[Column]:
    a, b = (x.cast("decimal(38,0)") for x in sums)
    return [F.xxhash64(a, b).alias(names[0]), F.xxhash64(F.lit(1), b, a).alias(names[1])]


def prefixes(rows: DataFrame) -> DataFrame:
    """block, depth, k1, k2, parent_depth, p1, p2, conv_id, size, last: the node that each conversation reaches at each step.

    rows: conv_id, step (1, 2, ... in each conversation), d1, d2, size.
    """
    mixed = rows.select("conv_id", "step", "size", F.xxhash64("step", "d1", "d2").alias("a"), F.xxhash64("d2", "d1", "step").alias("b"))
    dealt = ranked(mixed, ["conv_id", "step"], "rank", "block")
    cut = stash(straddlers(dealt, "conv_id", "block"))
    wide = [F.sum(F.col(x).cast("decimal(20,0)")) for x in ("a", "b")]
    parts = dealt.join(F.broadcast(cut), ["conv_id", "block"]).groupBy("conv_id", "block").agg(*(x.alias(n) for x, n in zip(wide, ("sa", "sb"))))
    along = Window.partitionBy("conv_id").orderBy("block")  # a row for each range
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    handed = parts.select(
        "conv_id",
        "block",
        F.sum("sa").over(earlier).alias("ca"),
        F.sum("sb").over(earlier).alias("cb"),
        F.lead("block").over(along).isNotNull().alias("more"),
    )
    within = Window.partitionBy("block", "conv_id").orderBy("step")
    running = within.rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.join(F.broadcast(handed), ["conv_id", "block"], "left")  # at most two rows a range
    found = found.withColumns({
        "last": F.lead("step").over(within).isNull() & ~F.coalesce("more", F.lit(False)),
        "sa": F.sum(F.col("a").cast("decimal(20,0)")).over(running) + F.coalesce("ca", F.lit(0)),
        "sb": F.sum(F.col("b").cast("decimal(20,0)")).over(running) + F.coalesce("cb", F.lit(0)),
    })
    sums, before = (F.col("sa"), F.col("sb")), (F.col("sa") - F.col("a"), F.col("sb") - F.col("b"))
    return found.select(
        "block", F.col("step").alias("depth"), *_key(sums, KEY[1:]), (F.col("step") - 1).alias("parent_depth"), *_key(before, ABOVE[1:]), "conv_id", "size", "last"
    )


def merged(reached: DataFrame, ranges: int) -> DataFrame:
    """The nodes of all ranges' partial tries: key, parent's key, n_convs, conv_id (smallest member), size, n_ends."""
    sums = [F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("size").alias("size"), F.sum("n_ends").alias("n_ends")]
    nodes = reached.withColumns({"n_convs": F.lit(1).cast("long"), "n_ends": F.col("last").cast("long")})
    while True:
        ranges = -(-ranges // MERGED)
        nodes = nodes.withColumn("block", F.floor(F.col("block") / MERGED)).groupBy("block", *KEY, *ABOVE).agg(*sums)
        if ranges <= 1:
            return nodes.drop("block")


def end_lists(ends: DataFrame) -> DataFrame:
    """key, digest: SHA-256 of the ascending, comma-joined ids (key, conv_id) of each node's list.

    Lists are kept in parts of PART values. A list of several parts goes through one task part by part, as the digest
    takes it in; it is never held whole.
    """
    part = F.floor(F.col("conv_id") / PART).alias("part")
    parts = ends.groupBy(*KEY, part).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    parts = stash(parts)
    lists = parts.groupBy(*KEY).agg(F.count("*").alias("parts"), F.min("ids").alias("ids"))
    short = lists.where("parts = 1").select(*KEY, F.sha2("ids", 256).alias("digest"))
    long = parts.join(lists.where("parts > 1").select(*KEY), KEY).select(*KEY, "part", "ids")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], [*KEY, "digest"])

        for batch in batches:
            for *own, _, ids in zip(*(column.to_pylist() for column in batch.columns)):
                if own == key:
                    state.update(f",{ids}".encode())
                    continue
                if key is not None:
                    yield done()
                key, state = own, hashlib.sha256(ids.encode())
        if key is not None:
            yield done()

    streamed = long.repartition(*KEY).sortWithinPartitions(*KEY, "part").mapInArrow(digest, "depth long, k1 long, k2 long, digest string")
    return short.unionByName(streamed)


def rolled_up(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """key and `sums` over each node's subtree, of nodes (key, parent's key, null at the root, and the node's own sums)."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    found, reach = nodes.select(*KEY, *ABOVE, *sums), 1
    while reach <= deepest:
        found = stash(found)
        rising = found.where("p1 IS NOT NULL")
        given = rising.groupBy(*(F.col(a).alias(k) for a, k in zip(ABOVE, KEY))).agg(*(F.sum(s).alias(f"_{s}") for s in sums), F.count("*").alias("_n"))
        given = stash(given)
        added = [(F.col(s) + F.coalesce(f"_{s}", F.lit(0))).alias(s) for s in sums]
        # Who stands 2^k above the node that stands 2^k above: many may ask the same node.
        heads = found.join(given.select(*KEY, "_n"), KEY).select(
            *(F.col(k).alias(a) for k, a in zip(KEY, ABOVE)), *(F.col(a).alias(f"_{a}") for a in ABOVE), "_n"
        )
        asked = meet(rising.select(*KEY, *ABOVE), stash(heads), ABOVE, F.col("_n") * HOT > rising.count())
        asked = asked.select(*KEY, *(F.col(f"_{a}").alias(a) for a in ABOVE))
        found = found.drop(*ABOVE).join(given, KEY, "left").select(*KEY, *added).join(asked, KEY, "left")
        reach *= 2
    return found.select(*KEY, *sums)


def build(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """The nodes of the trie of conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved, ends_sha256.

    rows: conv_id, step (1, 2, ... in each), d1, d2, size (see `steps`); conversations: all ids, where some have no steps.
    A node is named by its smallest member and its depth; its parent by parent_conv_id (null for the root) and depth - 1. n_convs counts
    members, n_leaves childless nodes of the subtree; saved sums, over the subtree, (members - 1) times the size of the node's
    last turn; ends_sha256 digests the ascending ids of the conversations that end here. No conversations, no nodes.
    """
    reached = stash(prefixes(rows))
    ranges = (reached.agg(F.max("block")).first()[0] or 0) + 1
    nodes = merged(reached, ranges)
    top = _key((F.lit(0), F.lit(0)), KEY[1:])
    every = reached.select("conv_id").distinct() if conversations is None else conversations
    silent = every.join(reached.where("depth = 1").select("conv_id"), "conv_id", "left_anti").select(F.lit(0).cast("long").alias("depth"), *top, "conv_id")
    ends = reached.where("last").select(*KEY, "conv_id").unionByName(silent)
    root = every.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0").select(
        F.lit(0).cast("long").alias("depth"), *top, *(F.lit(None).cast("long").alias(a) for a in ABOVE), "n_convs", "conv_id", F.lit(0).cast("long").alias("size")
    )
    nodes = stash(nodes.drop("n_ends").unionByName(root))
    n = nodes.count()
    mark = F.col("n_convs") == 1
    kids = nodes.where("p1 IS NOT NULL").groupBy(*(F.col(a).alias(k) for a, k in zip(ABOVE, KEY))).agg(
        F.count("*").alias("n_children"), F.count_if(mark).alias("alone")
    )
    nodes = stash(nodes.join(kids, KEY, "left").fillna(0, ["n_children", "alone"]))
    parents = nodes.where("n_children > 0").select(*(F.col(k).alias(a) for k, a in zip(KEY, ABOVE)), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_n"))
    shared = nodes.where(~mark | (F.col("depth") == 0)).withColumns({
        "n_leaves": F.col("alone") + F.when(F.col("n_children") == 0, 1).otherwise(0),
        "saved": (F.col("n_convs") - 1) * F.col("size"),
    })
    found = nodes.join(rolled_up(shared, ["n_leaves", "saved"]), KEY, "left").fillna({"n_leaves": 1, "saved": 0})
    found = stash(found.join(end_lists(ends), KEY, "left"))
    below = meet(found.where("p1 IS NOT NULL"), parents, ABOVE, F.col("_n") * HOT > n).drop("_n")
    return below.unionByName(found.where("p1 IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long"))).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    )
