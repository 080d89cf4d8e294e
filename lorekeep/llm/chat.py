"""Multi-party perspective rotation: each conversation rendered once for every participant.

From a participant's perspective that speaker is the assistant, all others are users called by name, and
system turns stay what they are. Masks mark what the model is to learn: the assistant's words with the mark
that ends them. Turns are dealt out by ranges of their order and rendered range by range; what is left to do for a
conversation, however long, is to lay its few rendered stretches end to end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import HOT, meet, stash

#: Leading characters of a text that take part in dealing turns out; equal ones stay together.
LEADING = 64


@dataclass(frozen=True)
class Template:
    """Marks around a turn. Where they occur in a text or a name, `blunt` parts them so that they are plain text."""

    begin: str = "<|im_start|>"
    end: str = "<|im_end|>"
    system: str = "system"
    assistant: str = "assistant"
    user: str = "user"
    nameless: str = "unknown"

    def blunt(self, text: Column) -> Column:
        for mark in (self.begin, self.end):
            text = F.replace(text, F.lit(mark), F.lit(f"{mark[:2]} {mark[2:]}"))
        return text


def _laid_out(stretches: Column, start: Column) -> Column:
    """The mask of stretches (length, mask) that are laid end to end from `start` on."""
    none = F.array().cast("array<struct<start: int, end: int>>")

    def add(state: Column, x: Column) -> Column:
        moved = F.transform(
            x["mask"], lambda m: F.struct((m["start"] + state["at"]).alias("start"), (m["end"] + state["at"]).alias("end"))
        )
        return F.struct((state["at"] + x["length"]).alias("at"), F.concat(state["mask"], moved).alias("mask"))

    return F.aggregate(stretches, F.struct(start.cast("int").alias("at"), none.alias("mask")), add, lambda state: state["mask"])


def rotate(
    turns: DataFrame,
    template: Template = Template(),
    part_chars: int | None = None,
    conversation: str = "conv_id",
    turn: str = "turn",
    speaker: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per conversation and perspective: those two, part (0), n_turns, text, and mask.

    mask is an array of (start, end) in code points of `text`, end exclusive. Turns are ordered by number (null
    first), then speaker, then text; equal rows are all rendered. A null text is empty, a null speaker is the one called
    template.nameless, null conversation ids make up one conversation. A conversation of system turns only has no
    participant and no row; an empty table gives none. Other columns of turns, whatever their names, are ignored.

    A dialogue is one row, which in Spark may hold 2 GB. For longer ones give part_chars: a dialogue then goes on in
    a new part (1, 2, ...) once a part has so many characters, cut where a stretch of turns ends. Each later part begins with
    all system turns of the parts before it; n_turns does not count those again.
    """
    said = turns.select(
        F.struct(F.col(conversation).alias("conv_id")).alias("of"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(speaker).cast("string"), F.lit(template.nameless)).alias("who"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("said"),
    )
    dealt = said.repartitionByRange("of", "turn", "who", F.left("said", F.lit(LEADING)))
    dealt = stash(dealt.withColumn("block", F.spark_partition_id()))
    sides = dealt.groupBy("of").agg(
        F.collect_set(F.when(F.col("who") != template.system, F.col("who"))).alias("sides"), F.count("*").alias("n")
    )
    sides = stash(sides.where(F.size("sides") > 0))
    seen = meet(dealt, sides, ["of"], F.col("n") * HOT > dealt.count())
    seen = seen.withColumn("perspective", F.explode("sides"))
    own = F.col("who") == F.col("perspective")
    name = (
        F.when(F.col("who") == template.system, F.lit(template.system))
        .when(own, F.lit(template.assistant))
        .otherwise(F.concat(F.lit(f"{template.user} name="), template.blunt(F.col("who"))))
    )
    head = F.concat(F.lit(template.begin), name, F.lit("\n"))
    body = F.concat(template.blunt(F.col("said")), F.lit(template.end))
    span = F.struct(F.length(head).alias("start"), (F.length(head) + F.length(body)).alias("end"))
    shown = F.concat(head, body, F.lit("\n"))
    size = F.length(shown)
    if part_chars is None:
        stretch = F.struct("block", F.lit(0).cast("long").alias("piece"))
    else:  # a range's turns of a dialogue in pieces of so many characters
        within = Window.partitionBy("of", "perspective", "block").orderBy("turn", "who", "said")
        run = F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, 0))
        stretch = F.struct("block", F.floor(run / part_chars).cast("long").alias("piece"))
    seen = seen.select(
        "of",
        "perspective",
        stretch.alias("block"),
        F.struct(
            "turn",
            "who",
            "said",
            shown.alias("text"),
            size.alias("length"),
            F.when(own, F.array(span)).otherwise(F.array().cast("array<struct<start: int, end: int>>")).alias("mask"),
        ).alias("x"),
    )
    blocks = seen.groupBy("of", "perspective", "block").agg(F.array_sort(F.collect_list("x")).alias("x"))
    rules = F.filter("x", lambda x: x["who"] == template.system)
    joined = F.array_join(F.transform("x", lambda x: x["text"]), "")
    blocks = blocks.select(
        "of",
        "perspective",
        "block",
        F.size("x").cast("long").alias("n"),
        joined.alias("text"),
        F.length(joined).alias("length"),
        _laid_out(F.col("x"), F.lit(0)).alias("mask"),
        F.array_join(F.transform(rules, lambda x: x["text"]), "").alias("rules"),
    )
    before = Window.partitionBy("of", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    part = F.lit(0) if part_chars is None else F.floor(F.coalesce(F.sum("length").over(before), F.lit(0)) / part_chars)
    laid = F.array_sort(F.collect_list(F.struct("block", "text", "length", "mask", "rules"))).alias("x")
    parts = blocks.withColumn("part", part.cast("long")).groupBy("of", "perspective", "part").agg(F.sum("n").alias("n_turns"), laid)
    earlier = F.lit("")
    if part_chars is not None:
        before = Window.partitionBy("of", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        own_rules = F.array_join(F.transform("x", lambda x: x["rules"]), "")
        parts = parts.withColumn("own_rules", own_rules).withColumn("earlier", F.array_join(F.collect_list("own_rules").over(before), ""))
        earlier = F.col("earlier")
    return parts.select(
        F.col("of.conv_id").alias("conv_id"),
        "perspective",
        "part",
        "n_turns",
        F.concat(earlier, F.array_join(F.transform("x", lambda x: x["text"]), "")).alias("text"),
        _laid_out(F.col("x"), F.length(earlier)).alias("mask"),
    )
