"""Transcripts of agent sessions from line-delimited JSON, by the format of the tool that wrote them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What tools put before a turn of their own making.
INJECTED = ("<environment_context>", "<user_instructions>", "# AGENTS.md")
CONTENT_A = "array<struct<type: string, text: string>>"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """line, source, place: every line with its file and its place there (the byte order of a file's splits)."""
    return spark.read.text(path).select(
        F.col("value").alias("line"), F.input_file_name().alias("source"), F.monotonically_increasing_id().alias("place")
    )


def _blocks(raw: Column, kinds: tuple[str, ...]) -> Column:
    """The text of a content that is a string or an array of typed blocks."""
    blocks = F.from_json(raw, CONTENT_A)
    texts = F.transform(F.filter(blocks, lambda b: b["type"].isin(*kinds)), lambda b: b["text"])
    return F.when(F.startswith(F.ltrim(raw), F.lit("[")), F.array_join(texts, "\n")).otherwise(raw)


def parse_blocks(lines: DataFrame) -> DataFrame:
    """Lines of user and assistant turns whose message holds text or text blocks; meta and side turns, blank ones
    and malformed lines are dropped. Columns: source, place, role, content."""

    def at(path: str) -> Column:
        return F.get_json_object("line", path)

    kept = lines.where(
        at("$.type").isin("user", "assistant")
        & (F.coalesce(at("$.isMeta"), F.lit("false")) != "true")
        & (F.coalesce(at("$.isSidechain"), F.lit("false")) != "true")
    )
    said = kept.select("source", "place", at("$.type").alias("role"), _blocks(at("$.message.content"), ("text",)).alias("content"))
    return said.where(F.trim("content") != "")


def parse_items(lines: DataFrame) -> DataFrame:
    """Lines of response items that are messages of a user or assistant; turns that a tool injected are dropped.
    Columns: source, place, role, content."""

    def at(path: str) -> Column:
        return F.get_json_object("line", path)

    kept = lines.where(
        (at("$.type") == "response_item") & (at("$.payload.type") == "message") & at("$.payload.role").isin("user", "assistant")
    )
    said = kept.select(
        "source", "place", at("$.payload.role").alias("role"), _blocks(at("$.payload.content"), ("input_text", "output_text")).alias("content")
    )
    plain = F.lit(True)
    for prefix in INJECTED:
        plain = plain & ~F.startswith(F.ltrim("content"), F.lit(prefix))
    return said.where((F.trim("content") != "") & plain)


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"blocks": parse_blocks, "items": parse_items}


def read_transcript(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Turns of the transcripts under a path; `kind` names the format."""
    if kind not in PARSERS:
        raise ValueError(f"unknown transcript format {kind}; known: {', '.join(sorted(PARSERS))}")
    return PARSERS[kind](_lines(spark, path))


def parse_benchmark(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and questions of conversation benchmark samples (column sample: one JSON object each).

    Sessions are numbered keys session_N with their time in session_N_date_time. Turns: sample_id, session, said_at,
    place, speaker, text, dia_id (a picture's caption is added to its text). Questions: sample_id, place,
    question, answer (the adversarial one where there is no other), category, evidence.
    """
    ident = F.get_json_object("sample", "$.sample_id").alias("sample_id")
    keys = F.from_json(F.get_json_object("sample", "$.conversation"), "map<string,string>")
    entries = samples.select(ident, keys.alias("all")).select("sample_id", "all", F.explode("all").alias("key", "value"))
    sessions = entries.where(F.col("key").rlike(r"^session_\d+$")).select(
        "sample_id",
        F.regexp_extract("key", r"(\d+)$", 1).cast("int").alias("session"),
        F.try_element_at("all", F.concat("key", F.lit("_date_time"))).alias("said_at"),
        F.posexplode(F.from_json("value", "array<struct<speaker: string, text: string, dia_id: string, blip_caption: string>>")).alias("place", "t"),
    )
    caption = F.when(F.col("t.blip_caption").isNotNull(), F.concat(F.lit(" [image: "), "t.blip_caption", F.lit("]"))).otherwise("")
    turns = sessions.select(
        "sample_id", "session", "said_at", "place", "t.speaker", F.concat(F.coalesce("t.text", F.lit("")), caption).alias("text"), "t.dia_id"
    )
    shape = "array<struct<question: string, answer: string, adversarial_answer: string, category: int, evidence: array<string>>>"
    asked = samples.select(ident, F.posexplode(F.from_json(F.get_json_object("sample", "$.qa"), shape)).alias("place", "q"))
    questions = asked.select(
        "sample_id", "place", "q.question", F.coalesce("q.answer", "q.adversarial_answer").alias("answer"), "q.category", "q.evidence"
    )
    return turns, questions
