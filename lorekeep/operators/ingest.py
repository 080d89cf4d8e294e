"""Preparing transcripts and tool traces: normalising, chunking, ledgers, relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import dates, text
from lorekeep.operators import packing

# What traces name. Tests that failed, tasks of a module, paths and stems of source files, frames of a stack, and the
# tools that edit files.
FAILED_TEST = r"([A-Za-z_][A-Za-z0-9_.$]*)\s*>\s*[^\n]*?\bFAILED\b"
FAILED_NAME = r"([A-Za-z_][A-Za-z0-9_$]*)\s*>\s*[^\n]*?\bFAILED\b"
MODULE_TASK = r":([A-Za-z0-9_-]+):"
SOURCE_PATH = r"[\w./-]+\.(?:java|kt|scala|js|ts|tsx|scss|py|go|rs)"
SOURCE_STEM = r"\b([A-Za-z_][A-Za-z0-9_]*+)\.(?:java|kt|scala|js|ts|tsx|scss|py|go|rs)\b"
STACK_FRAME = r"\bat\s+([A-Za-z_][A-Za-z0-9_.$]*\.[A-Za-z_][A-Za-z0-9_$]*)\s*\("
EDITING = ("edit", "write", "multiedit", "notebookedit")
# Tools whose calls are always kept, and those dropped unless they failed.
ALWAYS_KEPT = ("bash", "edit", "write", "multiedit", "notebookedit")


def normalize(messages: DataFrame) -> DataFrame:
    """messages (role, content, session_id, said_on) that say something, with relative dates made absolute."""
    blank = F.lit(False)
    for name in ("role", "content", "session_id"):
        blank = blank | F.coalesce(F.trim(F.col(name).cast("string")) == "", F.lit(True))
    kept = messages.where(~blank)
    return kept.withColumns({"role": F.trim("role"), "content": dates.rewrite_relative(F.col("content"), F.col("said_on"))})


def pack(
    rows: DataFrame, group: str, order: str, cost: str, target: int, overlap: int = 0, joint: int = 0, most: int | None = None
) -> DataFrame:
    """group, chunk, first, last, size: runs of a group's rows, in order, whose costs stay within a target.

    Every row after a run's first costs `joint` more; a run has at least one row and no more than `most`; each begins `overlap` rows
    before the next new one but after the last begin. Groups are dealt out by ranges of their order, so one of any size is spread
    over tasks (see `packing`). Places count from zero within the group.
    """

    return packing.pack(rows, group, order, cost, packing.Bounds(target, overlap, joint, most))


def hard_split(text: Column, limit: int) -> Column:
    """A text cut into pieces of at most `limit` characters: paragraphs packed together, longer ones sliced."""
    paragraphs = F.filter(F.split(text, r"\n\s*\n"), lambda p: F.trim(p) != "")
    slices = F.flatten(
        F.transform(
            paragraphs,
            lambda p: F.transform(
                F.sequence(F.lit(0), F.floor((F.length(p) - 1) / limit).cast("int")), lambda i: F.substring(p, i * limit + 1, F.lit(limit))
            ),
        )
    )

    def add(pieces: Column, piece: Column) -> Column:
        joined = F.concat(F.element_at(pieces, -1), F.lit("\n\n"), piece)
        fits = (F.size(pieces) > 0) & (F.length(joined) <= limit)
        return F.when(fits, F.concat(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.array(joined))).otherwise(F.concat(pieces, F.array(piece)))

    return F.aggregate(slices, F.array().cast("array<string>"), add)


def chunk(messages: DataFrame, target: int, overlap: int = 0) -> DataFrame:
    """session_id, chunk, first, last, chars: runs of messages (session_id, turn, role, content) up to a target size.

    A message costs its role, its content and eight characters, and one more unless it is first; it is never split.
    """
    cost = F.length(F.coalesce("role", F.lit(""))) + F.length(F.coalesce("content", F.lit(""))) + 8
    return pack(messages.withColumn("cost", cost), "session_id", "turn", "cost", target, overlap, joint=1).withColumnRenamed("size", "chars")


def changed(incoming: DataFrame, ledger: DataFrame, keys: list[str], digest: str = "digest") -> DataFrame:
    """incoming rows whose digest the ledger does not hold for their keys."""
    return incoming.join(ledger.select(*keys, digest), [*keys, digest], "left_anti")


def onboard(docs: DataFrame, ledger: DataFrame, budget: int = 40_000) -> tuple[DataFrame, DataFrame]:
    """What a source still has to take in: pending documents, and batches of them by a budget of characters.

    docs: source, provenance, text; ledger: source, provenance, digest of earlier runs. A document is pending
    unless the ledger holds the digest of its text. Batches (source, chunk, first, last, size) run over a source's pending documents
    in order of provenance; a document over the budget has one of its own. The ledger is extended only by
    documents whose batch is done. Only sizes and provenances are packed, not texts.
    """
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    pending = changed(docs.withColumn("digest", digest), ledger, ["source", "provenance"])
    sizes = pending.select("source", "provenance", F.length(F.coalesce("text", F.lit(""))).alias("chars"))
    return pending, pack(sizes, "source", "provenance", "chars", budget)


def orphans(memories: DataFrame, edges: DataFrame) -> DataFrame:
    """Memories (column id) that no edge names as its evidence (column memory_id): those whose graph is still to be made."""
    return memories.join(edges.select(F.col("memory_id").alias("id")), "id", "left_anti")


def adopt(orphaned: DataFrame, batches: DataFrame, edges: DataFrame) -> DataFrame:
    """id, chunk, edges, adopted: memories without edges after their batches came back.

    orphaned: profile_id, id; batches: profile_id, chunk, first, last (places in order of id), done; edges: memory_id, what a model gave. A batch
    that is done stamps all its memories, so that those without an edge are not asked about again; those of a failed one stay as they were.
    """
    place = F.row_number().over(Window.partitionBy("profile_id").orderBy("id")) - 1
    placed = orphaned.select("profile_id", "id", place.cast("long").alias("place"))
    spans = batches.select("profile_id", "chunk", "done", F.explode(F.sequence("first", "last")).alias("place"))
    counted = edges.groupBy(F.col("memory_id").alias("id")).agg(F.count("*").alias("edges"))
    met = placed.join(spans, ["profile_id", "place"]).join(counted, "id", "left")
    return met.select("id", "chunk", F.when(F.col("done"), F.coalesce("edges", F.lit(0))).otherwise(0).alias("edges"), F.col("done").alias("adopted"))


def admitted(denied: tuple[str, ...]) -> Column:
    """Traces worth keeping: failures, tools that always are, and tools that are not on the list."""
    tool = F.lower("tool")
    return (F.col("status") == "failure") | tool.isin(*ALWAYS_KEPT) | ~tool.isin(*denied)


def _line(text: Column, place: int) -> Column:
    """The first (1) or last (-1) line of a text that is not blank, trimmed; null without any."""
    lines = F.filter(F.transform(F.split(text, r"\R"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.try_element_at(lines, F.lit(place))


def signal_line() -> Column:
    """The line of a trace (error, output) worth quoting: the first of its error, else the last of its output."""
    return F.coalesce(_line(F.col("error"), 1), _line(F.col("output"), -1), F.lit("no output"))


def invocation() -> Column:
    """How a call (tool, args) reads; the shell goes unnamed, as its arguments name the program."""
    args = F.trim(F.coalesce("args", F.lit("")))
    return F.when(args == "", F.col("tool")).when(F.col("tool") == "Bash", args).otherwise(F.concat("tool", F.lit(" "), args))


def event(calls: DataFrame, received: Column, budget: int, root: str, home: str) -> DataFrame:
    """calls (tool, args, output, error, started_at, ended_at, ...) made clean, with occurred_at, from_receipt and hits.

    Bodies are cut, secrets masked (hits counts them) and paths shortened. A call occurred when it ended, else when it
    started, else when it was received. Null bodies stay null.
    """
    hits = F.lit(0)
    for name in ("args", "output", "error"):
        hits = hits + F.coalesce(text.redact(text.truncate_head_tail(F.col(name), budget))[1], F.lit(0))
    found = calls.withColumns(
        {
            "hits": hits,
            "occurred_at": F.coalesce("ended_at", "started_at", received),
            "from_receipt": F.col("ended_at").isNull() & F.col("started_at").isNull(),
        }
    )
    return found.withColumns({n: text.scrub(F.col(n), budget, root, home) for n in ("args", "output", "error")})


def outcome(traces: DataFrame) -> DataFrame:
    """traces (tool, args, status, exit_code, output, error) with signature, topic_key, content and error_digest of their outcome.

    The digest is that of the error, or of the output where the error is blank.
    """
    signature = text.command_signature(F.col("tool"), F.col("args"))
    said = F.concat(F.lit("`"), invocation(), F.lit("`"))
    exit_ = F.coalesce(F.concat(F.lit(" (exit "), F.col("exit_code").cast("string"), F.lit(")")), F.lit(""))
    content = (
        F.when(F.col("status") == "failure", F.concat(said, F.lit(" failed"), exit_, F.lit(": "), signal_line()))
        .when(F.col("status") == "success", F.concat(said, F.lit(" succeeded"), exit_))
        .otherwise(F.concat(said, F.lit(" ran; outcome unknown")))
    )
    blank = F.coalesce(F.trim(F.regexp_replace("error", r"\s+", " ")), F.lit("")) == ""
    return traces.withColumns(
        {
            "signature": signature,
            "topic_key": F.concat(F.lit("trace:outcome:"), signature),
            "content": content,
            "error_digest": text.error_digest(F.when(blank, F.col("output")).otherwise(F.col("error"))),
        }
    )


def due_chunks(chunks: DataFrame, ledger: DataFrame, ended: DataFrame) -> DataFrame:
    """chunks (session_id, chunk, digest, ...) to take in now.

    Not those whose digest the ledger holds, nor the last one of a session that has not ended (ended: session_id), as it may still grow.
    """
    last = chunks.groupBy("session_id").agg(F.max("chunk").alias("last"))
    open_ = last.join(ended.select("session_id").distinct(), "session_id", "left_anti").select("session_id", F.col("last").alias("chunk"))
    return changed(chunks, ledger, ["session_id", "chunk"]).join(open_, ["session_id", "chunk"], "left_anti")


def new_tokens(chunks: DataFrame, said: DataFrame) -> DataFrame:
    """session_id, chunk, tokens: what each chunk (first, last) adds to those before it, whose turns it may repeat.

    said: session_id, place, tokens. A turn counts for the first chunk that has it.
    """
    along = Window.partitionBy("session_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.greatest("first", F.coalesce(F.max("last").over(along) + 1, F.lit(0)))
    fresh = chunks.withColumn("begin", begin)
    places = fresh.where("begin <= last").select("session_id", "chunk", F.explode(F.sequence("begin", "last")).alias("place"))
    sums = places.join(said, ["session_id", "place"]).groupBy("session_id", "chunk").agg(F.sum("tokens").alias("tokens"))
    return chunks.select("session_id", "chunk").join(sums, ["session_id", "chunk"], "left").select("session_id", "chunk", F.coalesce("tokens", F.lit(0)).alias("tokens"))


def route(mode: Column, content: Column, source: Column) -> Column:
    """`verify` or `pass` for a statement: by mode all (always), none (never), or those that their source does not bear out."""
    return F.when((mode == "always") | ((mode != "never") & ~text.grounded(content, source)), F.lit("verify")).otherwise(F.lit("pass"))


def capture(body: Column, limit: int) -> list[Column]:
    """A bounded capture of a body: its beginning, its size in bytes, its digest, whether it was cut."""
    return [
        F.left(body, F.lit(limit)).alias("prefix"),
        F.octet_length(body).cast("long").alias("n_bytes"),
        F.sha2(body, 256).alias("sha256"),
        (F.length(body) > limit).alias("truncated"),
    ]


def _named(pattern: str, group: int, *columns: str) -> Column:
    """What a pattern finds in the columns, in order, each name once; nulls have none."""
    found = [F.coalesce(F.regexp_extract_all(F.col(c), F.lit(pattern), F.lit(group)), F.array().cast("array<string>")) for c in columns]
    return F.filter(F.array_distinct(F.concat(*found)), lambda x: F.trim(x) != "")


def trace_triples(calls: DataFrame, ident: str, most: int = 24, entities: int = 24) -> DataFrame:
    """ident, place, source, relation, target: what calls (tool, args, status, error, output) say as edges.

    A tool invoked a command; a failed command failed in tests, a command validates modules, and one of an editing tool touched files. At most
    `most` edges for each call; if they name over `entities` ends, half as many edges as that. A call without arguments says nothing.
    """
    name = text.normalize_entity
    command = name(F.trim(F.replace(invocation(), F.lit("./"), F.lit(""))))

    def edges(source: Column, relation: str, targets: Column) -> Column:
        return F.transform(targets, lambda t: F.struct(source.alias("source"), F.lit(relation).alias("relation"), name(t).alias("target")))

    none = F.array().cast("array<string>")
    tool = name(F.col("tool"))
    said = F.concat(
        F.transform(F.filter(F.array(tool), lambda t: t != ""), lambda t: F.struct(t.alias("source"), F.lit("invoked").alias("relation"), command.alias("target"))),
        edges(command, "failed_in", F.when(F.col("status") == "failure", _named(FAILED_TEST, 1, "error", "output")).otherwise(none)),
        edges(command, "validates", _named(MODULE_TASK, 1, "args")),
        edges(command, "touched", F.when(F.lower("tool").isin(*EDITING), _named(SOURCE_PATH, 0, "args")).otherwise(none)),
    )
    ends = F.size(F.array_distinct(F.flatten(F.transform("x", lambda e: F.array(e["source"], e["target"])))))
    cut = calls.where(F.trim(F.coalesce("args", F.lit(""))) != "").select(ident, F.slice(said, 1, most).alias("x"))
    kept = F.when(ends > entities, F.slice("x", 1, max(1, entities // 2))).otherwise(F.col("x"))
    return cut.select(ident, F.posexplode(kept).alias("place", "e")).select(ident, "place", "e.*")


def trace_links(calls: DataFrame, symbols: DataFrame, ident: str, most: int) -> DataFrame:
    """ident, symbol: symbols (symbol, qualified, name) that a call's error, output and arguments name, `most` of each call.

    Qualified names in stack frames come first, then tests that failed and stems of files; of equals the smaller symbol.
    """
    bodies = ("error", "output", "args")
    bare = F.array_distinct(F.concat(_named(FAILED_NAME, 1, *bodies), _named(SOURCE_STEM, 1, *bodies)))
    found = calls.select(ident, _named(STACK_FRAME, 1, *bodies).alias("qualified"), bare.alias("bare"))

    def of_name(key: str) -> DataFrame:
        # What has `most` smaller symbols of its name before it is not among a call's first; so a common name does not meet calls with all its symbols.
        along = F.row_number().over(Window.partitionBy(key).orderBy("symbol"))
        return symbols.select("symbol", key).distinct().withColumn("place", along).where(F.col("place") <= most).select("symbol", key)

    by = [
        found.select(ident, F.explode(side).alias(key)).join(of_name(key), key).select(ident, "symbol", F.lit(n).alias("p"))
        for n, (side, key) in enumerate((("qualified", "qualified"), ("bare", "name")))
    ]
    first = by[0].unionByName(by[1]).groupBy(ident, "symbol").agg(F.min("p").alias("p"))
    rank = F.row_number().over(Window.partitionBy(ident).orderBy("p", "symbol"))
    return first.withColumn("rank", rank).where(F.col("rank") <= most).select(ident, "symbol")


def candidates(answers: DataFrame, keys: list[str]) -> DataFrame:
    """keys, candidate, sample, n: what a model's answers (keys, sample, answer as a JSON list of type and content) hold, each once.

    Candidates are one if their types and contents are, but for case and white space at the ends of either; the first sample that
    has one counts, n says in how many it is. Malformed answers, blank types and contents count for nothing.
    """
    parsed = answers.select(*keys, "sample", F.explode(F.from_json("answer", "array<struct<type: string, content: string>>")).alias("x"))
    kind, said = F.lower(F.trim("x.type")), F.lower(F.trim("x.content"))
    kept = parsed.where((kind != "") & (said != "")).select(*keys, "sample", F.concat(kind, F.lit(":"), said).alias("candidate"))
    return kept.groupBy(*keys, "candidate").agg(F.min("sample").alias("sample"), F.count_distinct("sample").alias("n"))


def accepted_conflicts(decisions: DataFrame) -> DataFrame:
    """incoming, revision_id: the decision of a model that stands, if exactly one does.

    decisions: incoming, revision_id, relationship, content, old (both texts), subjects (array: what both must hold), evidence, old_evidence.
    A replacement or correction stands if its evidence and subjects occur in the texts, but for case and spacing.
    """

    def holds(body: str, part: Column) -> Column:
        return (F.length(F.trim(part)) > 0) & F.contains(text.collapse(F.col(body)), text.collapse(part))

    both = F.forall("subjects", lambda s: holds("content", s) & holds("old", s))
    stands = F.col("relationship").isin("replacement", "correction") & holds("content", F.col("evidence")) & holds("old", F.col("old_evidence")) & both
    kept = decisions.where(F.coalesce(stands, F.lit(False)))
    one = kept.groupBy("incoming").agg(F.min("revision_id").alias("revision_id"), F.count("*").alias("n"))
    return one.where("n = 1").drop("n")


def recipes(calls: DataFrame, known: DataFrame, statements: DataFrame, most: int = 3) -> DataFrame:
    """batch, recipe: statements of a model about batches of calls that are worth keeping, the first `most` of each batch.

    calls: batch, signature, status; known: signature; statements: batch, recipe, place, statement, log, confirmed. A batch is worth a model's
    call if a call failed or has an unknown signature. A statement is kept if the log bears it out, or a second look confirmed it.
    """
    seen = known.select("signature").distinct().withColumn("seen", F.lit(True))
    new = (F.col("status") == "failure") | F.col("seen").isNull()
    worth = calls.join(seen, "signature", "left").groupBy("batch").agg(F.bool_or(new).alias("worth")).where("worth").select("batch")
    kept = statements.where(text.grounded(F.col("statement"), F.col("log")) | F.col("confirmed")).join(worth, "batch", "left_semi")
    rank = F.row_number().over(Window.partitionBy("batch").orderBy("place"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= most).select("batch", "recipe", "statement")


def index_files(files: DataFrame, ledger: DataFrame, symbols: DataFrame, most: int = 8, listed: int = 30) -> DataFrame:
    """files (path, digest, ...) that the ledger does not hold as they are, with fact, defines and targets.

    symbols: path, kind, name, line, order. The fact names what a file defines, the first `listed` symbols by order; targets are the symbols
    to which the graph gets an edge from the file, the first `most`, and defines is their number. These replace what earlier versions of the files gave.
    """
    new = changed(files, ledger, ["path"])
    rank = F.row_number().over(Window.partitionBy("path").orderBy("order", "line"))
    first = symbols.join(new.select("path"), "path", "left_semi").withColumn("rank", rank).where(F.col("rank") <= listed)
    named = F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(" ", "kind", "name").alias("name"))))
    ends = F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", "name"))))
    told = first.groupBy("path").agg(named.alias("x"), F.transform(ends, lambda e: e["name"]).alias("t"))
    names = F.coalesce(F.array_join(F.transform("x", lambda s: s["name"]), ", "), F.lit("nothing"))
    return new.join(told, "path", "left").withColumns(
        {
            "fact": F.concat(F.lit("It defines "), names, F.lit(".")),
            "defines": F.coalesce(F.size("t"), F.lit(0)).cast("long"),
            "targets": F.coalesce("t", F.array().cast("array<string>")),
        }
    ).drop("x", "t")
