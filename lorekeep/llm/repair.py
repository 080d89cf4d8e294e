"""Repair of the structure of conversations, by a min-plus scan over 4 x 4 matrices.

A repaired conversation is empty, or an optional system turn and then user and assistant in alternation, the assistant last.
The four states are what came last: nothing, system, user, assistant. A turn is a matrix of its cheapest edits from state to state, each
an element (cost, audit), with any insertions before it (the closure); elements are added by taking the lesser and
multiplied by adding costs and joining audits. Two audits of equal cost over the same turns never begin one another (they
would differ by insertions, which cost), so the lesser stays the lesser whatever follows, and the product is associative.

Turns are dealt out in order by sampled ranges. A conversation that lies in one range is repaired there. What lies in
several gives a matrix for each range; these are multiplied as a tree, MERGED at a time, each keeping the states that it passes at
the ranges' borders, so that in a second pass every range knows where it begins and ends and writes its repaired turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import BLANK, HOT, divide, slices, stash, straddlers

KEEP, REROLE, DELETE, INSERT, MEND = 0, 3, 4, 3, 3
SOUND, EMPTY, REPEATED, CUT = range(4)
#: What follows each state, and the state that it leads to.
NEXT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
#: What an initial leads to from a state.
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
FINAL = (0, 3)
LEGAL = {"su", "ua", "au"}
#: Segments of a conversation that one task multiplies.
MERGED = 16
#: Leading characters of a text that take part in the order of turns of equal number.
LEADING = 64
#: Code points of repaired text, or a turn more, that travel as one row.
PIECE = 1 << 20

Element = tuple[int, str, str]  # cost, audit, states passed
Matrix = tuple[Element | None, ...]  # 16, by rows


def _lesser(x: Element | None, y: Element | None) -> Element | None:
    return y if x is None else x if y is None else min(x, y)


def times(x: Matrix, y: Matrix) -> Matrix:
    out: list[Element | None] = []
    for row in range(0, 16, 4):
        for column in range(4):
            best = None
            for k in range(4):
                a, b = x[row + k], y[4 * k + column]
                if a is not None and b is not None and (best is None or a[0] + b[0] <= best[0]):
                    best = _lesser(best, (a[0] + b[0], a[1] + b[1], a[2] + b[2]))
            out.append(best)
    return tuple(out)


def _matrix(edges: Iterable[tuple[int, int, int, str]]) -> Matrix:
    out: list[Element | None] = [None] * 16
    for i, j, cost, letter in edges:
        out[4 * i + j] = _lesser(out[4 * i + j], (cost, letter, ""))
    return tuple(out)


@lru_cache
def closure() -> Matrix:
    """Any number of insertions; from no state are more than two of use."""
    none = _matrix((i, i, 0, "") for i in range(4))
    one = _matrix((i, NEXT[i][1], INSERT, "I") for i in range(4))
    some = tuple(map(_lesser, none, one))
    return tuple(map(_lesser, some, times(some, one)))


@lru_cache
def turn_matrix(code: int) -> Matrix:
    """Of a turn's code: its fault and, times four, its initial's place in "sua" (or 3)."""
    fault, initial = code % 4, "sua?"[code // 4]
    edges = [(i, i, DELETE, "D") for i in range(4)]
    if fault in (SOUND, CUT):
        more = MEND if fault == CUT else 0
        edges += [(i, NEXT[i][1], REROLE + more, "R") for i in range(4)]
        edges += [(i, j, KEEP + more, "K") for i, j in STEPS.get(initial, {}).items()]
    return times(closure(), _matrix(edges))


@lru_cache(maxsize=1 << 14)
def _few(codes: bytes) -> Matrix:
    return turn_matrix(codes[0]) if len(codes) == 1 else times(_few(codes[: len(codes) // 2]), _few(codes[len(codes) // 2 :]))


def product(codes: bytes) -> Matrix:
    """The matrix of a stretch of turns, as a balanced tree."""
    if len(codes) <= 4:
        return _few(codes)
    half = 1 << (len(codes) - 1).bit_length() - 1  # so that lower levels meet the same few turns
    return times(product(codes[:half]), product(codes[half:]))


def outcome(matrix: Matrix) -> Element:
    """The cheapest repair of a whole conversation."""
    whole = times(matrix, closure())
    return min(e for f in FINAL if (e := whole[f]) is not None)


def ending(state: int) -> str:
    """The insertions that the closure makes after the last turn."""
    return "" if state in FINAL else "I" if state == 2 else "II"


def lines(turns: Iterable[tuple[str, str]], audit: str, state: int = 0) -> Iterator[str]:
    """The repaired turns as role:text."""
    left = iter(turns)
    for letter in audit:
        if letter == "D":
            next(left)
        elif letter == "K":
            role, text = next(left)
            state = STEPS[role[:1]][state]
            yield f"{role}:{text}"
        else:
            role, state = NEXT[state]
            yield f"{role}:{next(left)[1] if letter == 'R' else ''}"


def code_of(role: str, fault: int) -> int:
    return 4 * ("sua".find(role[:1]) % 4 if role else 3) + fault


COUNTS = ["blank", "duplicate", "truncated", "illegal"]
SUMMARY = "low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, head string, tail string"
ELEMENTS = "matrix array<struct<cost: long, audit: string, path: string>>"


def joined(x: dict, y: dict) -> dict:
    """The summary of two stretches of a conversation, one after the other."""
    both = {c: x[c] + y[c] for c in COUNTS}
    both["illegal"] += x["tail"] + y["head"] not in LEGAL
    same = x["high"] is not None and x["high"] == y["low"]
    return both | {
        "low": y["low"] if x["low"] is None else x["low"],
        "high": x["high"] if y["high"] is None else y["high"],
        "turns": x["turns"] + y["turns"] - same,
        "head": x["head"],
        "tail": y["tail"],
    }


def _ordered(turns: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """The turns in order by ranges (column block), with their first fault."""
    who, said = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role, text))
    plain = turns.select(F.col(conversation).alias("conv_id"), F.col(turn).cast("long").alias("turn"), who.alias("role"), said.alias("text"))
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    bare = F.regexp_replace("text", BLANK, "")
    fault = F.when(bare == "", EMPTY).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(SOUND)
    rows = plain.withColumns({
        "of": F.struct("conv_id"),
        "d1": F.conv(F.substring(digest, 1, 16), 16, -10).cast("long"),
        "d2": F.conv(F.substring(digest, 17, 16), 16, -10).cast("long"),
        "fault": fault,
    })
    # What is said at several turns; what is said twice at one turn stands side by side and is found later.
    key = ["of", "d1", "d2"]
    when = F.struct("turn")
    told = rows.where(F.col("fault") != EMPTY).groupBy(*key).agg(
        F.min(when).alias("first"), F.max(when).alias("final"), F.count("*").alias("n")
    )
    told = stash(told.where("first != final").select(*key, F.struct("first").alias("first"), "n"))
    rare, perhaps = divide(rows, told.select(*key), key)
    hot = F.col("n") * HOT > (told.agg(F.sum("n")).first()[0] or 0)
    marked = perhaps.join(F.broadcast(told.where(hot).drop("n")), key, "left")  # fewer than HOT rows
    cold = marked.where("first IS NULL").drop("first").join(told.where(~hot).drop("n"), key, "left")
    seen = marked.where("first IS NOT NULL").unionByName(cold)
    later = F.coalesce(F.struct("turn") > F.col("first.first"), F.lit(False))
    seen = seen.withColumn("fault", F.when(later & (F.col("fault") != EMPTY), REPEATED).otherwise(F.col("fault"))).drop("first")
    rows = rare.unionByName(seen).withColumns({"lead": F.left("text", F.lit(LEADING)), "row": F.monotonically_increasing_id()})
    by = ["conv_id", "turn", "role", "lead", "d1", "d2", "row"]
    dealt = rows.drop("of").repartitionByRange(*by).sortWithinPartitions(*by).withColumn("block", F.spark_partition_id())
    return stash(dealt.drop("row", "lead"))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[dict, int]]]]:
    """Each stretch (block and conversation) of ordered turns: its first row, and its rows with their faults."""

    def rows() -> Iterator[dict]:
        for batch in slices(batches):
            yield from batch.to_pylist()

    def faulted(turns: Iterable[dict], twin: bool) -> Iterator[tuple[dict, int]]:
        before = None
        for x in turns:
            own = x["turn"], x["d1"], x["d2"]
            twin, before = twin if before is None else own == before, own
            yield x, REPEATED if twin and x["fault"] != EMPTY else x["fault"]

    block = None
    for (own, _), turns in groupby(rows(), lambda x: (x["block"], x["conv_id"])):
        first = next(turns)
        begins, block = own != block, own  # only the first turn of a block can have its twin in another
        yield first, faulted(chain((first,), turns), begins and first["twin"])


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each stretch: its summary and, for a whole conversation, the repair, else the matrix."""
    out: list[dict] = []
    for first, turns in _stretches(batches):
        sums = {"low": None, "high": None, "turns": 0, "head": first["role"][:1], "tail": None, **dict.fromkeys(COUNTS, 0)}
        codes, texts = bytearray(), []
        for x, fault in turns:
            initial = x["role"][:1]
            if fault != SOUND:
                sums[COUNTS[fault - 1]] += 1
            if sums["tail"] is not None:
                sums["illegal"] += sums["tail"] + initial not in LEGAL
            sums["tail"] = initial
            if x["turn"] is not None and x["turn"] != sums["high"]:
                sums["turns"] += 1
                sums["high"] = x["turn"]
                sums["low"] = x["turn"] if sums["low"] is None else sums["low"]
            codes.append(code_of(x["role"], fault))
            if not first["open"]:
                texts.append((x["role"], x["text"]))
        whole = product(bytes(codes))
        row = {"conv_id": first["conv_id"], "block": first["block"], **sums, "matrix": None, "cost": None, "audit": None, "sha256": None}
        if first["open"]:
            named = [e and (*e[:2], str(i % 4)) for i, e in enumerate(whole)]
            row["matrix"] = [e and dict(zip(("cost", "audit", "path"), e)) for e in named]
        else:
            row["cost"], row["audit"], _ = outcome(whole)
            row["sha256"] = hashlib.sha256("\n".join(lines(texts, row["audit"])).encode()).hexdigest()
        out.append(row)
        if len(out) >= 256 or first["open"]:
            yield pa.RecordBatch.from_pylist(out, RESULT)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, RESULT)


_ELEMENTS = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string()), ("path", pa.string())]))
_SUMMARY = [(c, pa.int64()) for c in ("low", "high", "turns", *COUNTS)] + [("head", pa.string()), ("tail", pa.string())]
RESULT = pa.schema(
    [("conv_id", pa.int64()), ("block", pa.int32()), *_SUMMARY, ("matrix", _ELEMENTS)]
    + [("cost", pa.int64()), ("audit", pa.string()), ("sha256", pa.string())]
)
REPAIRED = pa.schema([("conv_id", pa.int64()), ("block", pa.int32()), ("part", pa.int32()), ("piece", pa.binary())])
SEGMENT = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), *_SUMMARY, ("matrix", _ELEMENTS)])


def _multiply(segments: pa.Table) -> pa.Table:
    """Up to MERGED segments of a conversation as one."""
    rows = sorted(segments.to_pylist(), key=lambda x: x["at"])
    parts = [(x, tuple(e and (e["cost"], e["audit"], e["path"]) for e in x["matrix"])) for x in rows]
    while len(parts) > 1:
        pairs = [parts[i : i + 2] for i in range(0, len(parts), 2)]
        parts = [(joined(p[0][0], p[1][0]), times(p[0][1], p[1][1])) if len(p) == 2 else p[0] for p in pairs]
    sums, matrix = parts[0]
    elements = [e and dict(zip(("cost", "audit", "path"), e)) for e in matrix]
    row = {k: sums[k] for k, _ in _SUMMARY} | {"conv_id": rows[0]["conv_id"], "at": rows[0]["at"], "matrix": elements}
    return pa.Table.from_pylist([row], SEGMENT)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, block, part, piece: the repaired turns of stretches, each turn after a line feed."""
    for first, turns in _stretches(batches):
        held = [(x["role"], x["text"], code_of(x["role"], fault)) for x, fault in turns]
        found = product(bytes(c for *_, c in held))[4 * first["entry"] + first["exit"]]
        audit = found[1] + (ending(first["exit"]) if first["final"] else "")
        part, piece, size = 0, [], 0
        for line in [*lines((x[:2] for x in held), audit, first["entry"]), None]:
            if line is not None:
                piece.append(f"\n{line}")
                size += len(line)
            if piece and (line is None or size >= PIECE):
                row = {"conv_id": first["conv_id"], "block": first["block"], "part": part, "piece": "".join(piece).encode()}
                yield pa.RecordBatch.from_pylist([row], REPAIRED)
                part, piece, size = part + 1, [], 0


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, sha256: of the pieces, which come in order and are let go one by one; without the first line feed."""
    rows = (x for batch in batches for x in batch.to_pylist())
    for conversation, pieces in groupby(rows, lambda x: x["conv_id"]):
        state = hashlib.sha256(next(pieces)["piece"][1:])
        for x in pieces:
            state.update(x["piece"])
        yield pa.RecordBatch.from_arrays([pa.array([conversation], pa.int64()), pa.array([state.hexdigest()])], ["conv_id", "sha256"])


def _of_several_ranges(dealt: DataFrame, segments: DataFrame) -> DataFrame:
    """The repairs of conversations of several ranges, of their segments (a row for each range)."""
    at = F.row_number().over(Window.partitionBy(F.struct("conv_id")).orderBy("block")) - 1
    leaves = stash(segments.withColumn("at", at.cast("long")))
    most = (leaves.agg(F.max("at")).first()[0] or 0) + 1
    merged = leaves.select("conv_id", "at", *(k for k, _ in _SUMMARY), "matrix")
    span = 1
    while span < most:
        span *= MERGED
        group = F.struct("conv_id", F.floor(F.col("at") / span))
        merged = merged.groupBy(group.alias("group")).applyInArrow(_multiply, f"conv_id long, at long, {SUMMARY}, {ELEMENTS}")

    @F.arrow_udf("struct<cost: long, audit: string, path: string>")
    def choose(matrices: pa.Array) -> pa.Array:
        found = [outcome(tuple(e and (e["cost"], e["audit"], e["path"]) for e in m)) for m in matrices.to_pylist()]
        return pa.array([dict(zip(("cost", "audit", "path"), e)) for e in found], _ELEMENTS.value_type)

    chosen = stash(merged.withColumn("best", choose("matrix")).select(F.struct("conv_id").alias("of"), *(k for k, _ in _SUMMARY), "best"))
    path = F.col("best.path")
    state = [F.substring(path, F.col("at") + F.lit(x), F.lit(1)).cast("int") for x in (0, 1)]
    borders = leaves.select(F.struct("conv_id").alias("of"), "block", "at").join(chosen.select("of", "best"), "of").select(
        "of",
        "block",
        F.when(F.col("at") == 0, 0).otherwise(state[0]).alias("entry"),
        state[1].alias("exit"),
        (F.col("at") + 1 == F.length(path)).alias("final"),
    )
    rows = dealt.withColumn("of", F.struct("conv_id")).join(F.broadcast(borders), ["of", "block"]).drop("of")  # two rows a range at most
    pieces = rows.mapInArrow(_pieces, "conv_id long, block int, part int, piece binary")
    order = ["conv_id", "block", "part"]
    digests = pieces.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_digests, "conv_id long, sha256 string")
    digests = digests.select(F.struct("conv_id").alias("of"), "sha256")
    return chosen.join(digests, "of", "left").select(
        "of.conv_id", *(k for k, _ in _SUMMARY), "best.cost", "best.audit", F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("sha256")
    )


def repair(
    turns: DataFrame, conversations: DataFrame | None = None, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Turns are ordered by number (null first), then role, then text (its first 64 code points, then its digest). A turn's first fault counts: blank,
    duplicate (its role and text came earlier), truncated (does not end with . ! or ?). gaps counts the numbers missing between
    the least and the greatest. illegal counts neighbours whose initials are not su, ua or au. audit has a letter for each edit of the cheapest repair (Keep,
    Rerole, Delete, Insert), the least string of equally cheap ones; the digest is of the repaired turns as role:text, joined by line feeds.

    Null roles and texts are one space, null ids make up one conversation. `conversations` (a column of that name) adds ids without
    turns: zeros and empty strings. Repeated rows are duplicates. An empty table gives no rows but those. Other columns, whatever their names,
    are ignored. A task holds at most one range of turns; a conversation of many ranges is digested piece by piece.
    """
    dealt = _ordered(turns.withColumn(conversation, F.col(conversation).cast("long")), conversation, turn, role, text)
    where = ["conv_id", "turn", "role", "d1", "d2"]
    edge = dealt.groupBy("block").agg(F.min(F.struct(*where)).alias("low"), F.max(F.struct(*where)).alias("high"))
    # A row for each range: whether its first turn is the twin of the last one before it.
    twins = edge.select("block", F.coalesce(F.col("low") == F.lag("high").over(Window.orderBy("block")), F.lit(False)).alias("twin"))
    cut = stash(straddlers(dealt, "conv_id", "block").withColumn("open", F.lit(True)))
    keyed = dealt.join(F.broadcast(twins), "block").withColumn("of", F.struct("conv_id"))
    cut = cut.select(F.struct("conv_id").alias("of"), "block", "open")
    marked = keyed.join(F.broadcast(cut), ["of", "block"], "left").drop("of").withColumn("open", F.coalesce("open", F.lit(False)))
    schema = f"conv_id long, block int, {SUMMARY}, {ELEMENTS}, cost long, audit string, sha256 string"
    found = stash(marked.mapInArrow(_summarise, schema))
    columns = ["conv_id", *(k for k, _ in _SUMMARY), "cost", "audit", "sha256"]
    whole = found.where("matrix IS NULL").select(*columns)
    if not cut.isEmpty():
        segments = found.where("matrix IS NOT NULL").drop("cost", "audit", "sha256")
        whole = whole.unionByName(_of_several_ranges(marked, segments).select(*columns))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    out = whole.select("conv_id", gaps.alias("gaps"), *COUNTS, "cost", "audit", F.col("sha256").alias("repaired_sha256"))
    if conversations is None:
        return out
    out = stash(out)
    ids = conversations.select(F.struct(F.col(conversation).cast("long").alias("conv_id")).alias("of")).distinct()
    silent = ids.join(out.select(F.struct("conv_id").alias("of")), "of", "left_anti")
    zeros = [F.lit(0).cast("long").alias(c) for c in ("gaps", *COUNTS, "cost")]
    return out.unionByName(silent.select("of.conv_id", *zeros, F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256")))
