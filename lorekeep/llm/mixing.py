"""Temperature mixing of sources to target weights, in DataFrame operations only.

A source's weight is its share of tokens to the power of an exponent, normalised: 1 keeps the natural shares, 0
makes all equal. The exponent is bisected (many cuts a round, each round one small aggregation) to the
largest that reaches a target entropy, but held where no source is repeated beyond a limit. The weights are
then realised as budgeted block permutations: a source's documents are permuted anew for each epoch by hash;
whole epochs are taken while the source's token budget lasts, and of the last one the leading part, cut in a
block of the permutation that is found by halving hash ranges. Every block of the mixed stream draws on all
sources in proportion to their weights.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import own_name, stash, whole_text

#: Cuts of the exponent's range in each round, and rounds: a precision of CUTS ** -ROUNDS.
CUTS, ROUNDS = 32, 6
#: Sources that are broadcast at most; more of them meet the documents by a salted join.
FEW_SOURCES, SALTS = 10_000, 64
#: Bits of the permutation that each search for the cut resolves, and how often it is done before rows count.
RANGE_BITS, SEARCHES = 10, 2
TINY = 1e-9


@dataclass(frozen=True)
class Target:
    """What the mix is to meet. Shares of entropy are of its maximum, the logarithm of the number of sources.

    budget: tokens of the mix as a multiple of the tokens there are; None: the least by which every source
    keeps all its documents at least once.
    """

    entropy: float = 0.95
    repetition: float = 4.0
    budget: float | None = None
    block_tokens: int = 1_000_000
    seed: int = 7


def count_words(text: Column) -> Column:
    """Words between white space: the measure of tokens unless another is given."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _powers(share: Column, exponent: Column, budget: float | None) -> list[Column]:
    """Aggregates over sources: entropy, and the most that a source repeats."""
    p = F.pow(share, exponent)
    total, most, least = F.sum(p), F.max(F.pow(share, exponent - 1)), F.min(F.pow(share, exponent - 1))
    entropy = F.log(total) - exponent * F.sum(p * F.log(share)) / total
    return [entropy.alias("entropy"), (most / least if budget is None else most / total * budget).alias("repetition")]


def exponent(sources: DataFrame, target: Target) -> float:
    """The exponent for sources (share, over zero). A few numbers for each cut come to the driver."""
    wanted = F.lit(target.entropy) * F.log(F.count("*"))
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        cuts = [low + (high - low) * i / CUTS for i in range(CUTS + 1)]
        found = (
            sources.select("share", F.posexplode(F.array(*map(F.lit, cuts))).alias("place", "exponent"))
            .groupBy("place", "exponent")
            .agg(*_powers(F.col("share"), F.col("exponent"), target.budget), wanted.alias("wanted"))
            .orderBy("place")
            .collect()
        )
        if not found:
            return 1.0
        # Entropy and repetition both fall as the exponent grows.
        flat = max((r.place for r in found if r.entropy >= r.wanted - TINY), default=0)
        calm = min((r.place for r in found if r.repetition <= target.repetition + TINY), default=CUTS)
        place = max(flat, calm)
        # The answer lies between this cut and the next on the side where the deciding bound changes.
        ends = (place, min(place + 1, CUTS)) if flat >= calm else (max(place - 1, 0), place)
        low, high = cuts[ends[0]], cuts[ends[1]]
    return low if flat >= calm else high


def source_weights(rows: DataFrame, target: Target = Target()) -> DataFrame:
    """source, tokens, weight, repeats (epochs, with a fraction) from rows (source, tokens); in a few rows.

    Sources without tokens have weight zero and repeat once (their documents cost nothing).
    """
    sums = stash(rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents")))
    whole = sums.agg(F.sum("tokens")).first()[0] or 0
    shares = sums.withColumn("share", F.col("tokens") / F.lit(float(max(whole, 1))))
    power = exponent(shares.where("tokens > 0"), target)
    p = F.when(F.col("tokens") > 0, F.pow("share", F.lit(power))).otherwise(0.0)
    norm, steepest = (
        shares.where("tokens > 0")
        .agg(F.sum(F.pow("share", F.lit(power))), F.min(F.pow("share", F.lit(power - 1))))
        .first()
    )
    weight = p / F.lit(norm or 1.0)
    scale = (norm / steepest if norm else 1.0) if target.budget is None else target.budget
    repeats = F.when(F.col("tokens") > 0, weight * scale / F.col("share")).otherwise(1.0)
    return shares.select("source", "tokens", "documents", weight.alias("weight"), repeats.alias("repeats"))


def _join_sources(rows: DataFrame, table: DataFrame, few: bool, source: str) -> DataFrame:
    """rows beside their source's row of table (column `source` of both)."""
    if few:
        return rows.join(F.broadcast(table), source)
    salt = own_name(rows, "salt")
    salted = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn(salt, F.pmod(F.xxhash64(*rows.columns[:1], F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")).join(
        salted, [source, salt]
    ).drop(salt)


def _order(seed: int, epoch: Column, ident: Column) -> Column:
    return F.xxhash64(F.lit(seed), epoch.cast("long"), ident)


def _cuts(rows: DataFrame, plan: DataFrame, few: bool, seed: int) -> DataFrame:
    """source, full (whole epochs), bound: of the epoch after those, documents ordered below bound are taken."""
    full = F.floor(F.col("repeats") + TINY).cast("long")
    rest = F.greatest(F.lit(0.0), (F.col("repeats") - full) * F.col("tokens"))
    open_ = plan.where("tokens > 0").select("source", full.alias("full"), F.floor(rest + TINY).alias("rest"), F.lit(0).alias("done"))
    at = _join_sources(rows, open_.select("source", "full"), few, "source")
    at = stash(at.select("source", "tokens", _order(seed, F.col("full"), F.col("ident")).alias("h")))
    found, part = open_, at
    for level in [*range(1, SEARCHES + 1), 0]:
        # Ranges of the order by its leading bits; at last single places.
        block = F.shiftright("h", 64 - RANGE_BITS * level) if level else F.col("h")
        sums = part.groupBy("source", block.alias("block")).agg(F.sum("tokens").alias("t"))
        run = F.sum("t").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
        reached = _join_sources(sums.withColumn("reached", run), found.select("source", "full", "rest", "done"), few, "source")
        crossed = reached.where(F.col("done") + F.col("reached") > F.col("rest")).groupBy("source", "full", "rest").agg(
            F.min(F.struct("block", (F.col("done") + F.col("reached") - F.col("t")).alias("done"))).alias("x")
        )
        found = stash(crossed.select("source", "full", "rest", F.col("x.block").alias("block"), F.col("x.done").alias("done")))
        if level:
            part = _join_sources(part, found.select("source", F.col("block").alias("b")), few, "source").where(block == F.col("b")).drop("b")
    return found.select("source", "full", F.col("block").alias("bound"))


def mix(
    docs: DataFrame,
    target: Target = Target(),
    tokens: Column | None = None,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """The mixed stream: a row for each time that a document occurs, with the columns of docs and four more.

    Those (they replace columns of the same name) are mix_epoch, mix_weight (of the source), mix_block (of the
    stream, about block_tokens each) and mix_order (within the block). Each source gets its budget to
    within one document. A null source is the source ''; null texts are empty and cost nothing. Equal rows have
    equal places and go together; an empty table gives an empty stream. `tokens` is an expression over docs.
    """
    cost = count_words(whole_text(text)) if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0))
    ident = F.xxhash64(F.col(doc_id), whole_text(text))
    name = F.coalesce(F.col(source).cast("string"), F.lit(""))
    rows = stash(docs.select(name.alias("source"), cost.alias("tokens"), ident.alias("ident")))
    plan = stash(source_weights(rows.select("source", "tokens"), target))
    count, size = plan.agg(F.count("*"), F.sum(F.col("tokens") * F.col("repeats"))).first()
    few = count <= FEW_SOURCES
    cuts = _cuts(rows, plan, few, target.seed)
    table = plan.join(cuts, "source", "left")
    own = {c: own_name(docs, c) for c in ("source", "weight", "repeats", "full", "bound", "ident", "epoch", "order")}
    table = table.select(
        F.col("source").alias(own["source"]),
        F.col("weight").alias(own["weight"]),
        F.col("repeats").alias(own["repeats"]),
        F.coalesce("full", F.floor(F.col("repeats") + TINY)).alias(own["full"]),
        F.col("bound").alias(own["bound"]),
    )
    if few:
        table = stash(table)
    full, bound = F.col(own["full"]), F.col(own["bound"])
    placed = _join_sources(docs.withColumns({own["source"]: name, own["ident"]: ident}), table, few, own["source"])
    extra = F.coalesce((_order(target.seed, full, F.col(own["ident"])) < bound).cast("long"), F.lit(0))
    times = full + extra
    placed = placed.withColumn(
        own["epoch"], F.explode(F.when(times > 0, F.sequence(F.lit(0).cast("long"), times - 1)))
    )
    order = _order(target.seed, F.col(own["epoch"]), F.col(own["ident"]))
    placed = placed.withColumn(own["order"], order)
    blocks = max(1, round((size or 0) / target.block_tokens))
    along = (F.col(own["epoch"]) + (F.col(own["order"]) / F.lit(2.0**64) + 0.5)) / F.col(own["repeats"])
    kept = [c for c in docs.columns if c.lower() not in {"mix_epoch", "mix_weight", "mix_block", "mix_order"}]
    return placed.select(
        *kept,
        F.col(own["epoch"]).alias("mix_epoch"),
        F.col(own["weight"]).alias("mix_weight"),
        F.least(F.floor(along * blocks), F.lit(blocks - 1)).alias("mix_block"),
        F.col(own["order"]).alias("mix_order"),
    )
