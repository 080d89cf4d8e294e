"""SimHash near-duplicates: 64-bit fingerprints compared bit-sliced within blocks of candidates.

Fingerprints within a radius of r bits agree wholly on at least k of r + k bit blocks. Each distinct
fingerprint is therefore keyed by the bits of every choice of k blocks, and only those that share a key are
compared. (A wide fingerprint, for a similarity threshold, is too far apart for that; it is keyed by bands of
minimum hashes instead, and the same comparison decides.) A bucket of over CHUNK fingerprints is dealt out as pairs of chunks, so no task holds more than
about 2 * CHUNK of one bucket and none is left out. A comparison stores its fingerprints as 64 bit planes, a
machine word holding one bit of 64 fingerprints; the distances of 64 fingerprints to a query then grow
together in carry-save counters, and words whose fingerprints all exceed the radius are abandoned on the
way. A task returns a spanning forest of the links that it finds, never all pairs. For a similarity threshold
an exact check follows: the texts of each component of candidates meet once more, and only links whose shingles
do overlap that much count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import HOT, divide, meet, own_name, slices, stash, whole_text, without
from lorekeep.llm.components import connected_components

BITS, SEED = 64, 42
#: Fingerprints of one bucket that are compared in one go; larger buckets become pairs of chunks.
CHUNK = 4096
#: A bucket should hold about this many fingerprints by chance; it sets how many blocks a key takes.
BY_CHANCE = 512
#: A wide comparison looks every so many bits for words to abandon.
LOOK = 64
#: Words of the bit-sliced state of one comparison.
STATE_WORDS = 1 << 18
#: Rows of bits that are summed in bytes.
BYTE = 255
#: A wide fingerprint's words, and the bands of minimum hashes that key it. Texts that share 0.8 of their shingles
#: share one of 12 bands of 4 with probability 0.998.
WIDE, BANDS, BAND_ROWS = 8, 12, 4
#: Shingles of one component that are checked in one go; larger components become pairs of chunks.
CHUNK_SHINGLES = 1 << 20
#: The radius of wide fingerprints misses a link at the threshold with this probability at most, at any number of shingles.
MISSED = 0.001
#: Up to so many shingles in both texts together, the distance is worked out exactly; ties of the vote matter there.
FEW_SHINGLES = 40
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included, A-Z in lower case; of all words where a shingle takes more."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, "<u8")
    joined = b" ".join(found)
    starts = [0, *accumulate(len(w) + 1 for w in found)]
    n, width = max(1, len(found) - words + 1), min(words, len(found))
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a : b - 1], SEED) for a, b in zip(starts[:n], starts[width:], strict=True)), "<u8", n
    )


def majority(hashes: np.ndarray) -> np.ndarray:
    """For rows of hashes (n, words of 64 bits), the words whose bits are set in over half the rows."""
    counts = np.zeros(hashes.shape[1] * BITS, np.int64)
    for at in range(0, len(hashes), BYTE):  # sums of so many bits fit a byte
        part = np.ascontiguousarray(hashes[at : at + BYTE]).view(np.uint8)
        counts += np.add.reduce(np.unpackbits(part, axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")


def fingerprint(text: str, words: int = 4) -> int:
    """The fingerprint of a text: bit set where it is in over half the shingles' hashes; without words zero."""
    hashes = shingle_hashes(text, words)
    return int(majority(hashes[:, None])[0]) if len(hashes) else 0


def _mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def wide_fingerprint(text: str, words: int = 5) -> tuple[bytes, list[int], int]:
    """A fingerprint of WIDE words, the keys of its bands, the number of shingles; a text without words has zeros.

    All three are of the set of shingles, as the likeness is: each votes once, however often it occurs.
    """
    hashes = np.unique(shingle_hashes(text, words))
    if not len(hashes):
        return bytes(8 * WIDE), [0] * BANDS, 0
    steps = np.arange(1, WIDE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bits = np.zeros(WIDE * BITS, np.int64)
    least = np.full(BANDS * BAND_ROWS, ALL)
    turns = _mixed(np.arange(1, len(least) + 1, dtype=np.uint64)) | np.uint64(1)
    for at in range(0, len(hashes), BYTE):
        part = hashes[at : at + BYTE, None]
        wide = np.ascontiguousarray(_mixed(part + steps)).view(np.uint8)
        bits += np.add.reduce(np.unpackbits(wide, axis=1, bitorder="little"), axis=0, dtype=np.uint8)
        least = np.minimum(least, (part * turns).min(axis=0))
    keys = np.zeros(BANDS, np.uint64)
    for row in least.reshape(BAND_ROWS, BANDS):
        keys = _mixed(keys ^ row)
    return np.packbits(bits * 2 > len(hashes), bitorder="little").tobytes(), keys.view(np.int64).tolist(), len(hashes)


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def with_fingerprint(docs: DataFrame, words: int = 4, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs with its fingerprint as a signed long; null texts count as empty."""

    @F.arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in slices(batches):
            yield pa.array(_signed([fingerprint(x.as_py(), words) for x in part]))

    return docs.withColumn(name, of(whole_text(text)))


def bits_of(fingerprints: np.ndarray) -> np.ndarray:
    """The bits of fingerprints (n, words), low bit first, a row for each."""
    return np.unpackbits(np.ascontiguousarray(fingerprints, "<u8").view(np.uint8), axis=1, bitorder="little")


def bit_planes(fingerprints: np.ndarray) -> np.ndarray:
    """A row for each bit: bit i of word w in row p is bit p of fingerprint 64 w + i; lanes beyond are zero."""
    bits = bits_of(fingerprints)
    lanes = np.zeros((bits.shape[1], -(-len(bits) // BITS) * BITS), np.uint8)
    lanes[:, : len(bits)] = bits.T
    return np.packbits(lanes, axis=1, bitorder="little").view("<u8")


def _carry_save(total: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adds two bits to a counter bit: the new bit and the carry."""
    either = a ^ b
    return total ^ either, (a & b) | (total & either)


def _exceeds(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter (low bit first) is above the radius."""
    more, same = np.zeros_like(counter[0]), np.full_like(counter[0], ALL)
    for place in reversed(range(len(counter))):
        if radius >> place & 1:
            same = same & counter[place]
        else:
            more, same = more | (same & counter[place]), same & ~counter[place]
    return more


def within(queries: np.ndarray, planes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, word and lanes of all fingerprints within the radius of a query (n, words)."""
    width = planes.shape[1]
    masks = np.zeros((len(planes), len(queries)), np.uint64) - bits_of(queries).T
    row, word = np.repeat(np.arange(len(queries)), width), np.tile(np.arange(width), len(queries))
    over = np.zeros(len(row), np.uint64)
    counter = [over] * max(3, radius.bit_length())
    far, last = over, len(planes) - 8
    for p in range(0, len(planes), 8):
        d = planes[p : p + 8, word] ^ masks[p : p + 8, row]
        ones, twos, fours = counter[:3]
        ones, a = _carry_save(ones, d[0], d[1])
        ones, b = _carry_save(ones, d[2], d[3])
        twos, low = _carry_save(twos, a, b)
        ones, a = _carry_save(ones, d[4], d[5])
        ones, b = _carry_save(ones, d[6], d[7])
        twos, high = _carry_save(twos, a, b)
        fours, carry = _carry_save(fours, low, high)
        counter[:3] = ones, twos, fours
        for place in range(3, len(counter)):
            counter[place], carry = counter[place] ^ carry, counter[place] & carry
        over = over | carry
        if p == last or p % LOOK == LOOK - 8 or len(planes) <= BITS:
            far = over | _exceeds(counter, radius)
            alive = far != ALL
            if alive.mean() < 0.9:
                row, word, over, far = row[alive], word[alive], over[alive], far[alive]
                counter = [c[alive] for c in counter]
    return row, word, ~far


def near_lanes(fingerprints: np.ndarray, radius: int) -> np.ndarray:
    """A row for each fingerprint (n, words): the lanes of all others within the radius."""
    n, planes = len(fingerprints), bit_planes(fingerprints)
    near, step = np.zeros((n, planes.shape[1]), np.uint64), max(1, STATE_WORDS // planes.shape[1])
    for at in range(0, n, step):
        row, word, lanes = within(fingerprints[at : at + step], planes, radius)
        near[at + row, word] = lanes
    lanes = np.arange(n)
    near[:, -1] &= ALL >> np.uint64(-n % BITS)
    near[lanes, lanes // BITS] &= ~(np.uint64(1) << (lanes % BITS).astype(np.uint64))
    return near


def lanes_of(rows: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n fingerprints is in any of the rows of lanes."""
    reached = np.bitwise_or.reduce(rows, axis=0).view(np.uint8)
    return np.unpackbits(reached, bitorder="little")[:n].astype(bool)


def linked(fingerprints: np.ndarray, radius: int) -> np.ndarray:
    """A spanning forest, as rows of two positions, of the links among fingerprints (n, words)."""
    n, near = len(fingerprints), near_lanes(fingerprints, radius)
    seen, edges = np.zeros(n, bool), [np.empty((0, 2), np.int64)]
    for root in np.flatnonzero(near.any(axis=1)):
        if seen[root]:
            continue
        seen[root], front = True, np.array([root])
        while len(front):
            front = np.flatnonzero(lanes_of(near[front], n) & ~seen)
            seen[front] = True
            edges.append(np.column_stack([np.full(len(front), root), front]))
    return np.concatenate(edges)


def overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Jaccard likeness of a set of hashes to others; sets are ascending and not empty."""
    sizes = np.array([len(x) for x in others])
    laid = np.concatenate(others)
    place = np.minimum(np.searchsorted(one, laid), len(one) - 1)
    shared = np.add.reduceat((one[place] == laid).astype(np.int64), np.cumsum(sizes) - sizes)
    return shared / (len(one) + sizes - shared)


def linked_truly(fingerprints: np.ndarray, shingles: list[np.ndarray], radius: int, similarity: float) -> np.ndarray:
    """A spanning forest of the links that are within the radius and whose sets of shingles are as similar as that.

    A node is compared only with candidates that nothing has reached yet, so a group of copies costs one pass.
    """
    n, near = len(fingerprints), near_lanes(fingerprints, radius)
    sizes = np.array([len(x) for x in shingles])
    seen, edges = sizes == 0, [np.empty((0, 2), np.int64)]
    for root in np.flatnonzero(near.any(axis=1)):
        if seen[root]:
            continue
        seen[root], waiting = True, [root]
        while waiting:
            own = waiting.pop()
            alike = np.minimum(sizes, sizes[own]) >= similarity * np.maximum(sizes, sizes[own])
            open_ = np.flatnonzero(lanes_of(near[own : own + 1], n) & ~seen & alike)
            if len(open_):
                found = open_[overlaps(shingles[own], [shingles[i] for i in open_]) >= similarity]
                seen[found] = True
                waiting += found.tolist()
                edges.append(np.column_stack([np.full(len(found), own), found]))
    return np.concatenate(edges)


def block_masks(radius: int, equal: int) -> list[int]:
    """For every choice of `equal` out of radius + equal bit blocks, the mask of their bits, as a signed long."""
    edges = [BITS * i // (radius + equal) for i in range(radius + equal + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [int(np.uint64(sum(x)).astype(np.int64)) for x in combinations(blocks, equal)]


def blocks_in_key(count: int, radius: int) -> int:
    """How many blocks make a key, so that chance fills a bucket with BY_CHANCE fingerprints at most."""
    fits = (k for k in range(1, 5) if count >> k * (BITS // (radius + k)) <= BY_CHANCE)
    return next(fits, 4)


def links(keyed: DataFrame, radius: int, wide: bool = False) -> DataFrame:
    """u, v: links that join all fingerprints within the radius of one another that share a key.

    keyed: node (a long; the fingerprint itself unless wide), bits (the wide fingerprint), way, key.
    """
    counts = keyed.groupBy("way", "key").agg(F.count("*").alias("n")).where("n > 1")
    shards = stash(counts.withColumn("shards", F.ceil(F.col("n") / CHUNK).cast("int")))
    whole = shards.agg(F.sum("n")).first()[0] or 0
    own = F.pmod(F.xxhash64("node"), F.col("shards")).cast("int")
    dealt = (
        meet(keyed, shards, ["way", "key"], F.col("n") * HOT > whole)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.expr("filter(sequence(0, shards - 1), x -> shards = 1 OR x != own)")))
        .groupBy("way", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
        .agg(F.collect_list(F.struct("node", "bits") if wide else "node").alias("members"))
        .where(F.size("members") > 1)
    )
    dealt = dealt.select(*(["members.node", "members.bits"] if wide else [F.col("members").alias("node")]))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, nodes in enumerate(batch["node"]):
                nodes = np.asarray(nodes, np.int64)
                bits = np.frombuffer(b"".join(batch["bits"][i]), "<u8") if wide else nodes.view(np.uint64)
                found = nodes[linked(bits.reshape(len(nodes), -1), radius)]
                if len(found):
                    yield pd.DataFrame({"u": found[:, 0], "v": found[:, 1]})

    return dealt.mapInPandas(compare, "u long, v long")


def _keyed(nodes: DataFrame, radius: int) -> DataFrame:
    """Each fingerprint (column node) under every choice of blocks."""
    masks = block_masks(radius, blocks_in_key(nodes.count(), radius))
    keys = F.array(*(F.col("node").bitwiseAND(m) for m in masks))
    return nodes.select("node", F.posexplode(keys).alias("way", "key"))


def _halves(n: int) -> np.ndarray:
    """The probabilities of 0 to n heads in n throws."""
    return np.array([math.comb(n, k) for k in range(n + 1)]) / 2.0**n


def differs(shared: int, one: int, two: int) -> float:
    """The probability that a bit of two wide fingerprints differs, from the shingles they share and those of each alone."""
    heads = np.arange(shared + 1)

    def is_set(alone: int) -> np.ndarray:
        least = np.clip((shared + alone) // 2 + 1 - heads, 0, alone + 1)  # of those alone, for over half of all
        return np.append(np.cumsum(_halves(alone)[::-1])[::-1], 0.0)[least]

    a, b = is_set(one), is_set(two)
    return float(_halves(shared) @ (a + b - 2 * a * b))


@cache
def wide_radius(similarity: float) -> int:
    """Bits by which wide fingerprints may differ. Texts of the similarity differ by more with probability MISSED at most.

    Votes of few shingles tie often, which moves the probability of a differing bit both ways from the angle that it
    tends to with their number. It is the largest of all such numbers that counts.
    """
    chance = math.acos(2 * similarity / (1 + similarity)) / math.pi
    for shared in range(1, FEW_SHINGLES + 1):
        extra = min(FEW_SHINGLES, math.floor(shared / similarity + 1e-9)) - shared
        for more in range(1, extra + 1):
            chance = max(chance, *(differs(shared, one, more - one) for one in range(more // 2 + 1)))
    bits, radius, reached = WIDE * BITS, -1, 0.0
    while reached < 1 - MISSED:
        radius += 1
        reached += math.comb(bits, radius) * chance**radius * (1 - chance) ** (bits - radius)
    return radius


def _label(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (doc_id, node, ...) with the component of each and its smallest doc_id, from links between nodes.

    Rows of a node that many share, and nodes of a component of many, meet what belongs to them on the map side.
    """
    nodes = stash(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    tied = stash(connected_components(found).join(nodes, "node"))
    smallest = stash(tied.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("size")))
    many = F.col("size") * HOT > tied.count()
    linked = meet(tied.select("node", "component", "n"), smallest, ["component"], many).drop("size")
    alone = nodes.join(tied.select("node"), "node", "left_anti")
    alone = alone.select("node", F.col("node").alias("component"), "n", F.col("first").alias("component_id"))
    labels = stash(linked.select(alone.columns).unionByName(alone))
    return meet(rows, labels, ["node"], F.col("n") * HOT > rows.count()).drop("n")


def near_duplicates(
    docs: DataFrame, radius: int = 4, words: int = 4, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """One row per input row: doc_id, fingerprint (signed long), component_id.

    component_id is the smallest doc_id among all rows reachable over links of `radius` (0 to 7) or fewer
    differing bits. Null and wordless texts have fingerprint zero and link like any other. A null id is never
    the smallest unless a component has no other. Repeated rows repeat in the result; an empty table gives none.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    rows = stash(with_fingerprint(plain, words).select("doc_id", F.col("fingerprint").alias("node")))
    nodes = stash(rows.select("node").distinct())
    found = _label(rows, links(_keyed(nodes, radius), radius))
    return found.select("doc_id", F.col("node").alias("fingerprint"), "component_id")


def true_links(plain: DataFrame, signed: DataFrame, found: DataFrame, similarity: float, words: int) -> DataFrame:
    """u, v: of the links that candidates (u, v) connect, those between texts of that similarity, as a spanning forest.

    plain: doc_id, text; signed: doc_id, text_hash, node, bits, shingles (their number). Only texts of nodes with a
    candidate are cut into shingles again, one for each node. A component of over CHUNK_SHINGLES shingles or CHUNK
    nodes is dealt out as pairs of chunks, as buckets are.
    """
    tied = connected_components(found)
    first = F.min(F.struct("text_hash", "doc_id", "bits", "shingles", "times")).alias("x")
    ones = signed.groupBy("node", "bits", "shingles", "doc_id", "text_hash").agg(F.count("*").alias("times"))
    chosen = stash(ones.groupBy("node").agg(first).select("node", "x.*").join(tied, "node"))
    size = F.greatest(F.ceil(F.sum("shingles") / CHUNK_SHINGLES), F.ceil(F.count("*") / CHUNK))
    shards = stash(chosen.groupBy("component").agg(size.cast("int").alias("shards"), F.count("*").alias("n")))
    own = F.pmod(F.xxhash64("node"), F.col("shards")).cast("int")
    many = F.col("n") * HOT > chosen.count()
    seats = meet(chosen, shards, ["component"], many).select(
        "doc_id", "text_hash", "component", "node", "bits", own.alias("own"), "shards"
    )

    @F.arrow_udf("binary")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in slices(batches):
            yield pa.array([np.unique(shingle_hashes(x.as_py(), words)).tobytes() for x in part], pa.binary())

    _, likely = divide(plain.withColumn("text_hash", F.xxhash64("text")), chosen.select("doc_id", "text_hash"), ["doc_id", "text_hash"])
    if not chosen.where("times > 1").isEmpty():
        likely = likely.dropDuplicates(["doc_id", "text_hash"])
    seats = seats.withColumnsRenamed({"doc_id": "of", "text_hash": "with"})
    texts = likely.join(seats, (F.col("text_hash") == F.col("with")) & F.col("doc_id").eqNullSafe(F.col("of")))
    dealt = texts.select("component", "node", "bits", cut("text").alias("sets"), "own", "shards").withColumn(
        "other", F.explode(F.expr("filter(sequence(0, shards - 1), x -> shards = 1 OR x != own)"))
    )
    radius = wide_radius(similarity)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        nodes = group["node"].to_numpy()
        bits = np.frombuffer(b"".join(group["bits"]), "<u8").reshape(len(nodes), -1)
        edges = nodes[linked_truly(bits, [np.frombuffer(x, "<u8") for x in group["sets"]], radius, similarity)]
        return pd.DataFrame({"u": edges[:, 0], "v": edges[:, 1]})

    keys = ("component", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    return dealt.groupBy(*keys).applyInPandas(compare, "u long, v long")


def similar_documents(
    docs: DataFrame, similarity: float = 0.8, words: int = 5, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """One row per input row: doc_id, text_hash, component, component_id, by wide fingerprints and an exact check.

    Texts are linked if they share a band, their wide fingerprints differ by `wide_radius` or fewer bits and
    `similarity` or more of their distinct shingles (Jaccard). The first two miss a link at the very threshold with
    probability 0.002 and MISSED at most. Cases are as in `near_duplicates`; wordless texts are alike.
    """

    kind = pa.struct([("bits", pa.binary()), ("keys", pa.list_(pa.int64())), ("shingles", pa.int64())])

    @F.arrow_udf("struct<bits: binary, keys: array<long>, shingles: long>")
    def signature(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in slices(batches):
            yield pa.array([dict(zip(kind.names, wide_fingerprint(x.as_py(), words))) for x in part], kind)

    plain = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    signed = plain.select("doc_id", F.xxhash64("text").alias("text_hash"), signature("text").alias("s"))
    signed = signed.select("doc_id", "text_hash", F.xxhash64("s.bits", "s.keys").alias("node"), "s.*")
    signed = stash(signed)
    distinct = signed.groupBy("node").agg(F.first("bits").alias("bits"), F.first("keys").alias("keys"))
    keyed = distinct.select("node", "bits", F.posexplode("keys").alias("way", "key"))
    found = links(keyed, wide_radius(similarity), wide=True)
    true = true_links(plain, signed.drop("keys"), found, similarity, words)
    return _label(signed.select("doc_id", "text_hash", "node"), true).drop("node")


def drop_near_duplicates(
    docs: DataFrame, similarity: float = 0.8, words: int = 5, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """The documents that stay, with the columns of docs: of each component the one of smallest id.

    Components are those of `similar_documents`. Of rows of one component that share that id, the one of smallest
    text hash stays, and of equal rows one. Null ids stay only in a component without any other; an empty table gives
    none. Only rows of components of two or more (and a few that a bitmap cannot tell from them) are shuffled.
    """
    own, mark = own_name(docs, "own"), own_name(docs, "text_hash")
    rows = stash(similar_documents(docs, similarity, words, text, doc_id))
    ones = rows.groupBy("component", "doc_id", "component_id", "text_hash").agg(F.count("*").alias("times"))
    first = F.min(F.when(F.col("doc_id").eqNullSafe(F.col("component_id")), F.col("text_hash"))).alias("head")
    several = stash(ones.groupBy("component").agg(F.sum("times").alias("n"), first).where("n > 1"))
    found = meet(ones, several, ["component"], F.col("n") * HOT > rows.count())
    goes = ~(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("head")))
    decided = found.where(goes | (F.col("times") > 1)).select(F.col("doc_id").alias(own), F.col("text_hash").alias(mark), goes.alias("goes"))
    keyed = docs.withColumns({own: F.col(doc_id), mark: F.xxhash64(whole_text(text))})
    return without(keyed, decided, [own, mark]).select(docs.columns)
