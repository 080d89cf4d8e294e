"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame operations only.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's word shingles. Sketches of
parts merge into the sketch of the whole, so a long document or a corpus can be sketched piecewise; from
sketches alone follow estimates of resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import BLANK, own_name, stash, whole_text

#: Hashes kept, and words of a shingle.
K, WORDS = 64, 5
SPAN = 2.0**64


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """A hash of each word shingle in lower case; of all words where there are fewer; none without words."""
    found = F.filter(F.split(F.lower(text), BLANK), lambda w: w != "")

    def hashes(array: Column) -> Column:
        count = F.greatest(F.size(array) - words + 1, F.lit(1))
        return F.transform(
            F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(*(F.get(array, i + j) for j in range(words)))
        )

    # One lambda binds the split words, so that they are made once for all shingles.
    return F.flatten(
        F.transform(F.array(found), lambda a: F.when(F.size(a) > 0, hashes(a)).otherwise(F.array().cast("array<bigint>")))
    )


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """The bottom-k sketch of a text: at most k ascending longs; empty for a text without words, or null."""
    return F.slice(F.array_sort(F.array_distinct(shingle_hashes(F.coalesce(text, F.lit("")), words))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts taken together."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def merge_all(sketches: DataFrame, keys: list[str], name: str = "sketch", k: int = K) -> DataFrame:
    """The merged sketch of each group of keys: distinct hashes, of which the k smallest of each group stay.

    Hashes are ranked within shards of a group first, so that a group of any size is spread over tasks.
    """
    each = sketches.select(*keys, F.explode(name).alias("h")).distinct()
    shard = F.pmod(F.xxhash64("h"), F.lit(64))
    for by in ([*keys, shard], keys):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("h"))
        each = each.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
    return each.groupBy(*keys).agg(F.array_sort(F.collect_list("h")).alias(name))


def _kept_of(union: Column, *sides: Column) -> Column:
    both = union
    for side in sides:
        both = F.array_intersect(both, side)
    return F.size(both)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness: the share of the union's k smallest hashes that both have; 1 if both are empty."""
    union = merge(a, b, k)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(_kept_of(union, a, b) / F.size(union))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 if a is empty, and 0 if the sketches' range misses a."""
    union = merge(a, b, k)
    in_a = _kept_of(union, a)
    return F.when(F.size(a) == 0, F.lit(1.0)).when(in_a == 0, F.lit(0.0)).otherwise(_kept_of(union, a, b) / in_a)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the k-th hash's place in the range."""
    place = (F.element_at(a, k).cast("double") + SPAN / 2) / SPAN
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def sketch_text(a: Column) -> Column:
    """The sketch as a string: 16 hexadecimal digits for each hash, in order."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def with_sketch(docs: DataFrame, text: str = "text", name: str = "sketch", k: int = K, words: int = WORDS) -> DataFrame:
    """docs with its sketch (replaced where docs has such a column); rows are independent of one another."""
    return docs.withColumn(name, sketch(whole_text(text), k, words))


def next_keys(ids: DataFrame) -> DataFrame:
    """key, next and the other columns of ids: each key beside the next one by descending doc_id, after the last the first.

    ids: key, a struct (doc_id, hash) that occurs once. Null ids order after all others, equal ids by hash. Spark deals the
    keys out by sampled ranges, as for a sort, so that ranges hold like numbers of rows whatever the ids are; only the first key
    of each range is broadcast.
    """
    order = [F.desc_nulls_last("key.doc_id"), F.asc("key.hash")]
    ranged = stash(ids.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    within = Window.partitionBy("range").orderBy(*order)
    near = stash(ranged.withColumns({"near": F.lead("key").over(within), "place": F.row_number().over(within)}))
    heads = near.where("place = 1").select("range", F.col("key").alias("head"))
    along = Window.orderBy("range")  # one row for each range
    first = F.first("head").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = heads.select("range", F.coalesce(F.lead("head").over(along), first).alias("after"))
    found = near.join(F.broadcast(after), "range")
    return found.select(*ids.columns, F.coalesce("near", "after").alias("next"))


def with_next(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = K, words: int = WORDS) -> DataFrame:
    """doc_id, text, sketch, next_start, next_sketch: each document beside the next one by descending id.

    next_start is the beginning of the next text, half as long as the own text is (rounded down) or all of it.
    After the last document comes the first. Null ids order after all others, rows of equal id by a hash of their text; rows
    that repeat wholly follow one another. A table of one row is its own next; an empty table gives no rows. Null texts are
    empty; other columns are ignored. Only ids, hashes and lengths are put in order. Texts meet by key: they are shuffled once whole,
    and their beginnings once more.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    keyed = plain.select(F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("key"), "text")
    half = F.floor(F.length("text") / 2).cast("int")
    ids = stash(keyed.groupBy("key").agg(F.min(half).alias("half"), F.count("*").alias("times")))
    pairs = stash(next_keys(ids))
    if not ids.where("times > 1").isEmpty():
        keyed = keyed.dropDuplicates(["key"])
    asked = pairs.select(F.col("next").alias("key"), F.col("key").alias("by"), "half", "times")
    starts = keyed.join(asked, "key").select(
        F.col("by").alias("key"),
        "times",
        F.substring(F.col("text"), F.lit(1), F.col("half")).alias("next_start"),
        sketch(F.col("text"), k, words).alias("next_sketch"),
    )
    met = keyed.join(starts, "key").withColumn("sketch", sketch(F.col("text"), k, words))
    # All but one of the rows that repeat are followed by themselves.
    copy = F.col("copy") > 1
    each = met.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return each.select(
        F.col("key.doc_id").alias("doc_id"),
        "text",
        "sketch",
        F.when(copy, F.substring(F.col("text"), F.lit(1), half)).otherwise(F.col("next_start")).alias("next_start"),
        F.when(copy, F.col("sketch")).otherwise(F.col("next_sketch")).alias("next_sketch"),
    )


def edited(text: Column, following: Column) -> Column:
    """The text with its last floor(n / 2) code points replaced by the first as many of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))
