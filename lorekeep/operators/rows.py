"""Row-level operators: visibility, filters that are optional, latest rows, pages, facets, idempotent writes."""

from __future__ import annotations

import base64
import re
import tempfile
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Snapshot:
    """A point in world time, the point in time of what was known, and the last transaction that counts."""

    as_of: str
    known_as_of: str
    sequence: int


def valid_at(snapshot: Snapshot) -> Column:
    """Half-open [valid_from, valid_to); a null end is open."""
    day = F.lit(snapshot.as_of).cast("date")
    return (F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (day < F.col("valid_to")))


def recorded_by(snapshot: Snapshot) -> Column:
    return (F.col("recorded_from") <= F.lit(snapshot.known_as_of).cast("date")) & (F.col("from_sequence") <= snapshot.sequence)


def visible(snapshot: Snapshot, strict: bool = False) -> Column:
    """Whether a row with validity and recording bounds is seen from a snapshot.

    A closed record counts while its end is unknown to the snapshot by time or by sequence; strictly, by both.
    """
    known = F.lit(snapshot.known_as_of).cast("date") < F.col("recorded_to")
    later = F.col("to_sequence") > snapshot.sequence
    open_ = F.col("recorded_to").isNull() | ((known & later) if strict else (known | later))
    return F.coalesce(valid_at(snapshot) & recorded_by(snapshot) & open_, F.lit(False))


def contains_ignoring_case(column: Column, needle: str) -> Column:
    """LIKE '%needle%' with everything in it taken literally; a null column does not match."""
    return F.coalesce(F.contains(F.lower(column), F.lit(needle.lower())), F.lit(False))


def where_given(df: DataFrame, **equal: object) -> DataFrame:
    """Equality filters, of which blank ones are not applied."""
    for name, value in equal.items():
        if value not in (None, ""):
            df = df.where(F.col(name) == value)
    return df


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last by the order columns. Partial maxima are taken before the shuffle, so a hot key
    costs one row a task; a window would gather it."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("best"))
    return best.select(*keys, *(F.col(f"best.{c}").alias(c) for c in [*order, *rest])).select(df.columns)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("best"))
    return best.select(*keys, *(F.col(f"best.{c}").alias(c) for c in [*order, *rest])).select(df.columns)


def keyset_page(df: DataFrame, sort: str, ident: str, size: int, after: tuple | None = None, back: bool = False) -> DataFrame:
    """`size` rows after (or before, with back) a cursor by (sort, ident) descending, and one more that tells of more."""
    if after is not None:
        at = F.struct(*(F.lit(v).cast(df.schema[c].dataType) for v, c in zip(after, (sort, ident), strict=True)))
        here = F.struct(F.col(sort), F.col(ident))
        df = df.where(here > at if back else here < at)
    order = [F.asc(sort), F.asc(ident)] if back else [F.desc(sort), F.desc(ident)]
    return df.orderBy(*order).limit(size + 1)


def encode_cursor(sort: object, ident: object) -> str:
    return base64.urlsafe_b64encode(f"{sort}|{ident}".encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[str, str]:
    sort, _, ident = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)).decode().rpartition("|")
    return sort, ident


def facets(df: DataFrame, columns: Sequence[str], most: int = 50) -> DataFrame:
    """facet, value, n: the most frequent non-blank values of each column, from one scan."""
    pairs = F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns))
    counts = df.select(F.explode(pairs).alias("x")).select("x.*").where(F.trim("value") != "").groupBy("facet", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def insert_ignore(stored: DataFrame, incoming: DataFrame, ident: str) -> DataFrame:
    """stored with the incoming rows whose id it lacks; of incoming rows of one id, one."""
    new = incoming.dropDuplicates([ident]).join(stored.select(ident), ident, "left_anti")
    return stored.unionByName(new.select(stored.columns))


def upsert_counters(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counters added by key."""
    names = [c for c in stored.columns if c not in keys]
    return stored.unionByName(incoming.select(stored.columns)).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in names))


def replace_group(stored: DataFrame, incoming: DataFrame, groups: DataFrame) -> DataFrame:
    """stored with all rows of the given groups (their key columns) replaced by the incoming rows."""
    kept = stored.join(groups.distinct(), groups.columns, "left_anti").select(stored.columns)
    return kept.unionByName(incoming.select(stored.columns))


def endpoints(edges: DataFrame, *keep: str) -> DataFrame:
    """Both ends of each edge as rows (entity, ...): an OR of two join keys becomes one equi-join key."""
    ends = F.explode(F.array("source", "target"))
    return edges.select(ends.alias("entity"), *keep)


def capped(df: DataFrame, order: Sequence[Column], most: int) -> DataFrame:
    """The first `most` rows, each with `truncated`: whether there are more. One row more than that is looked at."""
    top = df.orderBy(*order).limit(most + 1)
    rank = F.row_number().over(Window.orderBy(*order))  # of most + 1 rows
    counted = top.withColumn("truncated", F.count("*").over(Window.partitionBy()) > most).withColumn("_rank", rank)
    return counted.where(F.col("_rank") <= most).drop("_rank")


def eligible_page(hits: DataFrame, eligible: Column, order: Sequence[Column], scan: int, limit: int) -> DataFrame:
    """The first `limit` eligible hits in order, of the first `scan` hits: what a store finds that reads on, page by page,
    until it has enough or has looked at `scan` rows."""
    return hits.orderBy(*order).limit(scan).where(eligible).orderBy(*order).limit(limit)


def from_code(topic_key: Column, session: Column, prefix: str = "code:", code_session: str = "code-index") -> Column:
    """Whether a row comes from the index of code, by its key or by its session; nulls do not."""
    return F.coalesce(topic_key.startswith(prefix), F.lit(False)) | F.coalesce(session == code_session, F.lit(False))


def at_least(column: Column, ranks: Sequence[str], least: str) -> Column:
    """Whether a value ranks no lower than `least` in ascending ranks; unknown values and nulls do not."""
    return F.coalesce(column.isin(*ranks[ranks.index(least) :]), F.lit(False))


def spend(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """tier, calls, prompt_tokens, completion_tokens, cost: calls (tier, prompt, completion) summed, priced by the million tokens.

    prices: tier, prompt_price, completion_price, a row for each tier. A tier without a price has a null cost.
    """
    sums = calls.groupBy("tier").agg(F.count("*").alias("calls"), F.sum("prompt").alias("prompt_tokens"), F.sum("completion").alias("completion_tokens"))
    cost = F.col("prompt_tokens") / 1e6 * F.col("prompt_price") + F.col("completion_tokens") / 1e6 * F.col("completion_price")
    return sums.join(prices, "tier", "left").select("tier", "calls", "prompt_tokens", "completion_tokens", cost.alias("cost"))


def json_lines(df: DataFrame, columns: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """line: each row's columns as one JSON object, in order; nulls are left out. Write it with `.write.text`."""
    return df.orderBy(*order).select(F.to_json(F.struct(*columns)).alias("line"))


def delete_cascade(tables: dict[str, DataFrame], root: str, gone: Column, links: Sequence[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """The tables without the rows of `root` that are gone and all rows that refer to a row that is no longer there.

    links: (child, its column, parent, its column), parents before their children. References that are null stay.
    """
    left = dict(tables)
    removed = {root: tables[root].where(gone)}
    left[root] = tables[root].where(~F.coalesce(gone, F.lit(False)))
    for child, column, parent, key in links:
        if parent in removed:
            keys = removed[parent].select(F.col(key).alias(column))
            removed[child] = left[child].join(keys, column, "left_semi")
            left[child] = left[child].join(keys, column, "left_anti")
    return left


def settled(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the folder of spark.checkpoint.dir.

    Only a session on this machine alone (local master) that names no folder gets a temporary one; on a cluster the
    executors could not share it, so there it is an error. Set spark.cleaner.referenceTracking.cleanCheckpoints to
    have checkpoints removed once nothing refers to them.
    """
    _with_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def _with_checkpoints(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder for tables beside the checkpoints, which all executors share."""
    _with_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}"
