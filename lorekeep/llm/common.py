"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.operators.rows import settled as stash  # noqa: F401

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = r"[\x20\x09-\x0D]+"
LABEL_FOLDS = 5
#: Rows of an Arrow batch that a Python worker takes up at a time.
HELD = 64
#: A key is hot if it holds over 1 / HOT of the rows, so there are fewer than HOT hot keys at any input size.
HOT = 1000
#: A row set's bitmap has so many bits for each row, and BITMAP_BITS (16 MB) at most.
BITS_A_ROW, BITMAP_BITS = 32, 1 << 27
#: Bits of a row's number within its partition in what monotonically_increasing_id gives.
RANGE_BITS = 33
#: Bits of one value of Spark's bitmap functions.
BITMAP_BUCKET = 32_768


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return memory that the process freed to the system, where its C library can: workers and drivers live on."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The rows of Arrow batches in slices of HELD rows, which need not be copies; at the end freed memory is given back."""
    for batch in batches:
        for at in range(0, len(batch), HELD):
            yield batch.slice(at, HELD)
    give_back()


def meet(many: DataFrame, one: DataFrame, keys: list[str], hot: Column) -> DataFrame:
    """many joined with `one`, which has a row for each key (no nulls) and for which `hot` tells the hot keys.

    Hot keys must be fewer than HOT by what they mean (over 1 / HOT of the rows of many). Their rows are broadcast, so
    that the many rows of a hot key stay where they are; all others meet by a shuffle.
    """
    mark = own_name(many, "hot")
    marked = many.join(F.broadcast(one.where(hot).withColumn(mark, F.lit(True))), keys, "left")
    gained = [c for c in one.columns if c not in keys]
    near = marked.where(F.col(mark)).drop(mark)
    far = marked.where(F.col(mark).isNull()).drop(mark, *gained).join(one.where(~hot), keys)
    return near.unionByName(far)


def ranked(rows: DataFrame, by: list[str], name: str, block: str) -> DataFrame:
    """rows with the long column `name`, their place (from 0, gapless) in the order of the columns `by` (nulls first), and `block`.

    `block` numbers the ranges of that order that tasks hold, from Spark's sampled ranges, so a range is as large as others
    unless many rows agree in all of `by`. Only the sizes of ranges, a row for each task, are summed up in one place.
    """
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id())
    placed = stash(placed.withColumn(block, F.shiftright(name, RANGE_BITS)))
    shift = own_name(placed, "shift")
    before = F.coalesce(F.sum("n").over(Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = placed.groupBy(block).agg(F.count("*").alias("n"))
    shifts = sizes.select(block, (before - F.shiftleft(block, RANGE_BITS)).alias(shift))
    return placed.join(F.broadcast(shifts), block).withColumn(name, F.col(name) + F.col(shift)).drop(shift)


def straddlers(ranges: DataFrame, key: str, block: str) -> DataFrame:
    """key, block: the values of `key` that lie in several blocks, with each of their blocks.

    ranges is in the order of key first (see `ranked`), so these are firsts or lasts of their blocks: two rows a block at most.
    """
    ends = ranges.groupBy(block).agg(F.min(F.struct(key)).alias("low"), F.max(F.struct(key)).alias("high"))
    ends = ends.select(block, F.explode(F.array_distinct(F.array("low", "high"))).alias("of"))
    several = Window.partitionBy("of")
    return ends.withColumn("blocks", F.count("*").over(several)).where("blocks > 1").select(F.col(f"of.{key}").alias(key), block)


def divide(rows: DataFrame, some: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows without, and with, those whose keys may be among those of `some` (the same columns, stashed).

    All rows whose keys are among them are in the second part, and of the others a few (one in BITS_A_ROW). A
    bitmap of hashed keys is broadcast for it, of at most BITMAP_BITS. With very many keys it tells less and less
    apart, and the second part grows towards all rows; what is done to it must not depend on that.
    """
    bits = min(BITMAP_BITS, -(-max(1, some.count()) * BITS_A_ROW // BITMAP_BUCKET) * BITMAP_BUCKET)
    bucket, bitmap = own_name(rows, "bucket"), own_name(rows, "bitmap")
    spot = F.pmod(F.xxhash64(*keys), F.lit(bits))
    place = F.bitmap_bit_position(spot)
    maps = some.groupBy(F.bitmap_bucket_number(spot).alias(bucket)).agg(F.bitmap_construct_agg(place).alias(bitmap))
    marked = rows.withColumn(bucket, F.bitmap_bucket_number(spot)).join(F.broadcast(maps), bucket, "left")
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = F.coalesce(F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1, F.lit(False))
    without, perhaps = (marked.where(x).drop(bucket, bitmap) for x in (~there, there))
    return without, perhaps


def without(docs: DataFrame, marked: DataFrame, keys: list[str]) -> DataFrame:
    """docs without the rows whose keys `marked` says to go (column goes); of rows of equal marked keys one stays.

    marked has each of its keys once; keys that occur twice in docs must be among them. Keys may be null. Only rows that
    may be marked are shuffled (see `divide`); all others stay where they are.
    """
    marked = stash(marked)
    stays, doubtful = divide(docs, marked, keys)
    gone = marked.where("goes").select(*(F.col(c).alias(f"gone_{i}") for i, c in enumerate(keys)))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"gone_{i}")) for i, c in enumerate(keys)))
    return stays.unionByName(doubtful.dropDuplicates(keys).join(gone, same, "left_anti"))


def whole_text(name: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def held_out(doc_id: Column) -> Column:
    """The fold that no model learns from: crc32 of the decimal id is divisible by five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % LABEL_FOLDS == 0, F.lit(False))


def own_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have yet."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name
