"""Exact nearest vectors without reading all: blocks around pivots, left out where the triangle inequality says so.

Every vector belongs to the cell of its nearest pivot and, by its distance from it, to a ring of the cell. What lies between `low` and `high` from a
pivot is at least low - d and d - high away from a query at the distance d from the pivot. The blocks (cell and ring) that may be nearest to a query give it
its first k vectors; after that only blocks that may hold a nearer one are looked at. Recall is 1 by construction; how much is left out depends on how
the vectors lie, and `explain` tells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.rows import settled
from lorekeep.operators.search import ranked, to_arrow

#: Pivots, which are broadcast; rings of a cell; vectors, and queries, that one task compares at a time.
PIVOTS, RINGS, SEAT = 64, 8, 4096
#: What rounding may add to a distance that is found by products, as a share of the vectors' lengths (and of one).
MARGIN = 1e-7


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(len(column), -1)


def _distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All distances as one matrix product, exact to MARGIN."""
    squares = (left**2).sum(axis=1)[:, None] + (right**2).sum(axis=1) - 2 * left @ right.T
    return np.sqrt(np.maximum(squares, 0))


def pivots_of(vectors: DataFrame, width: int, most: int = PIVOTS) -> np.ndarray:
    """At most `most` of the vectors of that width, those of smallest hash."""
    rows = vectors.where(F.size("v") == width).select("v").distinct().orderBy(F.xxhash64("v")).limit(most).collect()
    return np.array([r.v for r in rows], np.float64).reshape(len(rows), width)


class VectorBlocks:
    """vectors (id, v; all of one width, nulls and others left out) in blocks. `pivots` may be given; else they are taken from the vectors."""

    def __init__(self, vectors: DataFrame, width: int, pivots: np.ndarray | None = None):
        self.width, self.kind = width, vectors.schema["id"].dataType.simpleString()
        whole = vectors.where(F.size("v") == width).select("id", F.col("v").cast("array<double>").alias("v"))
        self.pivots = pivots_of(whole, width) if pivots is None else pivots
        shared = vectors.sparkSession.sparkContext.broadcast(self.pivots)  # PIVOTS vectors

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    far = _distances(_matrix(batch.column("v")), shared.value)
                    cell = far.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])], ["id", "v", "cell", "r"]
                    )

        placed = whole.mapInArrow(place, f"id {self.kind}, v array<double>, cell int, r double") if len(self.pivots) else None
        if placed is None:
            self.blocks = self.rows = None
            return
        placed = settled(placed)
        cells = placed.groupBy("cell").agg(F.min("r").alias("from"), F.max("r").alias("to"))  # a row for each pivot
        ring = F.when(F.col("to") > F.col("from"), F.least(F.floor((F.col("r") - F.col("from")) / (F.col("to") - F.col("from")) * RINGS), F.lit(RINGS - 1))).otherwise(0)
        ringed = placed.join(F.broadcast(cells), "cell").withColumn("ring", ring.cast("int"))
        self.blocks = settled(ringed.groupBy("cell", "ring").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.count("*").alias("n")))
        known = np.sqrt((self.pivots**2).sum(axis=1))
        self.longest = max((known[b.cell] + b.high for b in self.blocks.select("cell", "high").collect()), default=0.0)  # PIVOTS * RINGS rows at most
        sized = self.blocks.select("cell", "ring", F.ceil(F.col("n") / SEAT).cast("int").alias("seats"))  # PIVOTS * RINGS rows at most
        seat = F.pmod(F.xxhash64("id", F.col("v")), F.col("seats")).cast("int")
        self.rows = settled(ringed.join(F.broadcast(sized), ["cell", "ring"]).select("id", "v", "cell", "ring", seat.alias("seat"), "seats"))

    def _bounds(self, queries: DataFrame) -> DataFrame:
        """query_id, cell, far, margin: each query's distance from each pivot."""
        shared = queries.sparkSession.sparkContext.broadcast(self.pivots)
        kind = queries.schema["query_id"].dataType.simpleString()

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    far = _distances(_matrix(batch.column("q")), shared.value)
                    size = pa.array(np.sqrt((_matrix(batch.column("q")) ** 2).sum(axis=1)))
                    yield pa.RecordBatch.from_arrays([batch.column("query_id"), size, pa.array(far.tolist(), pa.list_(pa.float64()))], ["query_id", "size", "far"])

        asked = queries.where(F.size("q") == self.width).select("query_id", F.col("q").cast("array<double>").alias("q"))
        found = asked.mapInArrow(measure, f"query_id {kind}, size double, far array<double>")
        margin = MARGIN * (1 + self.longest + F.col("size"))
        return found.select("query_id", margin.alias("margin"), F.posexplode("far").alias("cell", "far"))

    def _hits(self, queries: DataFrame, pairs: DataFrame, k: int, apart: bool) -> DataFrame:
        """query_id, id, distance: the k nearest of each seat of the blocks that pairs (query_id, cell, ring) name."""
        asked = pairs.join(queries.select("query_id", F.col("q").cast("array<double>").alias("q")), "query_id")
        groups = asked.groupBy("cell", "ring").agg(F.ceil(F.count("*") / SEAT).cast("int").alias("groups"))  # a row for each block at most
        asked = asked.join(F.broadcast(groups), ["cell", "ring"]).withColumn("group", F.pmod(F.xxhash64("query_id"), F.col("groups")).cast("int"))
        seats = self.rows.select("cell", "ring", "seats").distinct()
        asked = asked.join(F.broadcast(seats), ["cell", "ring"]).withColumn("seat", F.explode(F.sequence(F.lit(0), F.col("seats") - 1)))
        held = self.rows.join(F.broadcast(groups), ["cell", "ring"]).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        kind = queries.schema["query_id"].dataType.simpleString()
        wire = pa.schema([("query_id", to_arrow(kind)), ("id", to_arrow(self.kind)), ("distance", pa.float64())])

        def compare(vectors: pa.Table, questions: pa.Table) -> pa.Table:
            ids, names = vectors.column("id").to_pylist(), questions.column("query_id").to_pylist()
            if not ids or not names:
                return wire.empty_table()
            laid, asks = (_matrix(t.column(c).combine_chunks()) for t, c in ((vectors, "v"), (questions, "q")))
            rough, out = _distances(asks, laid), []
            margin = MARGIN * (1 + np.sqrt(max((laid**2).sum(axis=1).max(), (asks**2).sum(axis=1).max())))
            for n, name in enumerate(names):
                row = rough[n]
                least = np.partition(row, min(k, len(row) - 1))[min(k, len(row) - 1)]  # one more than k, for the query itself
                near = np.flatnonzero(row <= least + 2 * margin)
                exact = np.sqrt(((laid[near] - asks[n]) ** 2).sum(axis=1)).round(9).tolist()
                found = sorted((d, ids[i]) for d, i in zip(exact, near) if not apart or ids[i] != name)[:k]
                out += [(name, i, d) for d, i in found]
            return pa.Table.from_arrays([pa.array([x[c] for x in out], wire.field(c).type) for c in range(3)], schema=wire)

        key = ["cell", "ring", "seat", "group"]
        asks = asked.select("query_id", "q", *(F.col(x).alias(f"of_{x}") for x in key)).groupBy(*(f"of_{x}" for x in key))
        both = held.select("id", "v", *key).groupBy(*key).cogroup(asks)
        return both.applyInArrow(compare, f"query_id {kind}, id {self.kind}, distance double")

    def explain(self, queries: DataFrame, k: int, apart: bool = True) -> tuple[DataFrame, DataFrame]:
        """query_id, id, distance, rank of the k nearest to queries (query_id, q), by distance (nine places), then id; and query_id, looked, all: the vectors
        of the blocks that were looked at, and all vectors. apart: an id is not its own neighbour. Queries of another width have none."""
        if self.rows is None:
            none = queries.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {self.kind}, distance double, rank int")
            return none, none.select("query_id", F.lit(0).alias("looked"), F.lit(0).alias("all"))
        met = self._bounds(queries).join(F.broadcast(self.blocks), "cell")
        bound = F.greatest(F.col("low") - F.col("far"), F.col("far") - F.col("high"), F.lit(0.0))
        bounds = settled(met.select("query_id", "cell", "ring", "n", (bound - F.col("margin")).alias("bound")))
        order = [F.col("bound"), F.col("cell"), F.col("ring")]
        first = ranked(bounds, k + 1, order).select("query_id", "cell", "ring")  # each has a vector at least
        best = ranked(self._hits(queries, first, k, apart), k, [F.col("distance"), F.col("id")])
        reach = best.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("reach")).where(F.col("n") >= k).select("query_id", "reach")
        pairs = settled(bounds.join(reach, "query_id", "left").where(F.col("reach").isNull() | (F.col("bound") <= F.col("reach"))))
        found = ranked(self._hits(queries, pairs.select("query_id", "cell", "ring"), k, apart), k, [F.col("distance"), F.col("id")])
        every = self.blocks.agg(F.sum("n").alias("all"))
        looked = pairs.groupBy("query_id").agg(F.sum("n").alias("looked")).join(F.broadcast(every))
        return found.select("query_id", "id", "distance", "rank"), looked

    def nearest(self, queries: DataFrame, k: int, apart: bool = True) -> DataFrame:
        return self.explain(queries, k, apart)[0]
