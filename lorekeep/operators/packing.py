"""Runs of rows whose costs stay within a target, a group of any size spread over tasks.

Where a run begins decides where it ends and where the next one begins, so a range of rows is a map: from the run that is open when it begins to the one
that is open when it ends, and how many end in between. A run that comes in ends, and the next ones begin, near the head of a range, so the map is
told by the costs of the head, what each beginning there leads to, and the costs of the tail. The maps of a group's ranges are applied one after the
other, which takes a few rows for each range; then all ranges write their runs at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.operators import ranges
from lorekeep.operators.rows import settled

RUNS = ["chunk", "first", "last", "size"]
ENTRY = pa.struct([("number", pa.int64()), ("base", pa.int64()), ("open", pa.list_(pa.int64())), ("final", pa.bool_())])


@dataclass(frozen=True)
class Bounds:
    """A run's costs, with `joint` more for every row after its first, stay within target, in `most` rows; the next begins `overlap` rows before its new one."""

    target: int
    overlap: int = 0
    joint: int = 0
    most: int | None = None


class Run:
    """The open run: its number, its first row's place in the group, and its costs. Costs are not negative."""

    def __init__(self, bounds: Bounds, number: int = 0, base: int = 0, costs: list[int] | None = None):
        self.bounds, self.number, self.base, self.costs = bounds, number, base, costs or []
        self._sum()

    def _sum(self) -> None:
        self.size = sum(self.costs) + self.bounds.joint * max(0, len(self.costs) - 1)

    def full(self, cost: int) -> bool:
        b = self.bounds
        return bool(self.costs) and (self.size + b.joint + cost > b.target or len(self.costs) == b.most)

    def add(self, cost: int) -> None:
        self.size += cost + (self.bounds.joint if self.costs else 0)
        self.costs.append(cost)

    def close(self) -> tuple[int, int, int, int]:
        """What is emitted; the next run begins with what the two share."""
        row = self.number, self.base, self.base + len(self.costs) - 1, self.size
        step = max(1, len(self.costs) - self.bounds.overlap)
        self.number, self.base, self.costs = self.number + 1, self.base + step, self.costs[step:]
        self._sum()
        return row


def ends(costs: np.ndarray, bounds: Bounds) -> np.ndarray:
    """The last row of the run that begins at each row, if there were no more rows."""
    n = len(costs)
    along = np.cumsum(costs) + bounds.joint * np.arange(n)
    before = along - costs  # what a run that begins here need not pay
    last = np.searchsorted(along, before + bounds.target, side="right") - 1
    if bounds.most is not None:
        last = np.minimum(last, np.arange(n) + bounds.most - 1)
    return np.maximum(last, np.arange(n))


def summary(costs: np.ndarray, bounds: Bounds) -> dict:
    """n, head, opens, counts, tail of a range: for a run that begins at row i of the head, opens[i] is where the run begins that is open at the range's
    end, and counts[i] how many end before that; the tail are the costs from the first such beginning on."""
    n, last = len(costs), ends(costs, bounds)
    opens, counts = np.arange(n), np.zeros(n, np.int64)
    for i in range(int(np.searchsorted(last, n - 1)) - 1, -1, -1):  # ends come in order, so these end in the range
        then = i + max(1, int(last[i]) - i + 1 - bounds.overlap)
        opens[i], counts[i] = opens[then], counts[then] + 1
    head = min(n, int(last[0]) + 2)
    at = int(opens[:head].min())
    return {"n": n, "head": costs[:head].tolist(), "opens": opens[:head].tolist(), "counts": counts[:head].tolist(), "at": at, "tail": costs[at:].tolist()}


def pack(rows: DataFrame, group: str, order: str, cost: str, bounds: Bounds) -> DataFrame:
    """group, chunk, first, last, size: the runs of each group's rows in order; places count from zero within the group.

    Rows of one group and order are in no order of their own. An empty table gives no runs.
    """
    kind = rows.schema[group].dataType.simpleString()
    plain = rows.select(F.col(group).alias("own"), F.col(order).alias("order"), F.col(cost).cast("long").alias("cost"))
    dealt = ranges.in_ranges(plain, ["own", "order"])
    cut = settled(ranges.of_several(dealt, "own"))
    feed = dealt.select("own", "block", "cost", F.lit(None).cast("struct<number: long, base: long, open: array<long>, final: boolean>").alias("entry"), "order")
    if not cut.isEmpty():
        wide = cut.withColumn("key", F.struct("own")).drop("own")
        parts = dealt.withColumn("key", F.struct("own")).join(F.broadcast(wide), ["key", "block"]).drop("key")

        def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            types: dict[str, pa.DataType] = {}

            def each() -> Iterator[tuple]:
                for batch in batches:
                    types["own"] = batch.schema.field("own").type
                    yield from zip(*(batch.column(c).to_pylist() for c in ("own", "block", "cost")), strict=True)

            for (own, block), some in groupby(each(), lambda x: x[:2]):
                found = summary(np.fromiter((x[2] for x in some), np.int64), bounds)
                lists = pa.list_(pa.int64())
                kinds = [pa.int64(), lists, lists, lists, pa.int64(), lists]
                arrays = [pa.array([own], types["own"]), pa.array([block], pa.int32()), *(pa.array([v], t) for v, t in zip(found.values(), kinds))]
                yield pa.RecordBatch.from_arrays(arrays, ["own", "block", *found])

        def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                types = batch.schema.field("own").type
                for x in batch.to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([x["own"]], types), pa.array([x["block"]], pa.int32()), pa.array([enter(x)], ENTRY)], ["own", "block", "entry"])

        state: dict = {}

        def enter(x: dict) -> dict:
            """The run that is open as a range begins; `state` goes on to its end."""
            if state.get("own", state) != x["own"]:
                state.update(own=x["own"], run=Run(bounds), start=0)
            run, start = state["run"], state["start"]
            entry = {"number": run.number, "base": run.base, "open": list(run.costs), "final": x["final"]}
            rest = iter(x["head"])
            while run.base < start and (c := next(rest, None)) is not None:
                while run.full(c):
                    run.close()
                run.add(c)
            if run.base >= start:
                place = run.base - start
                at = x["opens"][place]
                state["run"] = Run(bounds, run.number + x["counts"][place], start + at, x["tail"][at - x["at"] :])
            state["start"] = start + x["n"]
            return entry

        told = parts.mapInArrow(tell, f"own {kind}, block int, n long, head array<long>, opens array<long>, counts array<long>, at long, tail array<long>")
        last = cut.groupBy(F.struct("own").alias("key")).agg(F.max("block").alias("end"))
        told = told.withColumn("key", F.struct("own")).join(F.broadcast(last), "key").withColumn("final", F.col("block") == F.col("end"))
        told = told.drop("key", "end").repartition("own").sortWithinPartitions("own", "block")
        entries = told.mapInArrow(follow, f"own {kind}, block int, entry struct<number: long, base: long, open: array<long>, final: boolean>")
        empty = F.lit(None).cast(plain.schema["order"].dataType).alias("order")
        feed = feed.unionByName(entries.select("own", "block", F.lit(None).cast("long").alias("cost"), "entry", empty))
        feed = feed.repartition("block").sortWithinPartitions("block", "own", F.col("entry").isNull(), "order")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, run, final, out, types = None, Run(bounds), True, [], None

        def table() -> pa.RecordBatch:
            arrays = [pa.array([x[0] for x in out], types), *(pa.array([x[i] for x in out], pa.int64()) for i in range(1, 5))]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, ["own", *RUNS])

        for batch in batches:
            types = batch.schema.field("own").type
            for own, block, value, entry in zip(*(batch.column(c).to_pylist() for c in ("own", "block", "cost", "entry")), strict=True):
                if (own, block) != where:
                    if final and run.costs:
                        out.append((where[0], *run.close()))
                    where, run, final = (own, block), Run(bounds), True
                if entry is not None:
                    run, final = Run(bounds, entry["number"], entry["base"], entry["open"]), entry["final"]
                    continue
                while run.full(value):
                    out.append((own, *run.close()))
                run.add(value)
            if out:
                yield table()
        if final and run.costs:
            out.append((where[0], *run.close()))
        if out:
            yield table()

    return feed.drop("order").mapInArrow(packed, f"own {kind}, chunk long, first long, last long, size long").withColumnRenamed("own", group)
