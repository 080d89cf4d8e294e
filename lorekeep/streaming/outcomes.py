"""Traces whose outcome is new: keyed state across batches, in a stream or over a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "status string, digest string"


class LastOutcome(StatefulProcessor):
    """For each signature, the status and digest of the outcome that is stored."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", STATE)

    def handleInitialState(self, key: tuple, initial: pd.DataFrame, timers: object) -> None:
        status, digest = initial.iloc[0][["status", "digest"]]
        self.known.update((status, digest))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        last: dict[tuple, tuple] = {}  # of each batch and status, however many rows there are
        for part in rows:
            for batch, place, status, digest in zip(part["batch"], part["place"], part["status"], part["digest"], strict=True):
                if last.get((batch, status), (-1, None))[0] < place:
                    last[batch, status] = place, digest
        known, kept = self.known.get() if self.known.exists() else None, []
        for batch in sorted({b for b, _ in last}):
            new = sorted((place, status, digest) for (b, status), (place, digest) in last.items() if b == batch)
            fresh = [x for x in new if known is None or None in (known[0], known[1]) or (known[0], known[1]) != x[1:]]
            kept += [(key[0], place) for place, _, _ in fresh]
            known = fresh[-1][1:] if fresh else known
        if kept:
            self.known.update((known[0], known[1]))
        yield pd.DataFrame(kept, columns=["signature", "place"])

    def close(self) -> None:
        pass


def changed_outcomes(events: DataFrame, stored: DataFrame) -> DataFrame:
    """signature, place: the events that tell something new; events and the result may be streams.

    events: signature, status, digest, batch, place (unique, ascending), whole batches at a time; stored: signature, status, digest of the outcomes that
    there are before, each signature once. Of a batch the last event of each signature and status counts. It is new unless the outcome stored before the batch has its
    status and digest; an outcome stored without either is no proof. The last new event of a signature is what is stored then.

    A stream needs the RocksDB state store. A signature's state is two strings, and while its rows pass only the last of each batch and
    status are held.
    """
    initial = stored.select("signature", "status", "digest").groupBy("signature")
    rows = events.select("signature", "status", "digest", F.col("batch").cast("long").alias("batch"), F.col("place").cast("long").alias("place"))
    return rows.groupBy("signature").transformWithStateInPandas(
        LastOutcome(), "signature string, place long", outputMode="append", timeMode="none", initialState=initial
    )
