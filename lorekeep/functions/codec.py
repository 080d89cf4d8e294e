"""Vector transport: arrays of floats as bytes and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

def encode_vector(vector: Column) -> Column:
    """An array of floats as little-endian bytes."""

    @F.pandas_udf("binary")
    def data(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if v is None else np.asarray(v, "<f4").tobytes() for v in batch])

    return data(vector)


def decode_vector(data: Column) -> Column:
    """Little-endian bytes as an array of floats."""

    @F.pandas_udf("array<float>")
    def vector(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if d is None else np.frombuffer(d, "<f4") for d in batch])

    return vector(data)
