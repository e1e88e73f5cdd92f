"""Vector arithmetic on arrays, in double precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(F.lit(0.0))


def normalized(a: Column) -> Column:
    """``a`` at length 1; the zero vector as it is."""
    length = norm(a)
    return F.transform(a, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double")))


def to_blob(a: Column) -> Column:
    """A vector as little-endian 32-bit floats; null stays null."""

    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())

    return run(a)


def from_blob(blob: Column) -> Column:
    """The vector of a blob; null for null and for lengths that aren't whole floats."""

    @F.pandas_udf("array<float>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, dtype="<f4"))

    return run(blob)
