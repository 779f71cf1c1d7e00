"""Derived features: native expressions and vectorised Python twins.

Python's ``round`` rounds the exact binary value; no built-in does. The Python features are therefore the exact ones, and the
native ones round with ``rint(x * 1e6) / 1e6``, which differs in the last kept digit in about one value in ten thousand.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEATURES = T.StructType([T.StructField(n, T.DoubleType(), False) for n in ("avg_speed_mph", "fare_per_mile", "fare_per_minute")])


def ratios(distance: float, fare: float, micros: int) -> tuple[float, float, float]:
    """Miles an hour, fare a mile and fare a minute, unrounded. Raises on what no filter should let through."""
    if not (math.isfinite(distance) and math.isfinite(fare)) or distance <= 0 or micros <= 0:
        raise ValueError("features need finite inputs, and positive distance and duration")
    return distance * 3_600_000_000.0 / micros, fare / distance, fare * 60_000_000.0 / micros


def features(digits: int | None = 6):
    """A pandas UDF of (distance, fare, micros) to the three features, rounded as Python rounds (None: not at all)."""

    @F.pandas_udf(FEATURES)
    def run(distance: pd.Series, fare: pd.Series, micros: pd.Series) -> pd.DataFrame:
        rows = [ratios(d, f, t) for d, f, t in zip(distance.tolist(), fare.tolist(), micros.tolist())]
        return pd.DataFrame([[x if digits is None else round(x, digits) for x in r] for r in rows], columns=FEATURES.names)

    return run


def plain_features(digits: int | None = 6):
    """The same as a row-at-a-time UDF, for comparison."""

    def run(distance, fare, micros):
        found = ratios(distance, fare, micros)
        return found if digits is None else tuple(round(x, digits) for x in found)

    return F.udf(run, FEATURES, useArrow=False)


def _round6(x: Column) -> Column:
    return F.rint(x * F.lit(1e6)) / F.lit(1e6)


def native_features(distance: Column, fare: Column, micros: Column, rounded: bool = True) -> dict[str, Column]:
    """The features as column expressions."""
    t = micros.cast("double")
    found = {"avg_speed_mph": distance * F.lit(3.6e9) / t, "fare_per_mile": fare / distance, "fare_per_minute": fare * F.lit(6e7) / t}
    return {k: (_round6(v) if rounded else v).alias(k) for k, v in found.items()}


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = 65_536) -> DataFrame:
    """function applied to Arrow batches of at most ``rows`` rows of df."""
    if rows < 1:
        raise ValueError("a batch has at least one row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield function(batch.slice(at, rows))

    return df.mapInArrow(run, schema)


@F.pandas_udf(T.DoubleType())
def identity(x: pd.Series) -> pd.Series:
    return x


@F.pandas_udf(T.DoubleType())
def speed(distance: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    """Distance an hour between two timestamps."""
    return distance / ((end - start).dt.total_seconds() / 3600.0)


def native_speed(distance: Column, start: Column, end: Column) -> Column:
    return distance / (F.timestamp_diff("MICROSECOND", start, end).cast("double") / F.lit(1e6) / F.lit(3600.0))


def pickup_hour(at: Column) -> Column:
    return F.hour(at).cast("bigint")
