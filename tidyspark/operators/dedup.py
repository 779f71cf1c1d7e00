"""Exact duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct(df: DataFrame) -> DataFrame:
    """Rows of df, each once: partial and final aggregation around one shuffle on all columns."""
    return df.distinct()


def bucketed_distinct(df: DataFrame, buckets: int = 256) -> DataFrame:
    """The same rows, routed by a hash bucket that stays out of the result. Equality of rows decides, the hash only routes."""
    names = [f"c{i}" for i in range(len(df.columns))]  # columns go by place: their own names may hold dots or repeat _bucket
    routed = df.toDF(*names).withColumn("_bucket", F.pmod(F.xxhash64(*names), F.lit(buckets)))
    return routed.repartition(buckets, "_bucket").dropDuplicates(["_bucket", *names]).select(*names).toDF(*df.columns)


def bucket_ranges(buckets: int, partitions: int) -> list[int]:
    """First buckets of the second to the last of so many ranges: equal buckets never fall apart."""
    if not 1 <= partitions <= buckets:
        raise ValueError("partitions must be from 1 to the number of buckets")
    return [buckets * i // partitions for i in range(1, partitions)]


def duplicate_groups(df: DataFrame) -> DataFrame:
    """Each row that is there more than once, with ``copies``."""
    return df.groupBy(*(F.col(f"`{c}`") for c in df.columns)).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
