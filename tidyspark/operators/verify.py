"""Equivalence of relations: schemas, multisets, fingerprints, nulls and duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def schema_differences(a: DataFrame, b: DataFrame) -> list[tuple[str, str]]:
    """(column, type) pairs that one of the two has, nullability aside."""
    return sorted(set(a.dtypes) ^ set(b.dtypes))


def same_schema(a: DataFrame, b: DataFrame) -> bool:
    """Whether names, order and types agree; nullability doesn't count."""
    return a.dtypes == b.dtypes


def multiset_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows with more copies on one side, with ``side`` (a or b) and each surplus copy as a row."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def null_rows(df: DataFrame) -> DataFrame:
    """Rows with a null in any column."""
    return df.where(reduce(lambda x, y: x | y, (F.col(f"`{c}`").isNull() for c in df.columns)))


def fingerprint(df: DataFrame) -> DataFrame:
    """rows, and a sum of row hashes that depends neither on the order of rows nor on that of columns."""
    row = F.xxhash64(*(F.col(f"`{c}`") for c in sorted(df.columns)))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(row.cast("decimal(38,0)")).alias("hash_sum"), F.count_distinct(row).alias("distinct_hashes"))


def empty_like(df: DataFrame) -> DataFrame:
    return df.limit(0)


def bucketed_report(a: DataFrame, b: DataFrame, column: str, buckets: int = 128) -> DataFrame:
    """Rows of both sides, and surplus rows of each, by hash bucket of a column. Every row falls in one bucket."""
    names = [f"c{i}" for i in range(len(a.columns))]
    key = F.col(names[a.columns.index(column)])
    sided = lambda df, k: df.select(*(F.col(f"`{c}`") for c in a.columns)).toDF(*names).select("*", F.lit(k).alias("in_b"))
    equal = sided(a, 0).unionByName(sided(b, 1)).groupBy(*names).agg(F.count_if(F.col("in_b") == 0).alias("n"), F.count_if(F.col("in_b") == 1).alias("m"))
    surplus = lambda x, y: F.sum(F.greatest(F.col(x) - F.col(y), F.lit(0)))
    return equal.groupBy(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")).agg(F.sum("n").alias("rows_a"), F.sum("m").alias("rows_b"), surplus("n", "m").alias("surplus_a"), surplus("m", "n").alias("surplus_b"))


def counted_report(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows_a, rows_b, surplus_a, surplus_b, null_rows, duplicate_groups, from one signed count of equal rows.

    Each side is read once and shuffled once, as partial counts. The relations must have the same schema.
    """
    names = [f"c{i}" for i in range(len(a.columns))]
    sided = lambda df, k: df.toDF(*names).select("*", F.lit(k).alias("in_b"))
    equal = sided(a, 0).unionByName(sided(b, 1)).groupBy(*names).agg(F.count_if(F.col("in_b") == 0).alias("n"), F.count_if(F.col("in_b") == 1).alias("m"))
    some_null = reduce(lambda x, y: x | y, (F.col(c).isNull() for c in names))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return equal.agg(
        total(F.col("n")).alias("rows_a"), total(F.col("m")).alias("rows_b"), total(F.greatest(F.col("n") - F.col("m"), F.lit(0))).alias("surplus_a"), total(F.greatest(F.col("m") - F.col("n"), F.lit(0))).alias("surplus_b"),
        total(F.when(some_null, F.col("n") + F.col("m")).otherwise(0)).alias("null_rows"), (F.count_if(F.col("n") > 1) + F.count_if(F.col("m") > 1)).alias("duplicate_groups"),
    )


def report(a: DataFrame, b: DataFrame) -> dict:
    """Counts, surpluses, nulls and duplicate groups of two relations, and whether they are equal.

    Equal means: same schema, as many rows on both sides and at least one, no surplus, no null, no duplicate.
    """
    if not same_schema(a, b):
        return {"same_schema": False, "rows_a": a.count(), "rows_b": b.count(), "equal": False}
    found = {"same_schema": True} | counted_report(a, b).first().asDict()
    return found | {"equal": found["rows_a"] == found["rows_b"] > 0 and not any(found[k] for k in ("surplus_a", "surplus_b", "null_rows", "duplicate_groups"))}
