"""Guarded outputs, run records and plan texts."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import exists, file_statistics, read_outputs


def guard_new(spark: SparkSession, path: str) -> str:
    """path, if nothing is there yet."""
    if exists(spark, path):
        raise FileExistsError(path)
    return path


def write_parquet(df: DataFrame, path: str, compression: str = "snappy") -> None:
    """Write df to a new folder; an existing one is refused before a job starts."""
    guard_new(df.sparkSession, path)
    df.sparkSession.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    df.write.mode("errorifexists").option("compression", compression).parquet(path)


def write_buckets(df: DataFrame, path: str, column: str, buckets: int = 128) -> None:
    """Write df partitioned by a hash bucket of a column, for comparisons bucket by bucket."""
    guard_new(df.sparkSession, path)
    routed = df.withColumn("_bucket", F.pmod(F.xxhash64(column), F.lit(buckets)))
    routed.repartition("_bucket").write.option("compression", "zstd").partitionBy("_bucket").parquet(path)


def materialise(df: DataFrame) -> None:
    """Run df to its end and keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.option("header", True).csv(guard_new(df.sparkSession, path))


def inspect_output(spark: SparkSession, path: str) -> dict:
    """Rows, files and bytes of an output folder, which must hold at least one file."""
    files = read_outputs(spark, path).inputFiles()
    if not files:
        raise ValueError(f"{path} holds no Parquet file")
    total = file_statistics(spark, files).agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")).first()
    return {"rows": total["rows"], "files": len(files), "bytes": total["bytes"]}


def write_text(path: str, text: str) -> None:
    """A text file on the driver, its folder made if need be."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def write_record(path: str, record: dict) -> None:
    """A run's JSON document; numbers that JSON lacks are refused."""
    write_text(path, f"{json.dumps(record, indent=2, allow_nan=False, default=str)}\n")


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """The physical plan, as explain prints it."""
    import contextlib
    import io

    with contextlib.redirect_stdout(out := io.StringIO()):
        df.explain(mode)
    return out.getvalue()
