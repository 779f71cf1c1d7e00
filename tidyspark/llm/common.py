"""What the operators of this subpackage share: table access and lineage cuts."""

from __future__ import annotations

import gc
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a temporary one, in local mode alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="tidyspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_owners, _made = [""], {}


@contextmanager
def owned(name: str) -> Iterator[None]:
    """Scratch tables that are made within belong to name."""
    _owners.append(name)
    try:
        yield
    finally:
        _owners.pop()


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that have ended: it does so once the driver has collected its garbage, which may be late."""
    gc.collect()
    spark._jvm.System.gc()


def release(spark: SparkSession, name: str) -> None:
    """Delete the scratch tables of name. No table or result that still reads them may be in use."""
    tidy(spark)
    for path in _made.pop(name, []):
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Scratch tables that are made within are deleted behind it, failed or not."""
    name = uuid.uuid4().hex
    try:
        with owned(name):
            yield
    finally:
        release(spark, name)


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/tidyspark/{what}-{uuid.uuid4().hex}"
    _made.setdefault(_owners[-1], []).append(path)
    return path


def cut(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """Run df once, keep it as a table in the shared folder and go on from there: lost executors lose no work."""
    spark = df.sparkSession
    path = path or scratch(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 512) -> None:
    """Long texts meet Python in small Arrow batches, so that a worker holds a few MB at a time."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
