"""Timing, environment and resource samples."""

from __future__ import annotations

import os
import platform
import threading
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@contextmanager
def timed(record: dict, name: str = "seconds"):
    """Puts the wall-clock seconds of the block into record."""
    began = time.perf_counter()
    try:
        yield record
    finally:
        record[name] = time.perf_counter() - began


def environment(spark: SparkSession) -> dict:
    import numpy
    import pandas
    import pyarrow

    return {
        "python": platform.python_version(), "spark": spark.version, "pyarrow": pyarrow.__version__, "pandas": pandas.__version__, "numpy": numpy.__version__,
        "machine": platform.machine(), "cores": os.cpu_count(), "parallelism": spark.sparkContext.defaultParallelism,
    }


def require_parallelism(spark: SparkSession, least: int) -> None:
    """An error unless the cluster runs that many tasks at once."""
    if (n := spark.sparkContext.defaultParallelism) < least:
        raise RuntimeError(f"{n} cores are there, {least} are required")


class Sampler:
    """CPU and working set of this process, sampled until stopped: rows (epoch, name, usage in CPU seconds, memory in bytes)."""

    def __init__(self, interval: float = 1.0, name: str = "driver"):
        self.rows, self.interval, self.name, self._stop = [], interval, name, threading.Event()

    def _run(self) -> None:
        while not self._stop.is_set():
            with open("/proc/self/statm") as f:
                resident = int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
            self.rows.append((time.time(), self.name, sum(os.times()[:4]), resident))
            self._stop.wait(self.interval)

    def __enter__(self):
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *_):
        self._stop.set()
        self._thread.join()


def rates(samples: DataFrame, by: str, at: str, usage: str) -> DataFrame:
    """samples with ``rate``: the change of usage since the sample before, over the change of time; null for the first."""
    w = Window.partitionBy(by).orderBy(at)
    step = F.col(at) - F.lag(at).over(w)
    return samples.withColumn("rate", F.try_divide(F.col(usage) - F.lag(usage).over(w), step))


def peak_of_sums(samples: DataFrame, at: str, value: str, first=None, last=None) -> DataFrame:
    """peak: the largest sum of value over the samples of one time, within first and last."""
    inside = samples
    if first is not None:
        inside = inside.where(F.col(at) >= F.lit(first))
    if last is not None:
        inside = inside.where(F.col(at) <= F.lit(last))
    return inside.groupBy(at).agg(F.sum(value).alias("total")).agg(F.max("total").alias("peak"))


def sampled_peaks(spark: SparkSession, sampler: Sampler) -> dict:
    """Samples, peak CPU (cores in use) and peak memory in bytes of a finished sampler; an error if samples are missing."""
    samples = require_complete(spark.createDataFrame(sampler.rows, "epoch double, name string, usage double, memory long"), "epoch", "name", [sampler.name])
    cpu = peak_of_sums(rates(samples, "name", "epoch", "usage"), "epoch", "rate").first()["peak"]
    return {"samples": len(sampler.rows), "peak_cores": cpu, "peak_bytes": peak_of_sums(samples, "epoch", "memory").first()["peak"]}


def require_complete(samples: DataFrame, at: str, by: str, names: list[str]) -> DataFrame:
    """samples, if every time has each name once; a gap would make peaks too low."""
    bad = samples.groupBy(at).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(by).alias("k")).where((F.col("n") != len(names)) | (F.col("k") != len(names)))
    if bad.limit(1).count():
        raise ValueError("resource samples are incomplete")
    return samples
