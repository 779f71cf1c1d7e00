"""The taxi-trip contract and the cleaning plan, from files to the enriched output."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import Contract, Field, micros_between
from ..functions.features import FEATURES, features, native_features, pickup_hour
from ..operators import dedup, enrich

DAY_MICROS = 86_400_000_000
LABELS = {"Borough": "borough", "Zone": "zone", "service_zone": "service_zone"}


def trip_contract(months: int) -> Contract:
    """The canonical trip columns and their rules for the first ``months`` months of 2023."""
    end = datetime(2023, months + 1, 1)
    start, stop = "tpep_pickup_datetime", "tpep_dropoff_datetime"
    took = lambda: micros_between(F.col(start), F.col(stop))
    # Names, order, kinds and bounds of the canonical columns.
    fields = (
        Field("VendorID", "int", above=0.0),
        Field(start, "timestamp", low=datetime(2023, 1, 1), below=end),
        Field(stop, "timestamp"),
        Field("passenger_count", "int", low=1.0, high=8.0),
        Field("trip_distance", "float", above=0.0, high=1000.0),
        Field("RatecodeID", "int", above=0.0),
        Field("store_and_fwd_flag", "string", allowed=("Y", "N")),
        Field("PULocationID", "int"),
        Field("DOLocationID", "int"),
        Field("payment_type", "int"),
        Field("fare_amount", "float", low=0.0),
        Field("extra", "float"),
        Field("mta_tax", "float"),
        Field("tip_amount", "float"),
        Field("tolls_amount", "float"),
        Field("improvement_surcharge", "float"),
        Field("total_amount", "float", low=0.0),
        Field("congestion_surcharge", "float"),
        Field("airport_fee", "float"),
    )
    return Contract(fields, (("duration", lambda: (took() > 0) & (took() <= DAY_MICROS)),))


def enriched(trips: DataFrame, zones: DataFrame, strategy: str | None = None, exact: bool = True) -> DataFrame:
    """Canonical distinct trips with the labels of both ends and the derived columns, in output order.

    exact: features as Python rounds them; else as native expressions.
    """
    labels = {c: as_ for c, as_ in LABELS.items()}
    named = enrich.lookup(trips, zones, "PULocationID", "LocationID", labels, "pickup", strategy)
    named = enrich.lookup(named, zones, "DOLocationID", "LocationID", labels, "dropoff", strategy)
    start, stop = F.col("tpep_pickup_datetime"), F.col("tpep_dropoff_datetime")
    timed = named.withColumns({"trip_duration_us": micros_between(start, stop), "pickup_hour": pickup_hour(start)})
    inputs = F.col("trip_distance"), F.col("fare_amount"), F.col("trip_duration_us")
    if exact:
        return timed.withColumn("_f", features()(*inputs)).select(*timed.columns, *(F.col(f"_f.{n}") for n in FEATURES.names))
    return timed.select("*", *native_features(*inputs).values())


def clean_trips(raw: DataFrame, zones: DataFrame, months: int, cast: bool = False, **how) -> DataFrame:
    """The whole plan: canonicalise, filter, drop duplicates, look up, derive. cast: raw already has the contract's cast columns."""
    contract = trip_contract(months)
    # Some sixty predicates infer each other's constraints; without a join to carry them over, that only costs planning time.
    zones.sparkSession.conf.set("spark.sql.constraintPropagation.enabled", "false")
    rows = (raw if cast else contract.project(raw)).where(contract.valid()).transform(contract.finish)
    return enriched(dedup.distinct(rows), zones, **how)


def run(spark: SparkSession, data_dir: str, zones_path: str, months: int, output: str, metrics: str | None = None, **how) -> dict:
    """Files to a new Parquet folder and a run record."""
    from ..operators.metrics import Sampler, environment, sampled_peaks, timed
    from ..sources import files, sinks

    paths = files.require(spark, files.month_files(data_dir, months))
    before = files.file_statistics(spark, paths)
    sinks.guard_new(spark, output)
    zones = files.read_dimension(spark, zones_path)
    record: dict = {}
    with Sampler() as sampler, timed(record):
        plan = clean_trips(files.read_contract(spark, paths, trip_contract(months)), zones, months, cast=True, **how)
        text = sinks.plan_text(plan)
        sinks.write_parquet(plan, output)
    total = before.agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")).first()
    record |= {"input": {"files": len(paths), "rows": total["rows"], "bytes": total["bytes"]}, "output": sinks.inspect_output(spark, output), "environment": environment(spark)}
    if metrics:
        record["resources"] = sampled_peaks(spark, sampler)
        sinks.write_record(metrics, record)
        sinks.write_text(metrics.removesuffix(".json") + "_plan.txt", text)
    return record
