"""Scans of drifting Parquet files, the CSV dimension, and file statistics."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import Contract, floor_nanos

LABEL = "Unknown"


def month_files(data_dir: str, months: int, pattern: str = "yellow_tripdata_2023-{:02d}.parquet", most: int = 9) -> list[str]:
    """Paths of the files of months 1 to ``months``."""
    if not 1 <= months <= most:
        raise ValueError(f"months must be from 1 to {most}, not {months}")
    return [f"{data_dir.rstrip('/')}/{pattern.format(m)}" for m in range(1, months + 1)]


def _file_system(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def exists(spark: SparkSession, path: str) -> bool:
    """Whether path is there, on any file system that Spark reaches."""
    system, there = _file_system(spark, path)
    return system.exists(there)


def require(spark: SparkSession, paths: list[str]) -> list[str]:
    """paths, if all are there; else an error that names every missing one."""
    if missing := [p for p in paths if not exists(spark, p)]:
        raise FileNotFoundError(f"missing files: {', '.join(missing)}")
    return paths


def read_contract(spark: SparkSession, paths: list[str], contract: Contract) -> DataFrame:
    """The contract's columns, cast, of Parquet files whose schemas may differ: one scan for each physical schema.

    Timestamps in nanoseconds are read as integers and floored to microseconds; timestamps with a time zone are an error.
    """
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    groups = defaultdict(list)
    for path in paths:
        schema = spark.read.parquet(path).schema
        groups[tuple((f.name, f.dataType.simpleString()) for f in schema.fields)].append((path, schema))
    scans = []
    for files in groups.values():
        df = spark.read.schema(files[0][1]).parquet(*(p for p, _ in files))
        kinds = {f.name.lower(): f for f in contract.fields}
        fixed = {}
        for name, kind in df.dtypes:
            if (field := kinds.get(name.lower())) and field.kind == "timestamp":
                if kind == "timestamp":
                    raise ValueError(f"column {name} has a time zone; naive timestamps are expected")
                if kind == "bigint":
                    fixed[name] = floor_nanos(F.col(f"`{name}`"))
        scans.append(contract.project(df.withColumns(fixed) if fixed else df))
    return reduce(DataFrame.unionByName, scans)


def read_uniform(spark: SparkSession, paths: list[str], contract: Contract) -> DataFrame:
    """The contract's columns, cast, with one scan a file, put together by name."""
    return reduce(DataFrame.unionByName, (contract.project(spark.read.parquet(p)) for p in paths))


def label(column) -> F.Column:
    """A label without surrounding white space; blank and null become ``Unknown``."""
    return F.coalesce(F.nullif(F.regexp_replace(column, r"^\s+|\s+$", ""), F.lit("")), F.lit(LABEL))


def unique_key(df: DataFrame, key: str) -> DataFrame:
    """df, if every value of key is there once; else an error with some of the repeated values."""
    repeated = df.groupBy(key).count().where("count > 1").limit(5).collect()
    if repeated:
        raise ValueError(f"{key} is not unique: {', '.join(str(r[key]) for r in repeated)}")
    return df


def rows_dimension(spark: SparkSession, rows: list[tuple], columns: str, **how) -> DataFrame:
    """The same of rows in memory; columns: their names and types."""
    return validated_dimension(spark.createDataFrame(rows, columns), **how)


def read_dimension(spark: SparkSession, path: str, key: str = "LocationID", labels: tuple[str, ...] = ("Borough", "Zone", "service_zone")) -> DataFrame:
    """A CSV dimension with a positive integral unique key and labels without blanks."""
    return validated_dimension(spark.read.csv(path, header=True, inferSchema=False), key, labels)


def validated_dimension(raw: DataFrame, key: str = "LocationID", labels: tuple[str, ...] = ("Borough", "Zone", "service_zone")) -> DataFrame:
    """A dimension with a positive integral unique key and labels without blanks."""
    if missing := [c for c in (key, *labels) if c not in raw.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    number = F.col(key).try_cast("double")
    bad = F.count_if(F.coalesce(~((number > 0) & (F.rint(number) == number)), F.lit(True)))
    if n := raw.agg(bad.alias("n")).first()["n"]:
        raise ValueError(f"{n} rows of the dimension lack a positive integral {key}")
    return unique_key(raw.select(number.try_cast("bigint").alias(key), *(label(F.col(c).cast("string")).alias(c) for c in labels)), key)


def file_statistics(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, rows and bytes of Parquet files; rows come from footers, bytes from the file system."""
    # One listing and one scan that reads no column, whatever the number of files and however their schemas drift. Paths are
    # folders or files, as given or as Spark qualifies them.
    wanted = spark.createDataFrame([(p, p.rstrip("/")) for p in require(spark, paths)], "path string, _end string")
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(paths).select(F.col("path").alias("_file"), F.col("length").alias("bytes"))
    rows = spark.read.schema("`_no_column` int").option("recursiveFileLookup", True).parquet(*paths).groupBy(F.col("_metadata.file_path").alias("_file")).agg(F.count(F.lit(1)).alias("rows"))
    plain = lambda c: F.regexp_replace(c, r"^[a-z0-9]+:/+", "/")
    files_ = sizes.select(plain(F.col("_file")).alias("_file"), "bytes").join(rows.select(plain(F.col("_file")).alias("_file"), "rows"), "_file", "left")
    # A file belongs to its own path and to every folder above it.
    parts = F.split("_file", "/")
    above = files_.select("rows", "bytes", F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("_own"))
    joined = wanted.withColumn("_own", plain(F.col("_end"))).join(above, "_own")
    return joined.groupBy("path").agg(F.sum(F.coalesce("rows", F.lit(0))).alias("rows"), F.sum("bytes").alias("bytes"))


def read_outputs(spark: SparkSession, path: str) -> DataFrame:
    """All Parquet files below path, without partition columns."""
    return spark.read.option("recursiveFileLookup", True).parquet(path)
