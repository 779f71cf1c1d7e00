"""python -m tidyspark: clean monthly trip files into an enriched Parquet folder."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators.metrics import require_parallelism
from .plans.cleaning import run


def within(low: int, high: int):
    """An option's type: a whole number from low to high."""

    def number(text: str) -> int:
        if not low <= (n := int(text)) <= high:
            raise argparse.ArgumentTypeError(f"{n} is not from {low} to {high}")
        return n

    return number


def main(argv: list[str] | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="tidyspark", description=__doc__)
    parser.add_argument("--data-dir", required=True)
    parser.add_argument("--zones", required=True)
    parser.add_argument("--months", type=within(1, 9), default=9)
    parser.add_argument("--partitions", type=within(1, 1_000_000), default=64, help="shuffle partitions")
    parser.add_argument("--output", required=True)
    parser.add_argument("--metrics")
    parser.add_argument("--strategy", choices=("broadcast", "merge", "shuffle_hash"))
    parser.add_argument("--native", action="store_true", help="features as native expressions")
    parser.add_argument("--least-cores", type=within(1, 1_000_000), default=1)
    parser.add_argument("--batch-rows", type=within(1, 10_000_000), default=10_000, help="rows of an Arrow batch")
    args = parser.parse_args(argv)
    spark = (
        SparkSession.builder.appName("tidyspark").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", args.partitions).config("spark.sql.execution.arrow.maxRecordsPerBatch", args.batch_rows).getOrCreate()
    )
    require_parallelism(spark, args.least_cores)
    return run(spark, args.data_dir, args.zones, args.months, args.output, args.metrics, strategy=args.strategy, exact=not args.native)


if __name__ == "__main__":
    main()
