import json
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidyspark.__main__ import main
from tidyspark.operators import dedup, metrics, verify
from tidyspark.plans.cleaning import clean_trips, trip_contract
from tidyspark.sources import files, sinks
from tidyspark.streaming.incremental import clean_stream, write_available

NAMES = trip_contract(9).names


def row(month, **how):
    base = dict(
        VendorID=1, tpep_pickup_datetime=datetime(2023, month, 3, 4, 5, 6), tpep_dropoff_datetime=datetime(2023, month, 3, 4, 35, 6), passenger_count=2, trip_distance=3.5, RatecodeID=1, store_and_fwd_flag="N",
        PULocationID=1, DOLocationID=2, payment_type=1, fare_amount=14.0, extra=-0.0, mta_tax=0.5, tip_amount=0.0, tolls_amount=0.0, improvement_surcharge=1.0, total_amount=15.5, congestion_surcharge=0.0, airport_fee=0.0,
    )
    return base | how


def write(path, rows, unit="us", ints=pa.int64(), rename=None):
    kinds = {}
    for name in NAMES:
        v = rows[0][name]
        kinds[name] = pa.timestamp(unit) if isinstance(v, datetime) else pa.string() if isinstance(v, str) else ints if isinstance(v, int) else pa.float64()
    if any(isinstance(r["passenger_count"], float) for r in rows):
        kinds["passenger_count"] = pa.float64()
    t = pa.table({n: pa.array([r[n] for r in rows], kinds[n]) for n in NAMES}).append_column("surplus", pa.array([0] * len(rows)))
    pq.write_table(t.rename_columns([(rename or {}).get(n, n) for n in t.column_names]), path)


@pytest.fixture
def months(tmp_path):
    shared = row(1, passenger_count=3)
    write(tmp_path / "yellow_tripdata_2023-01.parquet", [row(1, passenger_count=2.0), row(1, passenger_count=2.5), shared | {"passenger_count": 3.0}])
    write(tmp_path / "yellow_tripdata_2023-02.parquet", [row(2), row(2), shared, row(2, store_and_fwd_flag=" y ")], unit="ns", ints=pa.int32(), rename={"airport_fee": "Airport_fee", "VendorID": "VENDORID"})
    write(tmp_path / "yellow_tripdata_2023-03.parquet", [row(3, fare_amount=-1.0), row(3, DOLocationID=99), row(3, trip_distance=0.0)], unit="ms")
    (tmp_path / "zones.csv").write_text("LocationID,Borough,Zone,service_zone\n1,Test,Zone,Test\n2, N/A ,  ,x\n")
    return tmp_path


def test_command_over_drifting_files(spark, months):
    args = ["--data-dir", str(months), "--zones", str(months / "zones.csv"), "--months", "3", "--output", str(months / "out"), "--metrics", str(months / "run.json"), "--partitions", "4"]
    record = main(args)
    out = spark.read.parquet(str(months / "out"))
    assert len(out.columns) == 30 and out.columns[:19] == NAMES
    got = out.orderBy("tpep_pickup_datetime", "passenger_count", "store_and_fwd_flag").collect()
    assert [(r.tpep_pickup_datetime.month, r.passenger_count, r.store_and_fwd_flag) for r in got] == [(1, 2, "N"), (1, 3, "N"), (2, 2, "N"), (2, 2, "Y")]
    r = got[0]
    assert (r.pickup_zone, r.dropoff_borough, r.dropoff_zone, r.trip_duration_us, r.pickup_hour) == ("Zone", "N/A", "Unknown", 1_800_000_000, 4)
    assert (r.avg_speed_mph, r.fare_per_mile, r.fare_per_minute) == (7.0, 4.0, round(14 / 30, 6))
    assert "Scan parquet" in (months / "run_plan.txt").read_text() and record["resources"]["samples"] >= 1
    assert record["output"]["rows"] == 4 and json.loads((months / "run.json").read_text())["input"]["rows"] == 10
    with pytest.raises(FileExistsError):
        main(args)


def test_strategies_agree(spark, months):
    paths = files.month_files(str(months), 3)
    raw = files.read_contract(spark, paths, trip_contract(3))
    zones = files.read_dimension(spark, str(months / "zones.csv"))
    a = clean_trips(raw, zones, 3, cast=True, strategy="merge")
    assert verify.report(a, clean_trips(raw, zones, 3, cast=True, exact=False))["equal"]
    two = files.month_files(str(months), 3)[::2]
    contract = trip_contract(3)
    assert verify.multiset_diff(files.read_contract(spark, two, contract), files.read_uniform(spark, two, contract)).count() == 0


def test_months_and_missing_files(spark, months):
    with pytest.raises(ValueError):
        files.month_files("x", 10)
    with pytest.raises(FileNotFoundError, match="2023-04.*2023-05"):
        files.require(spark, files.month_files(str(months), 5))
    short = spark.createDataFrame([(1,)], "VendorID int")
    with pytest.raises(ValueError, match="tpep_pickup_datetime.*airport_fee"):
        trip_contract(1).project(short)


@pytest.mark.parametrize(("text", "what"), [("LocationID,Borough,Zone\n1,a,b\n", "service_zone"), ("LocationID,Borough,Zone,service_zone\n1,a,b,c\n1,d,e,f\n", "not unique"), ("LocationID,Borough,Zone,service_zone\n1.5,a,b,c\n", "positive"), ("LocationID,Borough,Zone,service_zone\n0,a,b,c\n", "positive")])
def test_bad_dimensions(spark, tmp_path, text, what):
    (tmp_path / "z.csv").write_text(text)
    with pytest.raises(ValueError, match=what):
        files.read_dimension(spark, str(tmp_path / "z.csv"))


def test_equal_counts_prove_nothing(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "n int, s string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "n int, s string")
    assert verify.multiset_diff(a, b).count() == 2 and not verify.report(a, b)["equal"]
    assert verify.fingerprint(a).first() != verify.fingerprint(b).first()
    assert verify.report(a.distinct(), b.distinct())["equal"]
    assert not verify.report(a, a.select("s", "n"))["equal"]


def test_buckets_samples_and_records(spark, tmp_path):
    assert dedup.bucket_ranges(256, 4) == [64, 128, 192]
    samples = spark.createDataFrame([(1.0, "a", 5.0), (1.0, "b", 6.0), (2.0, "a", 9.0)], "epoch double, name string, usage double")
    assert metrics.peak_of_sums(samples, "epoch", "usage").first().peak == 11
    assert metrics.peak_of_sums(samples, "epoch", "usage", 2.0).first().peak == 9
    assert sorted((r.rate for r in metrics.rates(samples, "name", "epoch", "usage").collect()), key=str) == [4.0, None, None]
    with pytest.raises(ValueError):
        metrics.require_complete(samples, "epoch", "name", ["a", "b"])
    with pytest.raises(ValueError):
        sinks.write_record(str(tmp_path / "r.json"), {"x": float("nan")})
    sinks.write_buckets(samples, str(tmp_path / "b"), "epoch", 4)
    assert files.read_outputs(spark, str(tmp_path / "b")).count() == 3
    sinks.write_csv(samples, str(tmp_path / "c"))
    assert "Scan" in sinks.plan_text(spark.read.csv(str(tmp_path / "c")))
    sinks.materialise(samples)
    with metrics.Sampler(0.01) as s:
        pass
    assert s.rows and metrics.environment(spark)["spark"]


def test_dimension_rows_and_tunables(spark):
    got = files.rows_dimension(spark, [(1, "a", " ", None), (2, "b", "c", "d")], "LocationID int, Borough string, Zone string, service_zone string").orderBy("LocationID").collect()
    assert [tuple(r) for r in got] == [(1, "a", "Unknown", "Unknown"), (2, "b", "c", "d")]
    need = ["--data-dir", "x", "--zones", "y", "--output", "z"]
    for bad in (["--months", "10"], ["--partitions", "0"], ["--batch-rows", "0"], ["--batch-rows", "many"]):
        with pytest.raises(SystemExit):
            main(need + bad)


def test_file_statistics_of_drifting_files(spark, months):
    paths = files.month_files(str(months), 3)
    got = {r.path: (r.rows, r.bytes) for r in files.file_statistics(spark, paths).collect()}
    assert got == {p: (pq.read_metadata(p).num_rows, (months / p.rsplit("/", 1)[1]).stat().st_size) for p in paths}


def test_names_with_dots(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "`a.b` int, _bucket int")
    assert dedup.bucketed_distinct(df, 4).count() == 2 and dedup.bucketed_distinct(df).columns == df.columns
    assert dedup.duplicate_groups(df).count() == 1 and verify.null_rows(df).count() == 0
    assert verify.report(df, df)["duplicate_groups"] == 2 and verify.fingerprint(df).first()["distinct_hashes"] == 2


def test_stream_takes_each_row_once(spark, months):
    contract = trip_contract(3)
    schema = spark.read.parquet(str(months / "yellow_tripdata_2023-03.parquet")).schema
    (months / "in").mkdir()
    for k in range(2):
        write(months / "in" / f"{k}.parquet", [row(1), row(1), row(2)], unit="us")
    for _ in range(2):
        write_available(clean_stream(spark, str(months / "in"), schema, contract, "tpep_pickup_datetime", "400 days"), str(months / "s"), str(months / "cp")).awaitTermination(90)
    assert spark.read.parquet(str(months / "s")).agg(F.count("*").alias("n")).first().n == 2
