import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidyspark.contract import Contract, Field, floor_nanos, resolve
from tidyspark.functions import features


def one(spark, kind, values, **how):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r.x for r in Contract((Field("x", kind, **how),)).clean(df).collect()]


def test_numbers(spark):
    assert one(spark, "int", ["1", " 2 ", "2.5", "x", "", None, "nan", "inf", "-0.0", "9223372036854775808", "-9223372036854775808", "1e3"]) == [1, 2, 0, -(2**63), 1000]
    got = one(spark, "float", ["1.5", "-0.0", "NaN", "-Infinity", "abc", "1e300"])
    assert got == [1.5, 0.0, 1e300] and str(got[1]) == "0.0"


def test_flag_trims_spaces_only(spark):
    assert one(spark, "string", [" y ", "N", "\tY", "maybe", None], allowed=("Y", "N")) == ["Y", "N"]


def test_bounds(spark):
    assert one(spark, "float", ["0", "0.1", "30", "30.1"], above=0.0, high=30.0) == [0.1, 30.0]
    assert one(spark, "int", ["0", "1", "8", "9"], low=1.0, high=8.0) == [1, 8]


def test_timestamps(spark):
    got = one(spark, "timestamp", ["2023-01-01 00:00:00", "2022-12-31 23:59:59.999999", "2023-02-01", "junk"], low=datetime(2023, 1, 1), below=datetime(2023, 2, 1))
    assert got == [datetime(2023, 1, 1)]
    nanos = spark.createDataFrame([(1_500,), (-1,), (-1_000,)], "n long").select(floor_nanos(F.col("n")).alias("t")).collect()
    assert [r.t.microsecond for r in nanos] == [1, 999_999, 999_999]


def test_resolve():
    assert resolve(["A", "b", "B", "extra"], ["a", "b"]) == {"a": "A", "b": "B"}
    with pytest.raises(ValueError, match="y, z"):
        resolve(["x"], ["x", "y", "z"])


def test_reasons(spark):
    df = spark.createDataFrame([(None, "Y"), ("1", "q"), ("2.5", None)], "n string, f string")
    got = Contract((Field("n", "int"), Field("f", "string", allowed=("Y",)))).reasons(df).collect()
    assert [r.reasons for r in got] == [["n.present", "n.finite", "n.integral"], ["f.allowed"], ["n.integral", "f.present", "f.allowed"]]


def test_range_rules_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("cast(id as int) x", "cast(id as double) y").write.parquet(str(tmp_path / "t"))
    df = Contract((Field("x", "int", low=3.0), Field("y", "float", above=5.0))).clean(spark.read.parquet(str(tmp_path / "t")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(x,3" in plan and "GreaterThan(y,5.0)" in plan


def test_features_round_as_python(spark):
    rng = random.Random(1)
    rows = [(rng.uniform(0.01, 50), rng.uniform(0, 500), rng.randint(1, 10**10)) for _ in range(3000)] + [(1.0, 0.0000005, 60_000_000), (8.0, 0.5000015 * 8, 1)]
    df = spark.createDataFrame(rows, "d double, f double, t long")
    for udf in (features.features(), features.plain_features()):
        got = df.select("d", "f", "t", udf("d", "f", "t").alias("x")).collect()
        assert all(tuple(r.x) == tuple(round(v, 6) for v in features.ratios(r.d, r.f, r.t)) for r in got)
    with pytest.raises(ValueError):
        features.ratios(0.0, 1.0, 1)
    with pytest.raises(Exception, match="features need"):
        spark.createDataFrame([(1.0, 1.0, 0)], "d double, f double, t long").select(features.features()("d", "f", "t").alias("x")).collect()
