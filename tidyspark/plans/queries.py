"""Registered queries of the cleaning engine over the star schema, and the same in DuckDB SQL.

The tables are clean, so queries inject dirt by rules on l_orderkey that both engines state. A trip is a line item with its
order, customer and supplier: it starts at o_orderdate in the supplier's nation and ends at l_shipdate in the customer's.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import Contract, Field, micros_between
from ..functions import features as feat
from ..operators import dedup, enrich, metrics, verify
from ..sources import files

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
YEAR_MICROS = 365 * 86_400_000_000
#: A SQL list of the columns of lineitem that the queries use.
LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_returnflag, l_shipdate"
SQL_TRIPS = """
    SELECT l_suppkey + 1 AS vendor, o_orderdate AS started, l_shipdate AS ended, l_quantity AS distance, l_extendedprice AS fare, o_totalprice AS total,
           l_returnflag AS flag, s_nationkey AS from_key, c_nationkey AS to_key, l_linenumber AS line
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
"""
SQL_MICROS = "(epoch_us(ended) - epoch_us(started))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*LINE.split(", "))


def every(n: int, value, otherwise):
    """value in the rows with l_orderkey divisible by n."""
    return F.when(F.col("l_orderkey") % n == 0, value).otherwise(otherwise)


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.col("n_name").alias("zone"), F.col("r_name").alias("borough"))


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, s = (table(spark, sf_dir, t) for t in ("orders", "customer", "supplier"))
    joined = line(spark, sf_dir).join(o, F.col("l_orderkey") == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, F.col("l_suppkey") == s.s_suppkey)
    return joined.select(
        (F.col("l_suppkey") + 1).alias("vendor"), F.col("o_orderdate").alias("started"), F.col("l_shipdate").alias("ended"), F.col("l_quantity").alias("distance"), F.col("l_extendedprice").alias("fare"),
        F.col("o_totalprice").alias("total"), F.col("l_returnflag").alias("flag"), F.col("s_nationkey").alias("from_key"), F.col("c_nationkey").alias("to_key"), F.col("l_linenumber").alias("line"),
    )


TRIPS = Contract(
    (
        Field("vendor", "int", above=0.0), Field("started", "timestamp", low=datetime(1996, 1, 1), below=datetime(2000, 1, 1)), Field("ended", "timestamp"),
        Field("distance", "float", above=0.0, high=30.0), Field("fare", "float", low=0.0), Field("total", "float", low=0.0), Field("flag", "string", allowed=("A", "R")),
        Field("from_key", "int"), Field("to_key", "int"), Field("line", "int", low=1.0, high=8.0),
    ),
    (("duration", lambda: micros_between(F.col("started"), F.col("ended")).between(1, YEAR_MICROS)),),
)
SQL_VALID = f"""
    started >= TIMESTAMP '1996-01-01' AND started < TIMESTAMP '2000-01-01' AND {SQL_MICROS} > 0 AND {SQL_MICROS} <= {YEAR_MICROS}
    AND distance > 0 AND distance <= 30 AND fare >= 0 AND total >= 0 AND vendor > 0 AND line BETWEEN 1 AND 8
"""
SQL_ZONES = "SELECT n_nationkey, n_name AS zone, r_name AS borough FROM nation JOIN region ON r_regionkey = n_regionkey"
SQL_CLEAN = f"SELECT DISTINCT * FROM ({SQL_TRIPS}) WHERE {SQL_VALID} AND flag IN ('A', 'R')"
LABELS = {"zone": "zone", "borough": "borough"}


def clean_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.distinct(TRIPS.clean(trips(spark, sf_dir)))


# --- casts, projections and normalisation


@query("""
    WITH t AS (SELECT l_orderkey, TRY_CAST(CASE WHEN l_orderkey % 23 = 0 THEN 'n/a' ELSE CAST(l_linenumber AS VARCHAR) END AS DOUBLE) AS n, l_quantity, l_shipdate FROM lineitem)
    SELECT l_orderkey, CAST(n AS BIGINT) AS line_number, l_quantity AS quantity, l_shipdate AS shipped FROM t WHERE n IS NOT NULL
""")
def canonical_cast(spark, sf_dir):
    number = every(23, F.lit("n/a"), F.col("l_linenumber").cast("string"))
    raw = line(spark, sf_dir).select(F.col("l_orderkey").alias("L_OrderKey"), number.alias("line_number"), F.col("l_quantity").cast("string").alias("quantity"), F.col("l_shipdate").alias("SHIPPED"))
    return Contract((Field("l_orderkey", "int"), Field("line_number", "int"), Field("quantity", "float"), Field("shipped", "timestamp"))).clean(raw)


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def case_insensitive_projection(spark, sf_dir):
    raw = line(spark, sf_dir).select(F.col("l_quantity").alias("L_QUANTITY"), F.col("l_linenumber").alias("L_LineNumber"), F.col("l_orderkey").alias("L_ORDERKEY"), F.lit(1).alias("extra"))
    wanted = ["l_orderkey", "l_linenumber", "l_quantity"]
    from ..contract import resolve

    return raw.select(*(F.col(actual).alias(name) for name, actual in resolve(raw.columns, wanted).items()))


@query("SELECT l_orderkey, l_linenumber, q FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_quantity END AS q FROM lineitem) WHERE q IS NOT NULL")
def drop_incomplete_rows(spark, sf_dir):
    return line(spark, sf_dir).select("l_orderkey", "l_linenumber", every(13, F.lit(None), F.col("l_quantity")).alias("q")).dropna("any")


SQL_ODD = "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 17 = 0 THEN 'NaN'::DOUBLE WHEN l_orderkey % 19 = 0 THEN 'Infinity'::DOUBLE ELSE l_quantity END AS q FROM lineitem"


@query(f"SELECT * FROM ({SQL_ODD}) WHERE isfinite(q)")
def finite_numeric_filter(spark, sf_dir):
    odd = line(spark, sf_dir).select("l_orderkey", "l_linenumber", every(17, F.lit(float("nan")), every(19, F.lit(float("inf")), F.col("l_quantity"))).alias("q"))
    return odd.where(Field("q", "float").rules()["finite"])


@query("SELECT l_orderkey, CAST(n AS BIGINT) AS n FROM (SELECT l_orderkey, CASE WHEN l_orderkey % 11 = 0 THEN l_linenumber + 0.5::DOUBLE ELSE l_linenumber END AS n FROM lineitem) WHERE n = round_even(n, 0)")
def integral_filter(spark, sf_dir):
    raw = line(spark, sf_dir).select("l_orderkey", every(11, F.col("l_linenumber") + F.lit(0.5), F.col("l_linenumber").cast("double")).alias("n"))
    return Contract((Field("l_orderkey", "int"), Field("n", "int"))).clean(raw)


@query("SELECT DISTINCT l_orderkey, l_discount + 0.0::DOUBLE AS discount, 1.0::DOUBLE / 0.05 > 0 AS positive FROM lineitem WHERE l_discount <= 0.05")
def signed_zero(spark, sf_dir):
    rows = line(spark, sf_dir).where("l_discount <= 0.05")
    minus = rows.withColumn("discount", F.when(F.col("l_discount") == 0, F.lit(-0.0)).otherwise(F.col("l_discount")))
    both = minus.select("l_orderkey", "discount").unionByName(rows.select("l_orderkey", F.col("l_discount").alias("discount")))
    even = both.select("l_orderkey", Field("discount", "float").final())
    return even.distinct().withColumn("positive", ~F.col("discount").cast("string").startswith("-"))


@query("SELECT l_orderkey, l_returnflag AS flag FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_orderkey % 7 <> 0")
def flag_normalise(spark, sf_dir):
    padded = F.concat(F.lit("  "), F.lower("l_returnflag"), F.lit(" "))
    tabbed = F.concat(F.lit("\t"), F.col("l_returnflag"))
    raw = line(spark, sf_dir).select("l_orderkey", every(7, tabbed, padded).alias("flag"))
    return Contract((Field("l_orderkey", "int"), Field("flag", "string", allowed=("A", "R")))).clean(raw)


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'Unknown' ELSE n_name END AS label FROM nation")
def label_unknown_fill(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    blank = F.when(F.col("n_nationkey") % 8 == 0, F.lit(" \t ")).when(F.col("n_nationkey") % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit("\t"), F.col("n_name"), F.lit(" ")))
    return n.select("n_nationkey", files.label(blank).alias("label"))


@query("SELECT event_id, CAST(hour(ts) AS BIGINT) AS pickup_hour FROM events")
def pickup_hour(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", feat.pickup_hour(F.col("ts")).alias("pickup_hour"))


# --- filters


@query("SELECT o_orderkey AS key, o_orderdate AS at FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-02-01' UNION ALL SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06'")
def time_window_filter(spark, sf_dir):
    def within(df, first, last):
        return Contract((Field("key", "int"), Field("at", "timestamp", low=first, below=last))).clean(df)

    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("at"))
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), F.col("ts").alias("at"))
    return within(orders, datetime(1996, 1, 1), datetime(1997, 2, 1)).unionByName(within(events, datetime(2024, 1, 5), datetime(2024, 1, 6)))


@query(f"SELECT vendor, line, {SQL_MICROS} AS micros FROM ({SQL_TRIPS}) WHERE {SQL_MICROS} > 0 AND {SQL_MICROS} <= {YEAR_MICROS}")
def duration_filter(spark, sf_dir):
    took = trips(spark, sf_dir).select("vendor", "line", micros_between(F.col("started"), F.col("ended")).alias("micros"))
    return took.where(F.col("micros").between(1, YEAR_MICROS))


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity > 0 AND l_quantity <= 30 AND l_extendedprice >= 0 AND l_linenumber BETWEEN 1 AND 4 AND l_suppkey > 0")
def range_validity_filter(spark, sf_dir):
    fields = (Field("l_orderkey", "int"), Field("l_linenumber", "int", low=1.0, high=4.0), Field("l_quantity", "float", above=0.0, high=30.0), Field("l_extendedprice", "float", low=0.0), Field("l_suppkey", "int", above=0.0))
    out = Contract(fields).clean(line(spark, sf_dir)).drop("l_suppkey")
    return out.withColumn("l_linenumber", F.col("l_linenumber").cast("int"))


@query("""
    SELECT reason, count(*) AS n FROM (
        SELECT CASE WHEN l_quantity > 30 THEN 'quantity.high' END AS reason FROM lineitem
        UNION ALL SELECT CASE WHEN l_returnflag NOT IN ('A', 'R') THEN 'flag.allowed' END FROM lineitem
        UNION ALL SELECT CASE WHEN l_orderkey % 13 = 0 THEN 'price.present' END FROM lineitem
        UNION ALL SELECT CASE WHEN l_orderkey % 13 = 0 THEN 'price.finite' END FROM lineitem
    ) WHERE reason IS NOT NULL GROUP BY reason
""")
def reject_reasons(spark, sf_dir):
    raw = line(spark, sf_dir).select(F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"), every(13, F.lit(None), F.col("l_extendedprice")).alias("price"))
    contract = Contract((Field("quantity", "float", high=30.0), Field("flag", "string", allowed=("A", "R")), Field("price", "float")))
    return contract.reasons(raw).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# --- sets and duplicates


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def union_by_name(spark, sf_dir):
    rows = line(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity")
    return rows.where("l_orderkey % 2 = 0").unionByName(rows.where("l_orderkey % 2 = 1").select("l_quantity", "l_orderkey", "l_linenumber"))


def _doubled(spark, sf_dir):
    rows = line(spark, sf_dir)
    return rows.unionByName(rows.where("l_orderkey % 5 = 0"))


@query(f"SELECT DISTINCT {LINE} FROM lineitem")
def global_distinct(spark, sf_dir):
    return dedup.distinct(_doubled(spark, sf_dir))


@query(f"SELECT DISTINCT {LINE} FROM lineitem")
def bucketed_distinct(spark, sf_dir):
    return dedup.bucketed_distinct(_doubled(spark, sf_dir), 64)


@query(f"SELECT {LINE}, count(*) AS copies FROM (SELECT {LINE} FROM lineitem UNION ALL SELECT {LINE} FROM lineitem WHERE l_orderkey % 5 = 0) GROUP BY ALL HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    return dedup.duplicate_groups(_doubled(spark, sf_dir))


@query(f"""
    WITH a AS (SELECT {LINE} FROM lineitem UNION ALL SELECT {LINE} FROM lineitem WHERE l_orderkey % 5 = 0), b AS (SELECT {LINE} FROM lineitem WHERE l_orderkey % 7 <> 0 UNION ALL SELECT {LINE} FROM lineitem WHERE l_orderkey % 35 = 1)
    SELECT *, 'a' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'b' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)
""")
def multiset_diff(spark, sf_dir):
    rows = line(spark, sf_dir)
    other = rows.where("l_orderkey % 7 != 0").unionByName(rows.where("l_orderkey % 35 = 1"))
    return verify.multiset_diff(_doubled(spark, sf_dir), other)


@query("SELECT l_orderkey, l_linenumber, CAST(NULL AS DOUBLE) AS q FROM lineitem WHERE l_orderkey % 13 = 0")
def null_rows(spark, sf_dir):
    return verify.null_rows(line(spark, sf_dir).select("l_orderkey", "l_linenumber", every(13, F.lit(None), F.col("l_quantity")).alias("q")))


@query(f"""
    WITH a AS (SELECT {LINE} FROM lineitem UNION ALL SELECT {LINE} FROM lineitem WHERE l_orderkey % 5 = 0)
    SELECT (SELECT count(*) FROM a) AS rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM a)) AS distinct_hashes
""")
def relation_fingerprint(spark, sf_dir):
    """Rows and distinct row hashes; the sum of hashes is another one in every engine, and tested apart."""
    return verify.fingerprint(_doubled(spark, sf_dir)).select("rows", "distinct_hashes")


@query("SELECT count(*) AS rows, count(*) AS rows_shuffled, true AS same FROM lineitem")
def fingerprint_is_order_free(spark, sf_dir):
    rows = line(spark, sf_dir)
    a = verify.fingerprint(rows)
    b = verify.fingerprint(rows.select(*reversed(rows.columns)).repartition(7)).select(F.col("rows").alias("rows_shuffled"), F.col("hash_sum").alias("other"))
    return a.join(b, a["rows"] == b["rows_shuffled"]).select("rows", "rows_shuffled", (F.col("hash_sum") == F.col("other")).alias("same"))


@query("SELECT * FROM (VALUES ('o_orderdate', 'timestamp_ntz'), ('o_orderkey', 'bigint'), ('o_totalprice', 'double'), ('l_quantity', 'double'), ('l_orderkey', 'bigint')) t(name, type)")
def schema_report(spark, sf_dir):
    found = verify.schema_differences(line(spark, sf_dir).select("l_orderkey", "l_quantity"), table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate"))
    return spark.createDataFrame(found, "name string, type string")


@query(f"""
    WITH a AS (SELECT {LINE} FROM lineitem UNION ALL SELECT {LINE} FROM lineitem WHERE l_orderkey % 5 = 0), b AS (SELECT {LINE} FROM lineitem WHERE l_orderkey % 7 <> 0)
    SELECT (SELECT count(*) FROM a) AS rows_a, (SELECT count(*) FROM b) AS rows_b, (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS surplus_a,
           (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS surplus_b, 0::BIGINT AS null_rows,
           (SELECT count(*) FROM (SELECT 1 FROM a GROUP BY {LINE} HAVING count(*) > 1)) + (SELECT count(*) FROM (SELECT 1 FROM b GROUP BY {LINE} HAVING count(*) > 1)) AS duplicate_groups
""")
def equivalence_report(spark, sf_dir):
    return verify.counted_report(_doubled(spark, sf_dir), line(spark, sf_dir).where("l_orderkey % 7 != 0"))


@query("SELECT l_orderkey, l_quantity FROM lineitem LIMIT 0")
def empty_relation(spark, sf_dir):
    return verify.empty_like(line(spark, sf_dir).select("l_orderkey", "l_quantity"))


@query("SELECT CAST(sum(rows_a) AS BIGINT) AS rows_a, CAST(sum(rows_b) AS BIGINT) AS rows_b, CAST(sum(surplus) AS BIGINT) AS surplus_a, CAST(0 AS BIGINT) AS surplus_b FROM (SELECT count(*) AS rows_a, count(*) FILTER (l_orderkey % 7 <> 0) AS rows_b, count(*) FILTER (l_orderkey % 7 = 0) AS surplus FROM lineitem)")
def bucketed_compare(spark, sf_dir):
    rows = line(spark, sf_dir)
    found = verify.bucketed_report(rows, rows.where("l_orderkey % 7 != 0"), "l_orderkey", 32)
    return found.agg(*(F.sum(c).alias(c) for c in ("rows_a", "rows_b", "surplus_a", "surplus_b")))


# --- lookups


SQL_BOTH = f"""
    SELECT t.*, p.zone AS pickup_zone, p.borough AS pickup_borough, d.zone AS dropoff_zone, d.borough AS dropoff_borough
    FROM ({SQL_CLEAN}) t JOIN ({SQL_ZONES}) p ON p.n_nationkey = from_key JOIN ({SQL_ZONES}) d ON d.n_nationkey = to_key
"""
SQL_BOTH_CAST = f"SELECT * REPLACE (CAST(from_key AS BIGINT) AS from_key, CAST(to_key AS BIGINT) AS to_key, CAST(line AS BIGINT) AS line) FROM ({SQL_BOTH})"


def both_roles(df, dim, strategy=None):
    named = enrich.lookup(df, dim, "from_key", "n_nationkey", LABELS, "pickup", strategy)
    return enrich.lookup(named, dim, "to_key", "n_nationkey", LABELS, "dropoff", strategy)


@query(SQL_BOTH_CAST)
def role_played_lookup(spark, sf_dir):
    return both_roles(clean_trips(spark, sf_dir), nations(spark, sf_dir))


@query(SQL_BOTH_CAST)
def merge_lookup(spark, sf_dir):
    return both_roles(clean_trips(spark, sf_dir), nations(spark, sf_dir), "merge")


@query(SQL_BOTH_CAST)
def composite_lookup(spark, sf_dir):
    return enrich.composite_lookup(clean_trips(spark, sf_dir), nations(spark, sf_dir), ("from_key", "to_key"), "n_nationkey", LABELS, ("pickup", "dropoff"))


@query(f"SELECT * FROM ({SQL_BOTH_CAST}) WHERE from_key < 20 AND to_key < 20")
def orphan_elimination(spark, sf_dir):
    return both_roles(clean_trips(spark, sf_dir), nations(spark, sf_dir).where("n_nationkey < 20"))


@query("SELECT n_nationkey, count(*) AS n FROM (SELECT * FROM nation UNION ALL SELECT * FROM nation WHERE n_nationkey = 3) GROUP BY 1 HAVING count(*) > 1")
def dimension_uniqueness(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    files.unique_key(n, "n_nationkey")
    return n.unionByName(n.where("n_nationkey = 3")).groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


# --- features


def _features(rounded: bool) -> str:
    r = (lambda x: f"round_even({x}, 6)") if rounded else (lambda x: x)
    return f"""
        SELECT vendor, started, {r(f"distance * 3.6e9::DOUBLE / {SQL_MICROS}::DOUBLE")} AS avg_speed_mph, {r("fare / distance")} AS fare_per_mile,
               {r(f"fare * 6e7::DOUBLE / {SQL_MICROS}::DOUBLE")} AS fare_per_minute FROM ({SQL_CLEAN})
    """


def _inputs():
    return F.col("distance"), F.col("fare"), micros_between(F.col("started"), F.col("ended"))


@query(_features(True))
def trip_features_native(spark, sf_dir):
    return clean_trips(spark, sf_dir).select("vendor", "started", *feat.native_features(*_inputs()).values())


@query(_features(False))
def trip_features_udf(spark, sf_dir):
    return clean_trips(spark, sf_dir).withColumn("f", feat.features(None)(*_inputs())).select("vendor", "started", "f.*")


SQL_EXACT = "CAST(format('{{:.6f}}', {}) AS DOUBLE)"


@query(f"""
    SELECT vendor, started, {SQL_EXACT.format(f"distance * 3.6e9::DOUBLE / {SQL_MICROS}::DOUBLE")} AS avg_speed_mph, {SQL_EXACT.format("fare / distance")} AS fare_per_mile,
           {SQL_EXACT.format(f"fare * 6e7::DOUBLE / {SQL_MICROS}::DOUBLE")} AS fare_per_minute FROM ({SQL_CLEAN})
""")
def trip_features_rounded_udf(spark, sf_dir):
    """The exact features: rounded to six digits as Python does, which is what printing six digits gives."""
    return clean_trips(spark, sf_dir).withColumn("f", feat.features()(*_inputs())).select("vendor", "started", "f.*")


@query(_features(False))
def trip_features_plain_udf(spark, sf_dir):
    return clean_trips(spark, sf_dir).withColumn("f", feat.plain_features(None)(*_inputs())).select("vendor", "started", "f.*")


@query(f"SELECT vendor, line, fare / distance AS fare_per_mile FROM ({SQL_CLEAN})")
def batch_map(spark, sf_dir):
    """A function of Arrow batches of bounded rows."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def divide(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("vendor"), batch.column("line"), pc.divide(batch.column("fare"), batch.column("distance"))], ["vendor", "line", "fare_per_mile"])

    rows = clean_trips(spark, sf_dir).select("vendor", "line", "fare", "distance")
    kinds = dict(rows.dtypes)
    return feat.map_batches(rows, divide, f"vendor {kinds['vendor']}, line {kinds['line']}, fare_per_mile double", 4096)


@query("SELECT l_orderkey, l_quantity AS q FROM lineitem")
def identity_udf(spark, sf_dir):
    return line(spark, sf_dir).select("l_orderkey", feat.identity("l_quantity").alias("q"))


SQL_SPEED = f"SELECT vendor, line, distance / ({SQL_MICROS}::DOUBLE / 1e6::DOUBLE / 3600.0::DOUBLE) AS mph FROM ({SQL_TRIPS}) WHERE {SQL_MICROS} > 0"


@query(SQL_SPEED)
def speed_udf(spark, sf_dir):
    return trips(spark, sf_dir).where("ended > started").select("vendor", "line", feat.speed("distance", "started", "ended").alias("mph"))


@query(SQL_SPEED)
def speed_native(spark, sf_dir):
    return trips(spark, sf_dir).where("ended > started").select("vendor", "line", feat.native_speed(F.col("distance"), F.col("started"), F.col("ended")).alias("mph"))


# --- measurement


@query("""
    WITH s AS (SELECT date_trunc('hour', ts) AS moment, event_type, max(value) AS usage FROM events GROUP BY ALL),
         r AS (SELECT moment, event_type, (usage - lag(usage) OVER w) / ((epoch_us(moment) - lag(epoch_us(moment)) OVER w) / 1e6::DOUBLE) AS rate, usage FROM s WINDOW w AS (PARTITION BY event_type ORDER BY moment))
    SELECT moment, event_type, rate, (SELECT max(total) FROM (SELECT sum(CAST(round(usage) AS BIGINT))::BIGINT AS total FROM s WHERE moment >= TIMESTAMP '2024-01-02' GROUP BY moment)) AS peak FROM r
""")
def rate_and_peak(spark, sf_dir):
    samples = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("moment"), "event_type").agg(F.max("value").alias("usage"))
    timed = samples.withColumn("epoch", micros_between(F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz"), F.col("moment")) / F.lit(1e6))
    whole = timed.withColumn("whole", F.floor(F.col("usage") + 0.5))
    peak = metrics.peak_of_sums(whole.where(F.col("moment") >= F.lit(datetime(2024, 1, 2)).cast("timestamp_ntz")), "moment", "whole")
    return metrics.rates(timed, "event_type", "epoch", "usage").select("moment", "event_type", "rate").crossJoin(F.broadcast(peak))


@query("SELECT * FROM (SELECT 'lineitem' AS name, count(*) AS rows FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'nation', count(*) FROM nation)")
def file_stats(spark, sf_dir):
    names = ["lineitem", "orders", "nation"]
    found = files.file_statistics(spark, [f"{sf_dir}/{n}.parquet" for n in names])
    return found.select(F.regexp_extract("path", r"([^/]+)\.parquet$", 1).alias("name"), "rows")


# --- the whole plan, on dirt


SQL_DIRTY = f"""
    SELECT vendor, started, ended, CASE WHEN line = 7 THEN NULL ELSE distance END AS distance, fare, total, flag, from_key, to_key, line FROM ({SQL_TRIPS}) WHERE vendor % 11 <> 0
"""


@query(f"""
    WITH t AS (SELECT DISTINCT * FROM ({SQL_DIRTY}) WHERE {SQL_VALID} AND flag IN ('A', 'R'))
    SELECT CAST(vendor AS BIGINT) AS vendor, started, ended, distance, fare, total, flag, CAST(from_key AS BIGINT) AS from_key, CAST(to_key AS BIGINT) AS to_key, CAST(line AS BIGINT) AS line,
           p.zone AS pickup_zone, p.borough AS pickup_borough, d.zone AS dropoff_zone, d.borough AS dropoff_borough, {SQL_MICROS} AS trip_duration_us, CAST(hour(started) AS BIGINT) AS pickup_hour,
           round_even(distance * 3.6e9::DOUBLE / {SQL_MICROS}::DOUBLE, 6) AS avg_speed_mph, round_even(fare / distance, 6) AS fare_per_mile, round_even(fare * 6e7::DOUBLE / {SQL_MICROS}::DOUBLE, 6) AS fare_per_minute
    FROM t JOIN ({SQL_ZONES}) p ON p.n_nationkey = from_key JOIN ({SQL_ZONES}) d ON d.n_nationkey = to_key
""")
def end_to_end_clean(spark, sf_dir):
    """Trips with nulls, halves, padded flags, copies that are equal only once normalised, and keys as text."""
    t = trips(spark, sf_dir)
    dirty = t.withColumns({
        "vendor": F.when(F.col("vendor") % 11 == 0, F.lit("n/a")).otherwise(F.col("vendor").cast("string")),
        "distance": F.when(F.col("line") == 7, F.lit(None)).otherwise(F.col("distance")),
        "flag": F.concat(F.lit(" "), F.lower("flag"), F.lit("  ")),
    })
    both = dirty.unionByName(dirty.where("from_key % 5 = 0").withColumn("flag", F.upper(F.trim("flag"))))
    rows = both_roles(dedup.distinct(TRIPS.clean(both)), nations(spark, sf_dir))
    started, ended = F.col("started"), F.col("ended")
    timed = rows.withColumns({"trip_duration_us": micros_between(started, ended), "pickup_hour": feat.pickup_hour(started)})
    return timed.select("*", *feat.native_features(*_inputs()).values())
