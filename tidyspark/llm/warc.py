"""WARC archives as chunked record tables.

Writing turns every payload into records of bounded size: one record, or for an oversized payload a chain of segments
(WARC-Segment-Number 1, 2, ..., as the WARC standard lays down). A record is one row of a Spark text write, so the commit
protocol of Spark's writers covers archives and any file system it reaches can hold them. Reading splits archives at the
version line, which no block contains because the writer ends a segment inside any occurrence of it. A read record is a row of
(record identifier, chunk number, bytes); rows of one payload are taken in order and digested as they come, so neither
side ever allocates a whole payload besides the row it came from.

Payloads of at least ``least_revisit`` bytes that are equal (by SHA-1 and length) are stored once: with the largest key as
response, with all others as revisit records that refer to it.

Defined results: null payloads are empty ones; rows that tie for the largest key of a payload each hold it; rows that repeat a key with
different payloads are records of their own; null keys are written as empty ones and never stand for others; an empty table gives empty archives
and an empty result; payloads longer than a chunk become segments; other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, partitions

#: The version line; every record begins with it.
VERSION = b"WARC/1.1\r\n"
CHUNKS = "record_id string, chunk_no int, type string, key string, refers_to string, digest string, total long, target string, block binary"
DIGESTED = "record_id string, type string, key string, refers_to string, stated_digest string, stated_bytes long, target string, payload_bytes long, payload_digest string"
#: The date of all records of a run: a retried task must write the same bytes.
DATE = b"2020-01-01T00:00:00Z"


def dedup_roles(pages: DataFrame, key: str, payload: str, least_revisit: int) -> DataFrame:
    """pages with ``_digest`` (SHA-1 in hex), ``_bytes`` and ``_response``: the key of the record that holds the payload.

    Groups are pre-aggregated by digest, and only digests that several rows share are joined back: a payload that a third
    of all rows carry is one row of the aggregate, and the join's large side may be split.
    """
    with_digest = pages.withColumns({"_digest": F.sha1(F.col(payload)), "_bytes": F.octet_length(payload).cast("long")})
    shared = (
        with_digest.where(F.col("_bytes") >= least_revisit).groupBy("_digest", "_bytes")
        .agg(F.max(key).alias("_response"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    )
    return with_digest.join(shared, ["_digest", "_bytes"], "left")


def _header(fields: list[tuple[bytes, bytes]], size: int) -> bytes:
    return VERSION + b"".join(a + b": " + b + b"\r\n" for a, b in fields) + b"Content-Length: %d\r\n\r\n" % size


def segments(payload: memoryview, chunk: int) -> Iterator[memoryview]:
    """The payload in pieces of at most chunk bytes, none of which holds a version line or makes one with the line end behind it."""
    at = 0
    while True:
        end = min(len(payload), at + chunk)
        found = bytes(payload[at:end]).find(VERSION)
        if found >= 0:
            end = at + found + len(VERSION) - 1
        if bytes(payload[max(at, end - 8) : end]) == VERSION[:-2]:
            end -= 1
        yield payload[at:end]
        at = end
        if at >= len(payload):
            return


def _records(chunk: int):
    def clean(x: str | None) -> bytes:
        return quote(x or "", safe="").encode()

    def address(x: str | None) -> bytes:
        return quote(x or "", safe="%:/?#[]@!$&'()*+,;=").replace("WARC/1.1", "WARC%2F1.1").encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for number, key, target, payload, digest, response in zip(*batch.columns):
                key, response = clean(key.as_py()), response.as_py()
                name = b"<urn:row:%s:%d>" % (key, number.as_py())
                view = memoryview(payload.as_buffer() if payload.is_valid else b"")
                common = [
                    (b"WARC-Date", DATE), (b"WARC-Target-URI", address(target.as_py())), (b"WARC-Payload-Digest", b"sha1:" + digest.as_py().encode()),
                    (b"X-Payload-Length", b"%d" % len(view)), (b"X-Row-Key", key),
                ]
                if response is not None and clean(response) != key:
                    to = clean(response)
                    fields = [(b"WARC-Type", b"revisit"), (b"WARC-Record-ID", name), *common, (b"WARC-Profile", b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), (b"X-Refers-To-Key", to)]
                    out.append(_header(fields, 0) + b"\r\n\r")
                else:
                    pieces = segments(view, chunk)
                    piece, n = next(pieces), 1
                    while piece is not None:
                        after = next(pieces, None)
                        part = name if n == 1 else name[:-1] + b":%d>" % n
                        fields = [(b"WARC-Type", b"response" if n == 1 else b"continuation"), (b"WARC-Record-ID", part), *common]
                        if n > 1 or after is not None:
                            fields.append((b"WARC-Segment-Number", b"%d" % n))
                        if n > 1:
                            fields.append((b"WARC-Segment-Origin-ID", name))
                            if after is None:
                                fields.append((b"WARC-Segment-Total-Length", b"%d" % len(view)))
                        out.append(_header(fields, len(piece)) + bytes(piece) + b"\r\n\r")  # the writer adds the last line feed
                        size += len(piece)
                        if size >= 8 * chunk:
                            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                            out, size = [], 0
                        piece, n = after, n + 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    return run


def write(pages: DataFrame, path: str, key: str = "page_id", target: str = "url", payload: str = "html", least_revisit: int = 1000, chunk: int = 1 << 20, per_file: int = 20_000) -> None:
    """Write one record, or one chain of segments, for every row of pages to gzip-compressed archives under path.

    A null payload is an empty one. Rows that repeat a key are written each; of equal payloads the largest key is the
    response (of rows with that same key, each holds the payload itself). A null key is written as an empty one and
    never stands for others. Columns besides the three named ones are left out, whatever their names.
    """
    rows = pages.select(F.col(key).alias("_key"), F.col(target).cast("string").alias("_target"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("_payload"))
    bounded_batches(pages.sparkSession)
    dealt = dedup_roles(rows, "_key", "_payload", least_revisit).select(
        F.monotonically_increasing_id().alias("_no"), F.col("_key").cast("string"), "_target", "_payload", "_digest", F.when(F.col("_key").isNotNull(), F.col("_response").cast("string"))
    )
    records = dealt.mapInArrow(_records(chunk), "value binary")
    records.select(F.col("value").cast("string")).write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", per_file).text(path)


def _field(name: str, head: F.Column) -> F.Column:
    return F.nullif(F.regexp_extract(head, rf"(?m)^{name}: ([^\r\n]*)\r?$", 1), F.lit(""))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table of archives: one row for each record or segment.

    A block is cut out by its Content-Length; a record that is shorter than it says raises an error.
    """
    lines = spark.read.option("lineSep", VERSION.decode()).text(path).select(F.col("value").cast("binary").alias("raw")).where(F.octet_length("raw") > 0)
    # Headers are ASCII, so characters before the empty line are bytes; the block is cut by bytes.
    at = F.locate("\r\n\r\n", F.col("raw").cast("string"))
    head = F.concat(F.substring(F.col("raw"), F.lit(1), at - 1).cast("string"), F.lit("\r\n"))
    parsed = lines.select("raw", at.alias("at"), head.alias("head")).withColumn("size", _field("Content-Length", F.col("head")).cast("long"))
    whole = F.octet_length("raw") >= F.col("at") + 3 + F.col("size")
    block = F.when(whole, F.substring(F.col("raw"), F.col("at") + 4, F.col("size").cast("int"))).otherwise(F.raise_error(F.lit("a WARC record is cut short")))
    f = lambda name: _field(name, F.col("head"))
    return parsed.select(
        F.coalesce(f("WARC-Segment-Origin-ID"), f("WARC-Record-ID")).alias("record_id"), F.coalesce(f("WARC-Segment-Number").cast("int"), F.lit(0)).alias("chunk_no"),
        f("WARC-Type").alias("type"), F.url_decode(F.coalesce(f("X-Row-Key"), F.lit(""))).alias("key"), F.url_decode(f("X-Refers-To-Key")).alias("refers_to"), F.substring_index(f("WARC-Payload-Digest"), ":", -1).alias("digest"),
        f("X-Payload-Length").cast("long").alias("total"), f("WARC-Target-URI").alias("target"), block.alias("block"),
    )


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests carried from chunk to chunk of a record; the rows of a record follow each other in order."""
    names = ["record_id", "type", "key", "refers_to", "stated_digest", "stated_bytes", "target", "payload_bytes", "payload_digest"]
    first, size, digest, last = None, 0, hashlib.sha1(), 0

    def row() -> pa.RecordBatch:
        values = [*(first[c] for c in ("record_id", "type", "key", "refers_to", "digest", "total", "target")), size, digest.hexdigest()]
        kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    for batch in batches:
        heads = batch.drop_columns(["block"]).to_pylist()
        for head, block in zip(heads, batch.column("block")):
            if first is None or head["record_id"] != first["record_id"]:
                if first is not None:
                    yield row()
                first, size, digest, last = head, 0, hashlib.sha1(), 0
            if head["chunk_no"] != last + 1:
                raise ValueError(f"record {head['record_id']} lacks segment {last + 1}")
            digest.update(block.as_buffer())
            size, last = size + len(block.as_buffer()), last + 1
    if first is not None:
        yield row()


def digest_records(chunks: DataFrame) -> DataFrame:
    """One row for each record: its header's statements, and the length and SHA-1 of what its chunks hold.

    Only chunks of segmented payloads are shuffled; a payload in one record is digested where it is read.
    """
    spark = chunks.sparkSession
    bounded_batches(spark)
    single = chunks.where("chunk_no = 0").select(
        "record_id", "type", "key", "refers_to", F.col("digest").alias("stated_digest"), F.col("total").alias("stated_bytes"), "target",
        F.octet_length("block").cast("long").alias("payload_bytes"), F.sha1("block").alias("payload_digest"),
    )
    chained = chunks.where("chunk_no > 0").repartition(partitions(spark), "record_id").sortWithinPartitions("record_id", "chunk_no")
    return single.unionByName(chained.mapInArrow(_carry, DIGESTED))


def round_trip(pages: DataFrame, path: str, **how) -> DataFrame:
    """Write pages to archives under path and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest are those of the bytes read; a revisit has them from the response it refers to, joined by key, and
    the digest that its own header states must be that one.
    """
    key_type = pages.schema["page_id"].dataType.simpleString()
    write(pages, path, **how)
    read = digest_records(read_chunks(pages.sparkSession, path))
    back = lambda c: F.nullif(F.col(c), F.lit("")).cast(key_type)
    held = read.where("type = 'response'").select(back("key").alias("page_id"), "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast(key_type).alias("refers_to"))
    revisits = read.where("type = 'revisit'").select(back("key").alias("page_id"), back("refers_to").alias("refers_to"), "stated_digest")
    found = held.select(F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("stated_digest"))
    # The response's digest is part of the key, so that a row that repeats the response's page_id with another payload is no match.
    wanted = revisits.select("refers_to", "stated_digest").distinct().join(found, ["refers_to", "stated_digest"]).distinct()
    again = revisits.join(wanted, ["refers_to", "stated_digest"]).select("page_id", F.col("b").alias("payload_bytes"), F.col("stated_digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to")
    return held.unionByName(again)
