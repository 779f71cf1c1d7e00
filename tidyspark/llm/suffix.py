"""Exact removal of long repeats: bytes covered by a string of ``length`` bytes that also starts earlier.

Every window of ``length`` bytes has one anchor: the least of its ``GRAM``-byte strings by hash, the leftmost of equals. Equal
windows have equal anchors at the same place, so all copies of a window meet under their anchor. The windows that follow each other
under one anchor are one run, and a run is what is compared: by the hash of its anchor, and by a hash of all its bytes.

1. Anchors that are there once are dropped; the other runs stay as a table.
2. Runs that are equal as a whole: all but the first place are repeats, found by a pre-aggregated first place and a plain join.
3. Anchors with several different runs: the first place of each different run is cut out of its document, and in shards by
   anchor all windows are ranked by doubling, as in building a suffix array, up to ``length``; of equal windows all but the first are repeats.

A passage that many documents share is thus one run of step 3, however often it is there. This replaces the run-length
compressed index that the operator is named for; the README says why.

Defined results: a null text counts as empty; texts shorter than ``length`` lose nothing; every input row gives one output row: rows that
repeat both doc_id and text are one document, rows that repeat only doc_id are documents of their own, in the order of their texts; a
null doc_id comes before all others; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, scratch, temporary

GRAM = 32
RUNS = "h long, c long, doc_id long, s long, n int"
MARKED = "doc_id long, s long, n int"
DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
#: Windows of a text that are looked at together; a place in a piece fits the low bits of a key.
PIECE, LOW = 1 << 19, np.uint64((1 << 20) - 1)
#: Bytes that a shard of step 3 holds, about.
SHARD = 4_000_000
_BASES = [(p, pow(p, -1, 1 << 64)) for p in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)]
_powers: dict = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ..., n modulo 2 ** 64."""
    if len(_powers.get(base, ())) <= n:
        factors = np.full(max(n + 1, 1 << 16), base, np.uint64)
        factors[0] = 1
        _powers[base] = np.cumprod(factors)
    return _powers[base]


def _mix(x: np.ndarray) -> np.ndarray:
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(factor)
    return x ^ (x >> np.uint64(29))


def _spans(data: np.ndarray, which: int):
    """A function of starts and ends to hashes of data[start:end]."""
    base, inverse = _BASES[which]
    sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(base, len(data))[: len(data)])]
    undo = _power(inverse, len(data))
    return lambda a, b: _mix((sums[b] - sums[a]) * undo[a])


def runs(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """h, c, s and n: for windows s to s + n - 1 of data, the hash of their anchor, and that of their bytes and its place in them."""
    found = []
    for begin in range(0, len(data) - length + 1, PIECE):
        part = data[begin : begin + PIECE + length - 1]
        gram, whole = _spans(part, 0), _spans(part, 1)
        at = np.arange(len(part) - GRAM + 1)
        hashes = gram(at, at + GRAM)
        key, width, wanted = (hashes & ~LOW) | at.astype(np.uint64), 1, length - GRAM + 1
        while 2 * width <= wanted:
            key, width = np.minimum(key[:-width], key[width:]), 2 * width
        if rest := wanted - width:
            key = np.minimum(key[:-rest], key[rest:])
        anchor = (key & LOW).astype(np.int64)
        s = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        n = np.diff(np.r_[s, len(anchor)])
        c = _mix(whole(s, s + n + length - 1) + (anchor[s] - s).astype(np.uint64))
        found.append((hashes[anchor[s]].view(np.int64), c.view(np.int64), s + begin, n))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else tuple(np.zeros(0, np.int64) for _ in range(4))


def _data(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


def _runs(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                h, c, s, n = runs(_data(text.as_py()), length)
                if len(h):
                    ids = pa.array([doc_id.as_py()], pa.int64()).take(pa.array(np.zeros(len(h), np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), ids, pa.array(s), pa.array(n.astype(np.int32))], ["h", "c", "doc_id", "s", "n"])

    return run


def _cut_out(length: int):
    """The bytes of runs, from the rows of documents with their runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, own in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("own").to_pylist()):
                data = (text.as_py() or "").encode()
                out += [(r["h"], doc_id, r["s"], r["n"], data[r["s"] : r["s"] + r["n"] + length - 1]) for r in own]
            columns = [pa.array(x, k) for x, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))] if out else []
            if out:
                yield pa.RecordBatch.from_arrays(columns, ["h", "doc_id", "s", "n", "data"])

    return run


def _classes(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Numbers that are equal for equal strings text[at : at + length]: ranks of 8 bytes, doubled up to half of length and more."""
    eight = np.lib.stride_tricks.sliding_window_view(np.r_[text, np.zeros(7, np.uint8)], 8)
    rank, width = np.unique(np.ascontiguousarray(eight).view(np.uint64).ravel(), return_inverse=True)[1], 8
    while 2 * width <= length:
        behind = np.r_[rank[width:], np.zeros(min(width, len(rank)), np.int64)]
        rank, width = np.unique(rank * (len(rank) + 1) + behind, return_inverse=True)[1], 2 * width
    return rank[at] * (len(rank) + 1) + rank[at + length - width]


def _repeats(length: int):
    """Of the windows of a shard, those that are there earlier, as runs."""

    def run(rows: pa.Table) -> pa.Table:
        ids = rows["doc_id"].to_pylist()
        s, n = rows["s"].to_numpy(), rows["n"].to_numpy().astype(np.int64)
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, s[i])), np.int64)
        parts = rows["data"].to_pylist()
        text = np.frombuffer(b"".join(parts[i] for i in order), np.uint8)
        s, n = s[order], n[order]
        starts = np.cumsum(n + length - 1) - (n + length - 1)
        of = np.repeat(np.arange(len(order)), n)  # the run of each window; windows go by place
        place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        if not len(of):
            return pa.table({"doc_id": pa.array([], pa.int64()), "s": pa.array([], pa.int64()), "n": pa.array([], pa.int32())})
        # Equal windows share a class, known by its first place.
        _, first, rank = np.unique(_classes(text, starts[of] + place, length), return_index=True, return_inverse=True)
        again = first[rank] != np.arange(len(of))
        same = np.r_[False, of[1:] == of[:-1]]
        begin = np.flatnonzero(again & ~(np.r_[False, again[:-1]] & same))
        end = np.flatnonzero(again & ~(np.r_[again[1:], False] & np.r_[same[1:], False]))
        return pa.table({"doc_id": rows["doc_id"].take(pa.array(order[of[begin]])), "s": pa.array(s[of[begin]] + place[begin], pa.int64()), "n": pa.array((end - begin + 1).astype(np.int32))})

    return run


def _finish(length: int):
    """The digest of each document without the bytes of its marked windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, own in zip(batch.column("text"), batch.column("own").to_pylist()):
                data = _data(text.as_py())
                step = np.zeros(len(data) + 1, np.int64)
                for r in own or ():
                    step[r["s"]] += 1
                    step[r["s"] + r["n"] + length - 1] -= 1
                gone = np.cumsum(step[:-1]) > 0
                spans = int(np.count_nonzero(gone & ~np.r_[False, gone[:-1]])) if len(gone) else 0
                out.append((len(data), int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            columns = [pa.array(x, k) for x, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))] if out else [pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _with(docs: DataFrame, of: DataFrame, how: str) -> DataFrame:
    """doc_id, text and own: the list of structs that ``of`` (doc_id, r) has for a document."""
    lists = of.groupBy("doc_id").agg(F.collect_list("r").alias("own")).withColumnRenamed("doc_id", "_of")
    return docs.join(lists, docs["doc_id"].eqNullSafe(lists["_of"]), how).select("doc_id", "text", "own")


def marked(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, s and n: windows s to s + n - 1 of each document that start earlier too."""
    found = docs.mapInArrow(_runs(length), RUNS)
    place = F.struct("doc_id", "s")
    shared = cut(found.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("k > 1").select("h", (F.col("lo") != F.col("hi")).alias("mixed")), "anchors")
    kept = cut(found.join(shared, "h"), "runs")
    firsts = kept.groupBy("h", "c").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("k"), F.max("n").alias("n"), F.max("mixed").alias("mixed"))
    firsts = cut(firsts, "first-runs")
    whole = kept.join(firsts.where("k > 1").select("h", "c", "first"), ["h", "c"]).where(place != F.col("first")).select("doc_id", "s", "n")
    mixed = firsts.where("mixed").select("h", F.col("first.doc_id").alias("doc_id"), F.struct("h", F.col("first.s").alias("s"), "n").alias("r"), "n")
    shards = max(1, -(-(mixed.agg(F.sum(F.col("n") + length - 1)).first()[0] or 0) // SHARD))
    data = _with(docs, mixed, "inner").mapInArrow(_cut_out(length), "h long, doc_id long, s long, n int, data binary")
    parts = data.withColumn("shard", F.pmod("h", F.lit(shards))).groupBy("shard").applyInArrow(_repeats(length), MARKED)
    return whole.unionByName(parts)


def dedup_digest(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    if length < GRAM:
        raise ValueError(f"repeats must have at least {GRAM} bytes")
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = texts.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("k")).first()
    if counts["n"] != counts["k"]:  # documents get numbers in the order of doc_id and text
        told = texts.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n")).orderBy(F.asc_nulls_first("doc_id"), "text")
        told = cut(told.select(F.monotonically_increasing_id().alias("id"), "doc_id", "text", "n"), "documents")
        found = dedup_digest(told.select(F.col("id").alias("doc_id"), "text"), length).withColumnRenamed("doc_id", "id")
        each = told.select("id", "doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
        return each.join(found, "id").drop("id", "copy")
    spark = docs.sparkSession
    path = scratch(spark, "marked")
    with temporary(spark):
        spans = cut(marked(texts, length), "marked", path)
    return _with(texts, spans.select("doc_id", F.struct("s", "n").alias("r")), "left").mapInArrow(_finish(length), DIGEST)
