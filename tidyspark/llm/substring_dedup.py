"""Substring deduplication by sliding sentence spans.

A text is cut into sentences that, put end to end, are the text. From every sentence starts one run, and with
``ends`` one ends at every sentence: the fewest consecutive sentences with at least ``least_words`` words, two at least (one of
``LONG`` words counts as several). With ``ends``, a repeated passage of whole sentences is covered from its first to its last; without,
its last sentences may stay. Runs are compared by a 128-bit hash of their lower-cased words over the whole corpus. The first place of a run, by doc_id and then
by position, stays; the sentences of all its other places are removed.

Occurrences are pre-aggregated by hash before the shuffle, and joined back to the first places by a plain equi-join whose
hot keys Spark may split: a passage that a third of all documents share is one row of the aggregate and never meets in one task.

Defined results: null and empty texts have no sentence and stay as they are; texts without a run (fewer words than
``least_words``, or one sentence) stay; rows that repeat both doc_id and text are one document, and each of them
keeps its text; rows that repeat only doc_id are documents of their own, of which ties go by the hash of the text; a null doc_id
comes first; an empty table gives an empty result; all columns of the input come back, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, scratch, temporary

#: A sentence of so many words is a run of its own.
LONG = 40
#: Runs that leave a worker at a time.
ROWS = 20_000
RUNS = "h1 long, h2 long, doc_id long, t long, pos int, n int"
_END = re.compile(r"(?<=[.!?…])(?=\s)|(?<=\n)(?=\S)")


def sentences(text: str) -> list[str]:
    """The sentences of text; each but the first begins with the white space behind the one before, if there is any."""
    return _END.split(text) if text else []


def runs(text: str, least_words: int, ends: bool = False) -> Iterator[tuple[int, int, bytes]]:
    """(first sentence, number of sentences, 128-bit hash) of each run of text."""
    words, sent = [s.lower().split() for s in sentences(text)], set()
    for i, own in enumerate(words):
        if not own:
            continue
        n, k, run = len(own), 1, list(own)
        j = i + 1
        while (n < least_words or k < 2 and n < LONG) and j < len(words):
            run += words[j]
            n, k, j = n + len(words[j]), k + bool(words[j]), j + 1
        if n >= least_words and (k >= 2 or n >= LONG):
            yield i, j - i, xxhash.xxh3_128_digest(" ".join(run).encode())
            sent.add((i, j))
    for j in range(len(words) if ends else 0, 0, -1):
        if not words[j - 1]:
            continue
        n, k, i = len(words[j - 1]), 1, j - 1
        while (n < least_words or k < 2 and n < LONG) and i > 0:
            i -= 1
            n, k = n + len(words[i]), k + bool(words[i])
        if n >= least_words and (k >= 2 or n >= LONG) and (i, j) not in sent:
            yield i, j - i, xxhash.xxh3_128_digest(" ".join(w for own in words[i:j] for w in own).encode())


def _runs(least_words: int, ends: bool):
    kinds = [pa.int64()] * 4 + [pa.int32()] * 2

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*found), kinds)], ["h1", "h2", "doc_id", "t", "pos", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for doc_id, t, text in zip(batch.column(0), batch.column(1), batch.column(2)):
                doc_id, t = doc_id.as_py(), t.as_py()
                for i, n, digest in runs(text.as_py() or "", least_words, ends):
                    found.append((int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True), doc_id, t, i, n))
                    if len(found) >= ROWS:
                        yield batch_of(found)
                        found = []
            if found:
                yield batch_of(found)

    return run


def repeated_spans(docs: DataFrame, least_words: int = 16, ends: bool = False) -> DataFrame:
    """doc_id, t (hash of the text), pos and n of each run that is not the first place of its hash."""
    bounded_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    found = cut(docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("t"), text.alias("text")).mapInArrow(_runs(least_words, ends), RUNS), "runs")
    place = F.struct("doc_id", "t", "pos")
    firsts = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select("h1", "h2", "first")
    firsts = cut(firsts, "first-places")  # a plain shuffle on both sides of the join, so that Spark can split its hot keys
    return found.join(firsts, ["h1", "h2"]).where(place != F.col("first")).select("doc_id", "t", "pos", "n")


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (row, text, spans) to (row, text without the spans, sentences, removed sentences)."""
    for whole in batches:
        for begin in range(0, whole.num_rows, 64):
            batch = whole.slice(begin, 64)
            texts, removed, total = [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                text = text.as_py()
                parts = sentences(text or "")
                gone = {i for s in spans.as_py() or () for i in range(s["pos"], s["pos"] + s["n"])}
                texts.append("".join(p for i, p in enumerate(parts) if i not in gone).lstrip() if gone else text)
                removed.append(len(gone))
                total.append(len(parts))
            columns = [batch.column("row"), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "text", "n_sentences", "n_removed"])


def clean(docs: DataFrame, least_words: int = 16, ends: bool = False) -> DataFrame:
    """row (the input's columns but text), text without the removed sentences, n_sentences and n_removed of every row."""
    others = [c for c in docs.columns if c != "text"]
    text = F.col("text").cast("string")
    spark = docs.sparkSession
    path = scratch(spark, "spans")
    with temporary(spark):
        lists = repeated_spans(docs, least_words, ends).groupBy("doc_id", "t").agg(F.collect_set(F.struct("pos", "n")).alias("spans"))
        spans = cut(lists.withColumnsRenamed({"doc_id": "s_id", "t": "s_t"}), "spans", path)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))
    joined = rows.join(spans, rows["doc_id"].eqNullSafe(spans["s_id"]) & (rows["t"] == spans["s_t"]), "left").select("row", "text", "spans")
    kind = joined.schema["row"].dataType.simpleString()
    return joined.mapInArrow(_remove, f"row {kind}, text string, n_sentences long, n_removed long")


def dedup(docs: DataFrame, least_words: int = 16, ends: bool = False) -> DataFrame:
    """docs with every column, its texts without repeated spans; documents that lose all their text are left out."""
    cleaned = clean(docs, least_words, ends).where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return cleaned.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
