"""Cross-entropy difference of documents under matched bigram models of a target and a background corpus.

Both models share one vocabulary (the words of both corpora), one order and one smoothing: a bigram's share of its first
word's count, mixed by ``MIX`` with the second word's share of all events, to whose count ``ADDED`` is added for every word. A
document's score is the mean over its words, and the end of the text, of the loss under the target less the loss under the
background, in bits: low scores are like the target.

Counts are of every word and every pair of words of every text of both corpora; none is dropped, however rare. A task cuts the texts
that it reads into blocks and takes each apart once: documents become sequences of word numbers, and the block's distinct words and pairs, as sorted
64-bit hashes with their counts, go to the tasks that own them by range. An owner adds up the counts of all blocks and answers
each block that has documents to score, in the order of its question. A word or pair that makes up a third of the corpus sends one entry for each
block. Nothing of the model but the number of events reaches the driver.

Defined results: null and empty texts have one event, the end of the text; every input row gives one output row, so repeated rows and
repeated or null doc_id values stay; a corpus without text gives a uniform model; empty tables give empty results; other
columns play no part, whatever their names.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, partitions
from .packing import pack, pack_numbers, pack_sequence, unpack, unpack_numbers, unpack_sequence

SCORED = "doc_id long, n_events long, target_bits double, background_bits double"
#: A document's sequence, the words of a block, or a block's question to an owner (below -1) with or without an answer to come.
PARTS = "dest long, block long, kind int, doc_id long, payload binary"
DOCUMENT, WORDS, QUESTION, COUNTS = range(4)
#: Characters of a block, and bytes of text for each owner, about.
BLOCK, OWNED = 4_000_000, 32_000_000
MIX, ADDED = 0.5, 0.01


def words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _hashes(of: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in of), np.uint64, len(of))


def _keys(codes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of pairs (codes: numbers of both words) and of all words, and the order that sorts them."""
    x = hashes[codes >> 32] * np.uint64(0x9E3779B97F4A7C15) + hashes[codes & 0xFFFFFFFF]
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    keys = np.concatenate([x ^ (x >> np.uint64(29)), hashes])
    return keys, np.argsort(keys, kind="stable")


def _codes(sequence: np.ndarray) -> np.ndarray:
    """Each event of a text, as the numbers of the word before and the word; 0 is the edge of a text."""
    edged = np.concatenate([[0], sequence, [0]])
    return edged[:-1] << 32 | edged[1:]


def _take_apart(owners: int, block_chars: int):
    """Rows (doc_id, side, scored, text) to the parts of their blocks. side: 0 target, 1 background, else not counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        number: defaultdict = defaultdict(itertools.count().__next__)
        number[""]
        events: list[list] = [[], [], []]
        held: list[tuple] = []
        chars, of = 0, None

        def rows(out: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["dest", "block", "kind", "doc_id", "payload"])

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal block, number, events, chars
            codes = [np.concatenate(e) if e else np.zeros(0, np.int64) for e in events]
            distinct, at = np.unique(np.concatenate(codes), return_inverse=True)
            hashes = _hashes(list(number))
            keys, order = _keys(distinct, hashes)
            ends = np.cumsum([len(c) for c in codes])
            counts = []
            for k in (0, 1):
                own = at[ends[k] - len(codes[k]) : ends[k]]
                counts.append(np.concatenate([np.bincount(own, minlength=len(distinct)), np.bincount(codes[k] >> 32, minlength=len(hashes))])[order])
            keys = keys[order]
            owner = ((keys >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), len(keys)]
            out = [(block, block, WORDS, None, pack(pack_numbers(hashes)))] if of else []
            for i, j in itertools.pairwise(cuts):
                question = pack(pack_numbers(np.diff(keys[i:j], prepend=np.uint64(0))), *(pack_numbers(c[i:j]) for c in counts))
                out.append((-2 - int(owner[i]), block, QUESTION if of else COUNTS, None, question))
            yield rows(out)
            block, chars, number, events = block + 1, 0, defaultdict(itertools.count().__next__), [[], [], []]
            number[""]

        for batch in batches:
            for doc_id, side, scored, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if of is not None and scored != of and any(events):
                    if held:
                        yield rows(held)
                        held = []
                    yield from finish()
                of, found, known = scored, words(text.as_py()), len(number)
                sequence = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
                events[side if side in (0, 1) else 2].append(_codes(sequence))
                if scored:
                    held.append((block, block, DOCUMENT, doc_id, pack_sequence(sequence, known)))
                chars += len(text.as_py() or "")
                if chars >= block_chars:
                    if held:
                        yield rows(held)
                        held = []
                    yield from finish()
            if held:
                yield rows(held)
                held = []
        if any(events):
            yield from finish()

    return run


def _answer(parts: pa.Table) -> pa.Table:
    """An owner's answers to its questions: the counts of each key in both corpora, added up over all blocks."""
    parts = parts.filter(pa.array(parts["kind"].to_numpy() >= QUESTION))
    out = []
    if parts.num_rows:
        asked = [[unpack_numbers(x) for x in unpack(p.as_py())] for p in parts["payload"]]
        keys = [np.cumsum(a[0], dtype=np.uint64) for a in asked]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        totals = [np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)]
        begin = 0
        for own, *counts in asked:
            for total, c in zip(totals, counts):
                np.add.at(total, at[begin : begin + len(own)], c.astype(np.int64))
            begin += len(own)
        begin = 0
        for block, kind, own, dest in zip(parts["block"].to_pylist(), parts["kind"].to_pylist(), keys, parts["dest"].to_pylist()):
            if kind == QUESTION:
                here = at[begin : begin + len(own)]
                out.append((block, -2 - dest, pack(*(pack_numbers(t[here]) for t in totals))))
            begin += len(own)
    return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["dest", "owner", "payload"])


def _losses(events: tuple[int, int], mix: float, added: float):
    """The documents of a block, given its questions' answers, to their events and mean losses."""

    def run(parts: pa.Table, answers: pa.Table) -> pa.Table:
        kind = parts["kind"].to_numpy()
        documents, (*hashes,) = parts.filter(pa.array(kind == DOCUMENT)), parts["payload"].filter(pa.array(kind == WORDS))
        lengths, means = np.zeros(0, np.int64), [np.zeros(0), np.zeros(0)]
        if documents.num_rows:
            hashes = unpack_numbers(unpack(hashes[0].as_py())[0])
            codes = [_codes(unpack_sequence(p.as_py())) for p in documents["payload"]]
            lengths = np.array([len(c) for c in codes], np.int64)
            distinct, at = np.unique(np.concatenate(codes), return_inverse=True)
            _, order = _keys(distinct, hashes)
            told = [[unpack_numbers(x) for x in unpack(p.as_py())] for p in answers.sort_by("owner")["payload"]]
            starts = np.cumsum(lengths) - lengths
            for k in (0, 1):
                totals = np.zeros(len(order))
                totals[order] = np.concatenate([t[k] for t in told])
                pairs, single = totals[: len(distinct)], totals[len(distinct) :]
                share = (single + added) / (events[k] + added * max(1, sum(events)))
                before, after = single[distinct >> 32], share[distinct & 0xFFFFFFFF]
                p = np.where(before > 0, mix * pairs / np.maximum(before, 1) + (1 - mix) * after, after)
                means[k] = np.add.reduceat(-np.log2(p)[at], starts) / lengths
        return pa.table([documents["doc_id"].cast(pa.int64()), pa.array(lengths, pa.int64()), *(pa.array(m, pa.float64()) for m in means)], names=["doc_id", "n_events", "target_bits", "background_bits"])

    return run


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, size = [0, 0], 0
        for side, text in zip(batch.column("side").to_pylist(), batch.column("text")):
            text = text.as_py() or ""
            size += len(text)
            if side in (0, 1):
                n[side] += len(text.split()) + 1
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*n, size)], ["n0", "n1", "size"])


def score(docs: DataFrame, target: DataFrame, background: DataFrame | None = None, mix: float = MIX, added: float = ADDED, block_chars: int | None = None) -> DataFrame:
    """doc_id, n_events, the mean loss in bits under target and background, and score: their difference, of every row of docs.

    background: by default docs themselves, which are then taken apart once. block_chars bounds what a task holds of its texts.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.col("text").cast("string").alias("text")
    counted = lambda df, side: df.select(F.lit(None).cast("long").alias("doc_id"), F.lit(side).alias("side"), F.lit(False).alias("scored"), text)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(1 if background is None else -1).alias("side"), F.lit(True).alias("scored"), text)
    rows = rows.unionByName(counted(target, 0))
    if background is not None:
        rows = rows.unionByName(counted(background, 1))
    sums = rows.select("side", "text").mapInArrow(_sizes, "n0 long, n1 long, size long").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n0", "n1", "size"))).first()
    n = partitions(spark)
    owners = max(n, -(-sums["size"] // OWNED))
    # Owners and blocks read this one exchange; which rows are theirs is told in Python so that it stays the same plan.
    parts = rows.mapInArrow(_take_apart(owners, block_chars or BLOCK), PARTS).repartition(n, "dest")
    answers = parts.groupBy("dest").applyInArrow(_answer, "dest long, owner long, payload binary")
    scored = parts.groupBy("dest").cogroup(answers.groupBy("dest")).applyInArrow(_losses((sums["n0"], sums["n1"]), mix, added), SCORED)
    return scored.withColumn("score", F.col("target_bits") - F.col("background_bits"))
