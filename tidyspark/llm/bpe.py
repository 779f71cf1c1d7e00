"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

A task cuts the texts that it reads into blocks of some 4 million characters and numbers the distinct pre-tokens of each
block, which turns a document into its sequence of word numbers: the pre-tokens with their positions. The distinct words of a
block go to the tasks that own them by hash; an owner encodes each word once, whatever the number of blocks that hold it (it
starts anew after ``KEPT_WORDS`` words, which bounds its memory), and the ids go back to the block, where documents are put
together by position. A word that makes up a third of the corpus sends one entry for each block. Decoding joins
ids with the token-byte table, which is as large as the vocabulary file and is read once by each worker.

Defined results: a null text counts as empty (no ids); every input row gives one output row, so repeated rows and
repeated or null doc_id values are kept as they are; an empty table gives an empty result; other columns of the input
play no part, whatever their names.
"""

from __future__ import annotations

import base64
import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, partitions
from .packing import from_planes, pack, pack_sequence, planes, unpack, unpack_sequence

#: A document of a block (dest: the block, payload: its word numbers), or words of a block for one owner (dest: -1 - owner).
BLOCK = "dest long, block long, doc_id long, payload binary"
ENCODED_WORDS = "dest long, payload binary"
ENCODED = "doc_id long, n_tokens long, ids binary"
#: Rows that are decoded at a time.
DECODED = 64
#: Distinct words whose ids an owner remembers.
KEPT_WORDS = 200_000


def load_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file: token bytes to id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_kept: dict = {}


def _encoder(path: str, pattern: str):
    """The library's encoder, once for each worker."""
    if (path, pattern) not in _kept:
        import tiktoken

        _kept[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
    return _kept[path, pattern]


def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table as one run of bytes, with the start and length of each id."""
    if path not in _kept:
        ranks = load_ranks(path)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        _kept[path] = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths
    return _kept[path]


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """flat[starts[w] : starts[w] + lengths[w]] for each w of which, end to end."""
    n = lengths[which]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts[which] - (ends - n), n) + np.arange(total)]


def _number(pattern: str, owners: int, block_chars: int):
    """Documents to sequences of word numbers; after the documents of a block, its words by owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from pyspark import TaskContext

        find = regex.compile(pattern).findall
        first, seq, chars = TaskContext.get().partitionId() << 32, 0, 0
        number: defaultdict = defaultdict(itertools.count().__next__)

        def rows(dest: list, doc_ids: list, payloads: list) -> pa.RecordBatch:
            columns = [pa.array(dest, pa.int64()), pa.array([first + seq] * len(payloads), pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(payloads, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["dest", "block", "doc_id", "payload"])

        def words() -> pa.RecordBatch:
            dealt = defaultdict(list)
            for word, i in number.items():  # in the order of their numbers
                dealt[zlib.crc32(word := word.encode()) % owners].append((i, word))
            payloads = [pack(planes(np.diff([i for i, _ in own], prepend=0)), planes([len(w) for _, w in own]), b"".join(w for _, w in own)) for own in dealt.values()]
            return rows([-1 - o for o in dealt], [None] * len(dealt), payloads)

        for batch in batches:
            doc_ids, payloads = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                found, known = find(text), len(number)
                payloads.append(pack_sequence(np.fromiter(map(number.__getitem__, found), np.int64, len(found)), known))
                doc_ids.append(doc_id)
                chars += len(text)
                if chars >= block_chars:
                    yield rows([first + seq] * len(doc_ids), doc_ids, payloads)
                    yield words()
                    doc_ids, payloads, chars, seq = [], [], 0, seq + 1
                    number = defaultdict(itertools.count().__next__)
            if doc_ids:
                yield rows([first + seq] * len(doc_ids), doc_ids, payloads)
        if number:
            yield words()

    return run


def _encode_words(path: str, pattern: str):
    """The words of each block to ids. An owner meets all blocks that hold its words and encodes each word once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path, pattern).encode_ordinary
        known: dict[bytes, bytes] = {}
        for batch in batches:
            batch = batch.filter(pa.array(batch.column("dest").to_numpy() < 0))
            payloads = []
            for payload in batch.column("payload"):
                numbers, lengths, flat = unpack(payload.as_py())
                if len(known) > KEPT_WORDS:
                    known.clear()
                ids = []
                for i, j in itertools.pairwise([0, *np.cumsum(from_planes(lengths)).tolist()]):
                    word = flat[i:j]
                    if word not in known:
                        known[word] = np.array(encode(word.decode()), "<u4").tobytes()
                    ids.append(known[word])
                payloads.append(pack(numbers, planes([len(x) // 4 for x in ids]), planes(np.frombuffer(b"".join(ids), "<u4"))))
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(payloads, pa.binary())], ["dest", "payload"])

    return run


def _reassemble(documents: pa.Table, words: pa.Table) -> pa.Table:
    """The documents of one block, from their word numbers and the ids of its words."""
    parts = [[from_planes(x) for x in unpack(p.as_py())] for p in words.column("payload")]
    parts = [(np.cumsum(numbers, dtype=np.int64), own, ids) for numbers, own, ids in parts]
    size = max((int(n.max()) + 1 for n, _, _ in parts if len(n)), default=0)
    starts, lengths, at = np.zeros(size, np.int64), np.zeros(size, np.int64), 0
    for numbers, own, ids in parts:
        lengths[numbers] = own
        starts[numbers] = at + np.cumsum(own, dtype=np.int64) - own
        at += len(ids)
    flat = np.concatenate([ids for _, _, ids in parts]) if parts else np.zeros(0, "<u4")
    doc_ids, counts, encoded = [], [], []
    for dest, doc_id, payload in zip(documents.column("dest").to_pylist(), documents.column("doc_id").to_pylist(), documents.column("payload")):
        if dest >= 0:
            ids = gather(flat, starts, lengths, unpack_sequence(payload.as_py()))
            doc_ids.append(doc_id)
            counts.append(len(ids))
            encoded.append(ids.tobytes())
    return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids": pa.array(encoded, pa.binary())})


def encode(docs: DataFrame, path: str, pattern: str, block_chars: int = 4_000_000) -> DataFrame:
    """doc_id, n_tokens and ids (unsigned 32-bit integers, little-endian) of every document.

    path: a file of token bytes in base64 and ranks, there on every executor; pattern: what splits texts before the
    merges. block_chars bounds the text whose words a task numbers together.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    n = partitions(spark)
    # Both uses below read this exchange; whose rows are whose is told in Python so that its two uses stay the same plan.
    blocks = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_number(pattern, n, block_chars), BLOCK).repartition(n, "dest")
    words = blocks.mapInArrow(_encode_words(path, pattern), ENCODED_WORDS).repartition(n, "dest")
    return blocks.groupBy("dest").cogroup(words.groupBy("dest")).applyInArrow(_reassemble, ENCODED)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """The columns of encoded and ``decoded``: the bytes of its ids, by the token-byte table. Null ids give null."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, starts, lengths = _token_bytes(path)
        for whole in batches:
            for i in range(0, whole.num_rows, DECODED):
                batch = whole.slice(i, DECODED)
                decoded = [None if x is None else gather(flat, starts, lengths, np.frombuffer(x, "<u4")).tobytes() for x in batch.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, ", ".join([*fields, "decoded binary"]))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and of the decoded bytes."""
    return decode(encode(docs, path, pattern), path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
