"""Exact token counts under the tokenizer of a vocabulary file, with huge texts spliced from overlapping chunks.

Byte-level BPE files (``.json`` whose pre-tokenizer is the byte-level one, without normalizer) have two fast paths. Texts
up to ``chunk`` characters are split into pre-tokens, and each distinct pre-token of a task is encoded by the library once.
Longer texts are encoded by the library as overlapping chunks with offsets, which bounds the memory of an encoding. Two
neighbours are spliced at a pre-token boundary that both have, far enough from the end of the left one. This is proven to
be what the whole text gives: the splitting pattern runs from left to right and looks at most one character ahead, so
two runs that meet at one boundary agree from there on, and the left run is right up to its last few characters by
induction. Where the overlap holds no common boundary, as inside a run without spaces, it is doubled until it does or
the text ends. Any other vocabulary file counts whole texts by its library.

Special strings inside texts count as the library's default has it; no token is added, nothing is cut or padded.

Defined results: a null text counts as empty (0 bytes, 0 tokens); every input row gives one output row; an empty table
gives an empty result; other columns of the input play no part.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

COUNTED = "doc_id long, n_bytes long, n_tokens long"
#: How byte-level BPE splits text before the merges. Fixed value: it must equal the library's.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pre-tokens that a worker keeps; beyond it, it starts anew. Counts don't depend on it.
KEPT_WORDS = 1_000_000


class Counter:
    """Counts the tokens of texts under one vocabulary file."""

    def __init__(self, path: str, chunk: int = 32_768, overlap: int = 256):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        self.chunk, self.overlap, self.known = chunk, overlap, {}
        if path.endswith(".model"):
            import sentencepiece

            encode = sentencepiece.SentencePieceProcessor(model_file=path).encode
            self.count: Callable[[str], int] = lambda text: len(encode(text, num_threads=1)) if text else 0
            return
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        byte_level = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        plain = not spec.get("normalizer") and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", []))
        if not (byte_level and plain):
            self.count = lambda text: len(self.tokenizer.encode(text, add_special_tokens=False))
            return
        import regex

        self.find = regex.compile(BYTE_LEVEL).findall
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        #: Characters at the end of a chunk that may read otherwise when more text follows: a special string, or one to look ahead.
        self.guard = max(map(len, added), default=0) + 2
        self.count = self._count_byte_level

    def _count_byte_level(self, text: str) -> int:
        if len(text) > self.chunk:
            return self._spliced(text)
        if self.special(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False))
        words, known = self.find(text), self.known
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            if len(known) > KEPT_WORDS:
                known.clear()
            new = list({w for w in words if w not in known})
            known.update(zip(new, map(len, self.tokenizer.encode_batch_fast(new, add_special_tokens=False))))
            return sum(map(known.__getitem__, words))

    def _boundaries(self, text: str, start: int, end: int) -> tuple[dict[int, int], int]:
        """Of text[start:end]: the tokens before each pre-token boundary, by its place in text; all tokens."""
        encoding = self.tokenizer.encode(text[start:end], add_special_tokens=False)
        words, offsets = encoding.word_ids, encoding.offsets
        found = {start + offsets[i][0]: i for i in range(1, len(words)) if words[i] != words[i - 1]}
        return found | {start: 0}, len(words)

    def _spliced(self, text: str) -> int:
        n, total = len(text), 0
        start, base, end = 0, 0, min(n, self.chunk + self.overlap)  # the left chunk, and the tokens of it that are counted
        left, size = self._boundaries(text, start, end)
        while end < n:
            overlap = self.overlap
            right_start = max(start + 1, end - overlap)
            while True:
                right_end = min(n, right_start + self.chunk + overlap)
                right, right_size = self._boundaries(text, right_start, right_end)
                common = [p for p in left if right_start < p <= end - self.guard and p in right and left[p] >= base]
                if common:
                    at = max(common)
                    total += left[at] - base
                    start, end, left, size, base = right_start, right_end, right, right_size, right[at]
                    break
                overlap *= 2  # widen: the left chunk reads on over more of the text
                end = min(n, end + overlap)
                left, size = self._boundaries(text, start, end)
                if end == n:
                    return total + size - base
        return total + size - base


def count_tokens(docs: DataFrame, path: str, limit: int = 512, chunk: int = 32_768, overlap: int = 256) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of every document.

    path: a vocabulary file, there on every executor. chunk and overlap, in characters, bound what the library encodes
    at once; they don't change a count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, chunk, overlap)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            sizes, counts = [len(x.encode()) for x in texts], [counter.count(x) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    bounded_batches(docs.sparkSession)
    counted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, COUNTED)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
