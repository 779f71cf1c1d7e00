import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tidyspark.llm import token_count

JSON = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(JSON)
    return lambda text: len(t.encode(text, add_special_tokens=False))


def messy(rng, n):
    bits = ["word", " ", "  ", "\n", "<|endoftext|>", "<|endof", "text|>", "'s", "'", "12", "é", "漢", "🎉", "a" * 40, " " * 30, "!?", "\t", " ", "́"]
    return "".join(rng.choice(bits) for _ in range(n))


def test_splices_equal_the_library(library):
    rng = random.Random(3)
    counter = token_count.Counter(JSON, chunk=64, overlap=16)
    for k in range(300):
        text = messy(rng, rng.randint(0, 120))
        assert counter.count(text) == library(text), text
    for text in ("a" * 5000, " " * 3000 + "x", "<|endoftext|>" * 200, "ab" * 400 + " the end" * 50, "é" * 999):
        assert counter.count(text) == library(text)


def test_table_and_edge_cases(spark, library):
    rows = [(1, None), (2, ""), (None, "hi there"), (3, "<|endoftext|>"), (3, "<|endoftext|>"), (4, "word " * 20000), (5, "x" * 40000)]
    docs = spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id long, text string, n_tokens int")
    got = sorted((tuple(r) for r in token_count.count_tokens(docs, JSON).collect()), key=str)
    want = sorted(((a, len((b or "").encode()), library(b or ""), library(b or "") > 512) for a, b in rows), key=str)
    assert got == want
    assert token_count.count_tokens(docs.limit(0), JSON).count() == 0


def test_whole_small_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in token_count.count_tokens(docs, JSON, chunk=2000).collect():
        assert r.n_tokens == library(texts[r.doc_id])


def test_other_libraries():
    assert token_count.Counter(P.path("piece_bpe_32k.model")).count("Hello there") > 1
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert token_count.Counter(P.path("word_bpe_49k.json")).count("Hello there " * 9) == len(t.encode("Hello there " * 9, add_special_tokens=False))
