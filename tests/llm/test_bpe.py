import base64
import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

from tidyspark.llm import bpe

RANKS = P.path("byte_bpe_50k.tiktoken")


def expected(text):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    return enc.encode_ordinary(text or "")


TEXTS = [
    None, "", " ", "\n\n  a", "it's we'll  they'd 'S", "a" * 3000, "<|endoftext|> x", "naïve ¿qué? 漢字かな 🎉🎉 é", "\x1c\x85　tab\t\tend ",
    "12 345 ٣٤ Ⅷ", "the the the " * 500, "the the the " * 500, "é ‍ ­", "''' '''s !'s",
]


def test_ids_and_round_trip(spark):
    rows = [(i, t, "x", None) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", 1), (None, "null id", "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, payload int").repartition(3)
    got = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN, block_chars=2000), RANKS).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        want = expected(texts[r.doc_id])
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert bytes(r.decoded).decode() == (texts[r.doc_id] or "")


def test_digests_on_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = bpe.digests(docs, RANKS, P.PATTERN).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = expected(texts[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_empty_table_and_null_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(docs, RANKS, P.PATTERN).count() == 0
    one = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert bpe.decode(one, RANKS).first().decoded is None
