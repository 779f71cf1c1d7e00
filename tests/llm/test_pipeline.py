import hashlib
import sys
from pathlib import Path

import public_tokenizers as P
import tiktoken

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline
import test_decontam
import test_minhash
import test_substring_dedup
from tidyspark.llm import bpe, toxicity


def test_run_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [r for r in rows if scorer.score(r[1]) < 0.3]
    kept = {d for d, _, _, k in test_minhash.brute(rows, 5, 80) if k}
    rows = [r for r in rows if r[0] in kept]
    cleaned = test_substring_dedup.brute(rows, ends=True)
    rows = [(d, t) for d, (t, n) in cleaned.items() if not n or t.strip(" ")]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {d for d, *_ in test_decontam.brute(rows, items)}
    want = {d: hashlib.sha256(t.encode()).hexdigest() for d, t in rows if d not in bad}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    n = {d: len(enc.encode_ordinary(t)) for d, t in rows if d not in bad}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id: r.decoded_sha256 for r in got} == want and {r.doc_id: r.n_tokens for r in got} == n
    assert 0 < len(want) < docs.count() and len(got) == len(want)


def test_stages_return_the_columns_of_documents(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
