import hashlib
import random

import numpy as np
import pytest

from tidyspark.llm import suffix


def brute(rows, length=100):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        spans = sum(1 for i in range(len(data)) if gone[i] and not (i and gone[i - 1]))
        out.append((doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [a + b for a in "ka lo mi ru é".split() for b in "ren tal ing mos".split()]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = [text(30) for _ in range(4)]
    texts = []
    for i in range(60):
        parts = [text(rng.randint(0, 60)) for _ in range(3)]
        if i % 3 == 0:
            at = rng.randint(0, 60)
            parts.insert(1, rng.choice(shared)[at : at + rng.randint(90, 200)])
        texts.append(" ".join(parts))
    for t in texts[:10]:
        words = t.split()
        words[len(words) // 2 : len(words) // 2 + 1] = ["edited"]
        texts.append(" ".join(words))
    texts += [texts[3], None, "", "a" * 400, "ab" * 300, "x" + "a" * 150 + "y", shared[0] * 3, "\0" * 250, "short"]
    rng.shuffle(texts)
    return [(5 * i - 7, t) for i, t in enumerate(texts)] + [(None, texts[0])]


@pytest.mark.parametrize("piece", [1 << 19, 64])
def test_equals_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(suffix, "PIECE", piece)
    monkeypatch.setattr(suffix, "SHARD", 4000)
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, h int, own string").repartition(4)
    got = sorted((tuple(r) for r in suffix.dedup_digest(docs).collect()), key=str)
    want = brute(rows)
    assert got == want and sum(r[2] for r in want) > 3000


def test_edge_cases(spark):
    """Each row counts, whatever ids repeat: (1, a) twice is one document and two rows, (1, b) is another."""
    docs = spark.createDataFrame([(1, "b" * 120), (1, "a" * 120), (1, "a" * 120), (2, "a" * 120), (None, None), (None, "c" * 120)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix.dedup_digest(docs).collect()), key=str)
    assert got == sorted([(1, 120, 119, 1)] * 3 + [(2, 120, 120, 1), (None, 0, 0, 0), (None, 120, 119, 1)], key=str)
    assert suffix.dedup_digest(docs.limit(0)).count() == 0


def test_classes_are_equal_for_equal_strings():
    rng = np.random.default_rng(4)
    text = rng.integers(97, 99, 3000).astype(np.uint8)
    for length in (32, 100):
        text[700:900] = text[100:300]
        at = np.arange(len(text) - length + 1)
        found = suffix._classes(text, at, length)
        want = [bytes(text[i : i + length]) for i in at]
        assert len(set(found.tolist())) == len(set(want)) == len(set(zip(found.tolist(), want)))
