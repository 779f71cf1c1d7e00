import random
import re

import pytest

from tidyspark.llm import minhash


def shingles(text, width):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    k = min(width, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute(rows, width, percent):
    sets = [(d, shingles(t, width)) for d, t in rows if d is not None]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted((d, len(x), find(d), find(d) == d) for d, x in sets)


def corpus(seed=3, groups=12):
    rng = random.Random(seed)
    vocab = [a + b for a in "ka lo mi ru Ta É".split() for b in "ren tal ing mos x yy".split()]
    rows = []
    for g in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 200))]
        for _ in range(rng.choice([1, 2, 3, 25])):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            rows.append(" ".join(own))
    chain = [rng.choice(vocab) for _ in range(100)]
    for i in range(12):
        chain[8 * i % 100] = f"step{i}"
        rows.append(" ".join(chain))
    rows += ["", None, " \t", "one", "one", "ONE two", "one\x0btwo", "x " * 500]
    rng.shuffle(rows)
    return [(1000 - 3 * i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("width", "percent", "block"), [(3, 85, 4096), (3, 85, 4), (5, 80, 4096)])
def test_equals_brute_force(spark, monkeypatch, width, percent, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 1, "c") for d, t in rows], "doc_id long, text string, n int, component string").repartition(5)
    got = sorted(tuple(r) for r in minhash.near_duplicates(docs, width, percent).collect())
    assert got == brute(rows, width, percent)


def test_edge_cases(spark):
    rows = [(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in minhash.near_duplicates(docs, 3, 85).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)], key=str)
    assert sorted(r.doc_id or 0 for r in minhash.dedup(docs, 3, 85).collect()) == [0, 1, 1, 3]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_matches():
    assert minhash.least_matches(0.85) == 26 and minhash.least_matches(0.8) == 22
