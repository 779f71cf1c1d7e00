import math
import random
from collections import Counter

import pytest

from tidyspark.llm import lm_score


def corpus(seed, n, words):
    rng = random.Random(seed)
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(n)]


TARGET = corpus(1, 50, "red green blue blue blue sky".split())
GENERAL = corpus(2, 300, "red green stone iron iron rust blue".split()) + [None, ""]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, side string")


def brute(texts, target=None, general=None):
    """Losses by the definition, in plain Python."""
    seqs = [[["<e>", *(t or "").lower().split(), "<e>"] for t in side] for side in (target or TARGET, general or GENERAL)]
    uni = [Counter(w for s in side for w in s[1:]) for side in seqs]
    two = [Counter(p for s in side for p in zip(s, s[1:])) for side in seqs]
    events = [sum(u.values()) for u in uni]
    out = []
    for t in texts:
        s = ["<e>", *(t or "").lower().split(), "<e>"]
        bits = [0.0, 0.0]
        for k in (0, 1):
            for a, b in zip(s, s[1:]):
                p = (uni[k][b] + lm_score.ADDED) / (events[k] + lm_score.ADDED * sum(events))
                if uni[k][a]:
                    p = lm_score.MIX * two[k][a, b] / uni[k][a] + (1 - lm_score.MIX) * p
                bits[k] -= math.log2(p)
        out.append((len(s) - 1, bits[0] / (len(s) - 1), bits[1] / (len(s) - 1)))
    return out


def check(got, want):
    got = {r.doc_id: r for r in got}
    assert len(got) == len(want)
    for i, (n, a, b) in enumerate(want):
        assert got[i].n_events == n
        assert got[i].target_bits == pytest.approx(a) and got[i].background_bits == pytest.approx(b)
        assert got[i].score == pytest.approx(a - b)
    return got


@pytest.mark.parametrize("block_chars", [None, 200])
def test_equals_brute_force(spark, block_chars):
    texts = GENERAL[-8:] + TARGET[:5] + ["unseen words here", "blue blue sky", "iron rust"]
    got = lm_score.score(frame(spark, texts), frame(spark, TARGET), frame(spark, GENERAL).repartition(3), block_chars=block_chars).collect()
    got = check(got, brute(texts))
    assert got[len(texts) - 2].score < 0 < got[len(texts) - 1].score


def test_background_of_the_documents_themselves(spark):
    got = lm_score.score(frame(spark, GENERAL).repartition(4), frame(spark, TARGET), block_chars=500).collect()
    check(got, brute(GENERAL))


def test_empty_tables(spark):
    none = frame(spark, ["x"]).limit(0)
    assert lm_score.score(none, none).count() == 0
    one = lm_score.score(frame(spark, ["a b", None]), none, none).collect()
    assert len(one) == 2 and all(r.score == 0 and math.isfinite(r.target_bits) for r in one)


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    rows = [(None, "red sky", 1, "a"), (None, "red sky", 1, "a"), (7, "blue", 2, "b"), (7, "iron", 2, "b"), (8, None, 3, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, dest int, payload string")
    got = sorted(((r.doc_id, r.n_events) for r in lm_score.score(docs, frame(spark, TARGET)).collect()), key=str)
    assert got == sorted([(None, 3), (None, 3), (7, 2), (7, 2), (8, 1)], key=str)


def test_long_texts_rare_words_and_pairs(spark):
    """Words and pairs of a corpus of over 200,000 events keep their counts, whatever their share is."""
    rng = random.Random(3)
    bulk = [" ".join(rng.choice("red green stone iron rust blue".split()) for _ in range(150_000)) for _ in range(3)]
    general, target = [*bulk, "seldom seen", "seldom seen"], [*bulk[:2], "rare word", "rare word"]
    texts = ["rare word", "seldom seen", "word rare", "red green", "never met", None, bulk[2]]
    got = lm_score.score(frame(spark, texts), frame(spark, target), frame(spark, general), block_chars=100_000).collect()
    got = check(got, brute(texts, target, general))
    assert got[0].score < got[2].score < 0 < got[1].score
