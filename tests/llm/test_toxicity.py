import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidyspark.llm import toxicity


def corpus(n=400):
    rng = random.Random(5)
    words = [w1 + w2 for w1 in "ba ke lo mi ru sta vor pel".split() for w2 in "ren tal ing mos der vid".split()]
    rows = []
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        toxic = int(i % 4 == 1 or i % 8 == 2)
        for _ in range(3 * toxic):
            body.insert(rng.randrange(len(body)), rng.choice(["gloffish", "zzkrank", "snurfy"]))
        rows.append((i, " ".join(body), toxic))
    return rows


def test_held_out_accuracy_and_columns(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, y) for i, _, y in rows] + [(None, 1, 0), (3, None, None)], "doc_id long, toxic int, text int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert len(got) == len(rows)
    for i, _, _ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1
        assert got[i].predicted == int(got[i].score >= 0.3)
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert np.mean([p == y for p, y in held]) > 0.95


def test_long_text_is_read_to_its_end(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    clean = " ".join(t for _, t, y in rows if not y)
    scorer = toxicity.Scorer(model)
    assert scorer.score(clean + " gloffish zzkrank snurfy gloffish") > scorer.score(clean)
    kept = toxicity.reject(docs, model)
    assert kept.columns == ["doc_id", "text"] and 0 < kept.count() < len(rows)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, none)).collect()
    assert len(got) == 4 and all(r.score == 0 and r.predicted == 0 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    empty = docs.where(F.lit(False))
    assert toxicity.score(empty, toxicity.train(empty, none)).count() == 0


def test_windows_cover_the_text():
    for n in (0, 1, 50, 96, 97, 168, 1000):
        text = "".join(chr(97 + i % 26) for i in range(n))
        found = toxicity.windows(text)
        covered = set()
        for k, w in enumerate(found):
            covered |= set(range(k * toxicity.STEP, k * toxicity.STEP + len(w)))
        assert covered == set(range(n))


def test_score_equals_its_definition(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    magic, at = b"\x37\xa4\x30\xec", 1024
    content = model.toxic[at:] if model.toxic.startswith(magic) else model.toxic
    both = model.ordinary[:at] + content + model.ordinary[at:] if model.ordinary.startswith(magic) else content + model.ordinary
    size = lambda d, w: len(toxicity._compressor(d)(w))
    for _, text, _ in rows[:6]:
        data = text.encode()
        parts = [data[i : i + 64] for i in range(0, len(data), 48) if i == 0 or i < len(data) - 16]
        saved = sorted([size(model.ordinary, w) - size(both, w) for w in parts])[::-1]
        strong = len([x for x in saved if x > model.strong])
        features = [saved[0], sum(saved[:3]) / 3, sum(saved) / len(saved), np.log(1 + strong), strong / len(saved), np.log(1 + len(saved))]
        z = sum(a * b for a, b in zip(features, model.weights)) + model.weights[-1]
        assert abs(toxicity.Scorer(model).score(text) - 1 / (1 + np.exp(-z))) < 1e-9


def test_held_out_labels_of_the_tables(spark):
    """On the tables' own labels, of which a tenth or so is noise: better than chance by far, on documents never learned from."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, toxicity.train(docs, labels)).where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").toPandas()
    rank = scored.score.rank()
    n1 = int(scored.toxic.sum())
    auc = (rank[scored.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(scored) - n1))
    caught = scored[scored.toxic == 1].predicted.mean()
    right = scored[scored.predicted == 1].toxic.mean()
    print(f"AUC {auc:.3f}, recall {caught:.2f}, precision {right:.2f}")
    assert auc > 0.75 and right > 0.6 and caught > 0.4
