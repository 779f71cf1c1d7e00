import random

import pytest

from tidyspark.llm import substring_dedup as sd


def cut_sentences(text):
    """Sentences end at . ! ? or an ellipsis before white space, and at line ends before anything else."""
    out, begin = [], 0
    for i in range(1, len(text)):
        if text[i - 1] in ".!?\u2026" and text[i].isspace() or text[i - 1] == "\n" and not text[i].isspace():
            out.append(text[begin:i])
            begin = i
    return [*out, text[begin:]] if text else []


def brute(rows, least=16, ends=False, long=40):
    """Texts after removal, by comparing all runs of all documents."""
    enough = lambda own: sum(map(len, own)) >= least and (sum(map(bool, own)) >= 2 or sum(map(len, own)) >= long)
    found = {}
    for doc_id, text in rows:
        words = [p.lower().split() for p in cut_sentences(text or "")]
        at = set()
        for i in range(len(words)):
            if words[i]:
                at |= {(i, j) for j in [next((j for j in range(i + 1, len(words) + 1) if enough(words[i:j])), 0)] if j}
            if words[i] and ends:
                at |= {(k, i + 1) for k in [next((k for k in range(i, -1, -1) if enough(words[k : i + 1])), -1)] if k >= 0}
        for i, j in at:
            found.setdefault(tuple(w for ws in words[i:j] for w in ws), set()).add((doc_id, i, j))
    gone = {}
    for places in found.values():
        first = min(places)[:2]
        for doc_id, i, j in places:
            if (doc_id, i) != first:
                gone.setdefault(doc_id, set()).update(range(i, j))
    out = {}
    for doc_id, text in rows:
        own = gone.get(doc_id, set())
        out[doc_id] = ("".join(p for i, p in enumerate(cut_sentences(text)) if i not in own).lstrip() if own else text, len(own))
    return out


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocab = [a + b for a in "ka lo mi ru".split() for b in "ren tal ing mos".split()]
    sentence = lambda: " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 12))) + rng.choice([".", "!", "?\n", ".\n"])
    passages = [" ".join(sentence() for _ in range(8)) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [sentence() for _ in range(rng.randint(0, 15))]
        if i % 3 == 0:
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages))
        rows.append((i, " ".join(parts)))
    rows += [(100, rows[5][1]), (101, rows[5][1]), (102, None), (103, ""), (104, "one short."), (105, passages[0] + " " + passages[0])]
    return rows


@pytest.mark.parametrize("ends", [False, True])
def test_equals_brute_force(spark, ends):
    long_text = " ".join(f"word{i % 97} and word{i % 89} stand here." for i in range(20_000))
    rows = [*corpus(), (200, long_text), (201, f"Another beginning of it. {long_text}")]
    docs = spark.createDataFrame([(i, t, i, "r") for i, t in rows], "doc_id long, text string, n int, row string").repartition(4)
    want = brute(rows, ends=ends)
    got = sd.clean(docs, ends=ends).select("row.doc_id", "row.row", "text", "n_removed").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.text, r.n_removed) == want[r.doc_id]
    assert sum(n for _, n in want.values()) > 50


def test_columns_and_ties(spark):
    text = " ".join(f"Sentence number {i} has several words in it." for i in range(10))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, "x. y."), (3, None)], "doc_id long, text string")
    got = sd.dedup(docs).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(1, text), (1, text), (0, "x. y."), (3, "")])
    assert sd.dedup(docs.limit(0)).count() == 0


def test_sentences_are_the_text():
    for _, text in corpus(2):
        assert "".join(sd.sentences(text or "")) == (text or "")


def test_passages_go_to_their_last_sentence(spark):
    """Sentences behind the last run that starts in a passage belong to it as well."""
    sentence = lambda mark, n: " ".join(f"{mark}{i}" for i in range(n)) + "."
    rows = []
    for p, lengths in enumerate([(20, 10, 5), (45, 30), (12, 9, 8, 3, 1)]):
        passage = " ".join(sentence(f"p{p}s{k}w", n) for k, n in enumerate(lengths))
        rows += [(10 * p + d, f"{sentence(f'a{p}d{d}w', 20)} {passage} {sentence(f'b{p}d{d}w', 20)}") for d in range(3)]
    got = {r.doc_id: r.text for r in sd.clean(spark.createDataFrame(rows, "doc_id long, text string"), ends=True).select("row.doc_id", "text").collect()}
    for i, text in rows:
        assert got[i] == (text if i % 10 == 0 else " ".join([sentence(f"a{i // 10}d{i % 10}w", 20), sentence(f"b{i // 10}d{i % 10}w", 20)]))
