import random
import re

import pytest

from tidyspark.llm import decontam

NUM = re.compile(r"(?<![^ ])[^\w <]*\d[\d.,:/]*[^ ]*")


def words_of(text):
    """Slots, template, and the template with names."""
    even = " ".join(w for w in (text or "").split() if re.search(r"[^\W_]", w))
    t = re.sub(rf"(?i)(?<=\d )(?:{'|'.join(decontam.UNITS)})(?![^\W_])", "<unit>", even)
    t = NUM.sub("<num>", t)
    t = re.sub(r"[^\w<> ]+|_", "", t.lower()).split(" ") if even else []
    slots = [re.sub(r"^[\W_]+|[\W_]+$", "", w) for w in even.split()]
    return slots, t, ["<name>" if not x.startswith("<") and w[:1].isupper() else x for w, x in zip(slots, t)]


def brute(docs, items, size=5, coverage=0.8):
    out = set()
    for d, dt in docs:
        dw, dtm, dnm = words_of(dt)
        for i, it in items:
            if d is None or i is None:
                continue
            iw, itm, inm = words_of(it)
            if len(itm) < 2:
                continue
            k = min(size, len(itm))
            total, lies = len(itm) - k + 1, {}
            for a in range(total):
                fixed = any(not x.startswith("<") and not y.startswith("<") for x, y in zip(inm[a : a + k], inm[a + 1 : a + k]))
                for b in range(len(dtm) - k + 1):
                    form = itm if itm[a : a + k] == dtm[b : b + k] else inm if fixed and inm[a : a + k] == dnm[b : b + k] else None
                    if form:
                        nos, pairs = lies.setdefault(b - a, (set(), set()))
                        nos.add(a)
                        pairs |= {(x, y) for x, y, t in zip(iw[a : a + k], dw[b : b + k], form[a : a + k]) if t.startswith("<")}
            good = [nos for nos, pairs in lies.values() if len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs})]
            found = set().union(*good)
            if len(found) / total >= coverage:
                out.add((d, i, total, len(found)))
    return out


ITEMS = [(1, "Tom gave 12 apples to Mary and 12 pears to Ann, who ran 5 km in 30 minutes."), (2, "Short one here."), (3, None), (None, "what is this thing"), (4, ""), (5, "The quick brown fox jumps over the lazy dog near the river bank.")]
DOCS = [
    (10, "We ask: Tom gave 7 apples to Lucy and 7 pears to Eve, who ran 9 km in 44 minutes. Good."),
    (11, "Tom gave 7 apples to Lucy and 8 pears to Eve, who ran 9 km in 44 minutes."),
    (12, "Nothing to see."), (13, None), (14, ""), (None, ITEMS[5][1]), (15, "x the  quick\nbrown fox -- jumps over the lazy dog near the river bank and so on"),
    (15, "repeated id"), (16, "He said short one here today"), (17, "the quick brown fox sat on the lazy dog near the river"),
]


@pytest.mark.parametrize("few", [200_000, 0])
def test_equals_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(decontam, "FEW", few)
    rng = random.Random(4)
    vocab = "alpha Beta gamma, 3 4.5 km Delta epsilon zeta eta. theta 12% iota".split()
    items = ITEMS + [(100 + i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 14)))) for i in range(12)]
    docs = DOCS + [(200 + i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))) for i in range(40)]
    docs += [(300 + i, f"so {t} and on") for i, (_, t) in enumerate(items) if t]
    d = spark.createDataFrame([(a, b, "c") for a, b in docs], "doc_id long, text string, anchor string").repartition(3)
    b = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, hash int")
    got = decontam.matches(d, b)
    assert {(r.doc_id, r.item_id, r.n_windows, r.n_found) for r in got.collect()} == brute(docs, items)
    found = {r.doc_id: r.changed for r in got.where("item_id = 1").collect()}
    assert found[10] is True and 11 not in found


def test_names_at_the_start_of_sentences(spark):
    """A question with a name changed throughout, in every position, is the same question; with names that don't agree it isn't."""
    ask = "{0} has 3 apples in a basket. {0} eats 2 of them at noon. {1} buys 5 more apples for {0}. How many apples does {0} have?"
    long_text = " ".join(f"filler{i} words" for i in range(20_000))
    docs = [(1, ask.format("Lucy", "Lucy")), (2, f"{long_text} {ask.format('Tom', 'Tom')}"), (3, ask.format("Tom", "Tom").lower()), (4, long_text), (5, ask.format("Ann", "Bob").replace("Ann eats", "Eve eats"))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, ask.format("Tom", "Tom"))], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_windows, r.n_found) for r in decontam.matches(d, b).collect()}
    assert got == brute(docs, [(9, ask.format("Tom", "Tom"))]) and {g[0] for g in got} == {1, 2, 3}


@pytest.mark.parametrize("few", [200_000, 0])
def test_many_hits_in_a_long_text(spark, monkeypatch, few):
    """What is looked up at a hit does not carry the text: 12,000 hits in a text of 2 MB fit in memory, and pieces lose no window on their borders."""
    monkeypatch.setattr(decontam, "FEW", few)
    question = "Many apples does Tom have left in the basket"
    docs = [(1, " ".join(f"{'x ' * (i % 7)}apples does{i % 3 or ''} not matter at all here, " for i in range(18_000)) + question.replace("Tom", "Lucy")), (2, "apples does " * 20_000)]
    docs += [(10 + i, "word " * i + question) for i in range(decontam.PIECE - 12, decontam.PIECE + 4)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, question)], "item_id long, text string")
    got = {(r.doc_id, r.n_windows, r.n_found, r.changed) for r in decontam.matches(d, b).collect()}
    assert got == {(1, 5, 5, True)} | {(doc_id, 5, 5, False) for doc_id, _ in docs[2:]}


def test_clean_keeps_the_rest(spark):
    d, b = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontam.clean(d, b)
    assert kept.columns == ["doc_id", "text"]
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 11, 12, 13, 14, 17]
    assert decontam.matches(d.limit(0), b).count() == 0 and decontam.matches(d, b.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    d, b = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    plan = decontam.matches(d, b)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
