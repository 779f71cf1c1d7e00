import numpy as np
import pytest

from tidyspark.llm import ann


def frame(spark, vectors):
    rows = [(i, v, 0, 1) for i, v in vectors]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node int").repartition(4)


def exact(vectors, every=20, top=20):
    out = {}
    for q, x in vectors:
        if q % every == 0:
            near = sorted((-np.dot(np.array(x, np.float64), np.array(y, np.float64)), i) for i, y in vectors if i != q)
            out[q] = [(i, -s) for s, i in near[:top]]
    return out


@pytest.mark.parametrize("case", ["unit", "norms", "outlier", "parts", "close"])
def test_recall_and_scores(spark, monkeypatch, case):
    monkeypatch.setattr(ann, "LEAF", 100)
    monkeypatch.setattr(ann, "BLOCK", 300)
    monkeypatch.setattr(ann, "GROUP", 20)
    if case == "parts":
        monkeypatch.setattr(ann, "SAMPLE", 64)  # a tree of four leaves, each dealt on
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 16)) * (rng.uniform(0.1, 2, (1500, 1)) if case == "norms" else 1)
    if case != "norms":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    if case == "outlier":
        x[77] *= 1e4
    if case == "close":
        x = np.array([1.0, *[0.0] * 15]) + 1e-4 * x
    x = x.astype(np.float32)
    x[100:160] = x[100]
    vectors = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {}
    for r in sorted(ann.nearest(frame(spark, vectors)).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
        assert r.score == pytest.approx(float(np.dot(x[r.query_id].astype(float), x[r.vec_id].astype(float))), rel=1e-12)
    want = exact(vectors)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert all(a[1] >= b[1] and (a[1] > b[1] or a[0] < b[0]) for v in got.values() for a, b in zip(v, v[1:]))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9


def test_edge_cases(spark):
    good = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (20, [0.0, -1.0])]
    bad = [(3, None), (4, [0.0, 0.0]), (5, [1.0, float("nan")]), (6, [1.0, None]), (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (40, []), (60, [1.0])]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.nearest(frame(spark, good + good[:1] + bad)).collect()}
    assert got == {(0, 1): (1, 0.5), (0, 2): (2, 0.5), (0, 3): (20, 0.0), (20, 1): (0, 0.0), (20, 2): (1, -0.5), (20, 3): (2, -0.5)}
    assert ann.nearest(frame(spark, good[:1])).count() == 0
    assert ann.nearest(frame(spark, good).limit(0)).count() == 0


def test_lengths_and_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [1.0, 1.0, 1.0]), (21, [0.0, 2.0, 0.0]), (22, [1.0, 0.0, 0.0]), (1, [0.25, 0.5])]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.nearest(frame(spark, rows)).collect()}
    assert got == {(0, 1): (1, 0.25), (20, 1): (21, 2.0), (20, 2): (22, 1.0)}


def test_search_goes_on_to_the_end(spark):
    """Nodes along half a circle, each linked to the next: a query at one end is entered at the other."""
    n = 9
    vec = [[float(np.cos(a)), float(np.sin(a))] for a in np.linspace(np.pi, 0, n)]
    raw = lambda x: np.array(x, np.float32).tobytes()
    nodes = spark.createDataFrame([(i, raw([*v, 0]), min(i, 1)) for i, v in enumerate(vec)], "node long, x binary, place long")
    links = spark.createDataFrame([(i, [i + 1] if i + 1 < n else []) for i in range(n)], "u long, list array<long>")
    queries = spark.createDataFrame([(0, 100, raw(vec[-1]), None, 0)], "g long, q long, qx binary, own long, place long")
    found = ann.search(nodes, links, queries, 2, beam=3, width=1, starts=1).collect()
    assert {n - 1, n - 2} <= {r.node for r in found}


def test_beams_grow():
    assert ann.beam_for(1) == 64 < ann.beam_for(10_000) < ann.beam_for(10**9)
