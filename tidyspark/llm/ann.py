"""Approximate nearest neighbours by inner product: an NN-descent graph built with joins, and greedy search on it.

Vectors that are equal are one node, so copies cannot fill each other's lists. Nodes of one vector length whose norms lie within a factor of
four are a band; every band has a graph of its own, in which norms are evened out by one more component (the usual
reduction of inner products to distances). A query searches every band of its length, so an outlying norm neither
spoils the graph nor its precision. Scores of the result are of the original vectors, in double precision.

Building: two trees of hyperplanes, fitted on a bounded sample, and a random dealing put the nodes into leaves; the first lists are
each node's nearest in its three leaves. Where the sample bounds a tree, its leaves are dealt on at random, by a hash of each tree's own, so
that no part of the graph stays apart. Then, iteration by iteration, the nodes on each other's lists (both ways, hubs held to
their nearest) are introduced to one another: neighbours of neighbours that are nearer than the last of a list enter it, until hardly
any edge is new. Lists only get better, so this ends. Lists and vectors live in blocks of about ``BLOCK`` nodes, one row each; an
iteration is a chain of four joins between blocks: reverse edges to the blocks they end in, requests for vectors, vectors, and
what was found. A vector travels once to every block that needs it, not once for each pair.

Searching: queries that lie near each other form groups. A query starts at nodes of its leaf, and at its own node where it is in the table.
In each round the best nodes of the beams that were not expanded are, by a join with the graph; nodes that are new to the group are fetched by
a join, scored for its queries, and the best stay, until every node of every beam was expanded. A node that left a
beam is worse than all that stay, so this ends. Beams grow with the logarithm of the table.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do null
ids; vectors of different lengths don't meet; of rows that repeat an id the least vector counts; ties go to smaller ids; a query
alone in its table has no row; an empty table gives an empty result; other columns play no part. Norms under a billionth of the largest share a band.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, scratch, temporary

#: Nodes of a leaf, at most, and of a block, about; vectors on which a tree is fitted; queries of a group; bands at most.
LEAF, BLOCK, SAMPLE, GROUP, BANDS = 1024, 2048, 16_384, 384, 16
PARCEL = "dest long, payload binary"
STATE = "block long, edges long, fresh long, payload binary"


def valid(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and vec (array of double) of the rows that take part."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")).where("id is not null and size(vec) > 0")
    rows = rows.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("vec").alias("vec"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _floats(column) -> np.ndarray:
    """Vectors kept as bytes of 32-bit floats."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.float32)


def _parcels(dest: np.ndarray, *columns: np.ndarray) -> list[tuple[int, bytes]]:
    """The rows of columns, put together by destination."""
    by = np.argsort(dest, kind="stable")
    cuts = np.flatnonzero(np.diff(dest[by])) + 1
    return [(int(dest[own[0]]), pickle.dumps(tuple(c[own] for c in columns), 5)) for own in np.split(by, cuts) if len(own)]


def _sent(parcels: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"dest": pa.array([d for d, _ in parcels], pa.int64()), "payload": pa.array([p for _, p in parcels], pa.binary())})


def _received(table: pa.Table, like: tuple) -> list[np.ndarray]:
    """The columns of all parcels, end to end; like: the kinds of the columns."""
    parts = [pickle.loads(p.as_py()) for p in table["payload"]]
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, kind) for kind in like]


def fit_tree(sample: np.ndarray, depth: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Normals and thresholds of a complete tree: node i has the children 2 i + 1 and 2 i + 2; medians of the sample split it."""
    rng, size = np.random.default_rng(seed), 2**depth - 1
    normals, cuts = np.zeros((size, sample.shape[1] if sample.size else 1), np.float32), np.zeros(size, np.float32)
    members = {0: np.arange(len(sample))}
    for i in range(size):
        own = members.pop(i)
        a, b = sample[rng.choice(own, 2)] if len(own) > 1 else rng.standard_normal((2, normals.shape[1]))
        normals[i] = a - b if np.any(a != b) else rng.standard_normal(normals.shape[1])
        side = sample[own] @ normals[i] if len(own) else np.zeros(0)
        cuts[i] = np.median(side) if len(own) else 0
        members[2 * i + 1], members[2 * i + 2] = own[side <= cuts[i]], own[side > cuts[i]]
    return normals, cuts


def leaves(x: np.ndarray, normals: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The leaf of each row of x, numbered from 0."""
    at = np.zeros(len(x), np.int64)
    while len(cuts) and at.min(initial=len(cuts)) < len(cuts):
        at = 2 * at + 1 + (np.einsum("ij,ij->i", x, normals[at]) > cuts[at])
    return at - len(cuts)


def _crc(ids: list, salt: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(b"%d,%d" % (i, salt)) for i in ids), np.int64, len(ids))


class Bands:
    """The bands of a table: for each (length, band) its size, largest norm and two trees."""

    def __init__(self, classes: DataFrame, leaf: int, block: int, sample: int):
        norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
        sized = classes.withColumns({"length": F.size("vec"), "norm": norm})
        tops = {r["length"]: r["top"] for r in sized.groupBy("length").agg(F.max("norm").alias("top")).collect()}
        self.tops, self.of = tops, {}
        for r in self.with_band(sized).groupBy("length", "band").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top")).orderBy("length", "band").collect():
            n, top = r["n"], r["top"]
            size = min(leaf, max(64, n // 16))
            depth = max(0, min(math.ceil(math.log2(max(1, n / size))), int(math.log2(sample)) - 4))
            rows = self.with_band(sized).where((F.col("length") == r["length"]) & (F.col("band") == r["band"])).orderBy(F.xxhash64("node")).limit(sample).select("vec").toArrow()
            x = self.augmented(_matrix(rows["vec"]), top)
            parts = max(1, -(-n // (size * 2**depth)))  # where the sample bounds the tree, leaves are dealt on
            self.of[r["length"], r["band"]] = {"no": len(self.of), "n": n, "top": top, "depth": depth, "parts": parts, "trees": [fit_tree(x, depth, seed) for seed in (5, 6)], "leaf": size, "blocks": max(1, n // block)}

    def with_band(self, sized: DataFrame) -> DataFrame:
        top = F.lit(0.0)
        for length, value in self.tops.items():
            top = F.when(F.col("length") == length, F.lit(value)).otherwise(top)
        return sized.withColumn("band", F.least(F.floor(F.log2(top / F.col("norm")) / 2), F.lit(BANDS - 1)).cast("int"))

    @staticmethod
    def augmented(x: np.ndarray, top: float) -> np.ndarray:
        x = x / top
        return np.c_[x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))].astype(np.float32)

    def dealt(self, band: dict, ids: list, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Block, place (leaf of the first tree), and the three leaves of each node."""
        base, parts = band["no"] << 40, band["parts"]
        at = [leaves(x, *tree) for tree in band["trees"]]
        first, second = (base + a * parts + _crc(ids, salt) % parts for salt, a in enumerate(at))
        third = base + _crc(ids, 2) % max(1, band["n"] // band["leaf"])
        spread = at[0] * parts + _crc(ids, 0) % parts
        return base + spread * band["blocks"] // (2 ** band["depth"] * parts), base + at[0], first, second, third


def _nodes(classes: DataFrame, bands: Bands) -> DataFrame:
    """node, x (augmented, 32-bit floats), block, place and the leaves t0, t1, t2 of every distinct vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, length, band = (batch.column(c).to_numpy() for c in ("node", "length", "band"))
            for key in sorted(set(zip(length.tolist(), band.tolist()))):
                own = np.flatnonzero((length == key[0]) & (band == key[1]))
                of = bands.of[key]
                x = bands.augmented(_matrix(batch.column("vec").take(pa.array(own))), of["top"])
                columns = [ids[own], *bands.dealt(of, ids[own].tolist(), x)]
                arrays = [pa.array(c, pa.int64()) for c in columns]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([v.tobytes() for v in x], pa.binary())], ["node", "block", "place", "t0", "t1", "t2", "x"])

    sized = classes.withColumns({"length": F.size("vec"), "norm": F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))})
    found = bands.with_band(sized).select("node", "vec", "length", "band")
    return cut(found.mapInArrow(run, "node long, block long, place long, t0 long, t1 long, t2 long, x binary"), "nodes")


def _best(u: np.ndarray, v: np.ndarray, s: np.ndarray, k: int, *more: np.ndarray) -> list[np.ndarray]:
    """The k best different v of each u; of equal (u, v) the first by the order given."""
    first = np.lexsort((np.arange(len(u)), v, u))
    keep = first[np.r_[True, (u[first][1:] != u[first][:-1]) | (v[first][1:] != v[first][:-1])]] if len(u) else first
    u, v, s, *more = (x[keep] for x in (u, v, s, *more))
    order = np.lexsort((v, -s, u))
    u, v, s, *more = (x[order] for x in (u, v, s, *more))
    starts = np.flatnonzero(np.r_[True, u[1:] != u[:-1]]) if len(u) else np.zeros(0, np.int64)
    rank = np.arange(len(u)) - np.repeat(starts, np.diff(np.r_[starts, len(u)]))
    return [x[rank < k] for x in (u, v, s, *more)]


def _first_lists(k: int):
    def run(leaf: pa.Table) -> pa.Table:
        ids, block, x = leaf["node"].to_numpy(), leaf["block"].to_numpy(), _floats(leaf["x"])
        out = []
        for i in range(0, len(ids), 512):
            s = x[i : i + 512] @ x.T
            s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
            near = np.argpartition(-s, min(k, len(ids) - 1), axis=1)[:, :k] if len(ids) > 1 else np.zeros((len(s), 0), np.int64)
            got, at = np.take_along_axis(s, near, 1).ravel(), near.ravel()
            u = np.repeat(np.arange(i, i + len(s)), near.shape[1])
            out.append((u[got > -np.inf], at[got > -np.inf], got[got > -np.inf]))
        u, v, s = (np.concatenate(c) for c in zip(*out))
        return _sent(_parcels(block[u], ids[u], ids[v], s, block[v]))

    return run


def _state(block: int, ids: np.ndarray, x: np.ndarray, at: np.ndarray, v: np.ndarray, s: np.ndarray, fresh: np.ndarray, home: np.ndarray) -> pa.Table:
    """One row: a block's nodes and vectors, and its edges from node number ``at`` to v, of block ``home``."""
    payload = pickle.dumps((ids, x, at, v, s, fresh, home), 5)
    return pa.table([pa.array([block], pa.int64()), pa.array([len(v)], pa.int64()), pa.array([int(fresh.sum())], pa.int64()), pa.array([payload], pa.binary())], names=["block", "edges", "fresh", "payload"])


_FOUND = (np.int64, np.int64, np.float32, np.int64)
_NO_STATE = pa.table({"block": pa.array([], pa.int64()), "edges": pa.array([], pa.int64()), "fresh": pa.array([], pa.int64()), "payload": pa.array([], pa.binary())})


def _open(k: int):
    def run(nodes: pa.Table, found: pa.Table) -> pa.Table:
        order = np.argsort(nodes["node"].to_numpy())
        ids, x = nodes["node"].to_numpy()[order], _floats(nodes["x"])[order]
        u, v, s, home = _received(found, _FOUND)
        u, v, s, home = _best(u, v, s, k, home)
        return _state(nodes["block"][0].as_py(), ids, x, np.searchsorted(ids, u), v, s, np.ones(len(u), bool), home)

    return run


def _merge(k: int):
    """A block with what was found for it. Edges that were there aren't fresh any more."""

    def run(state: pa.Table, found: pa.Table) -> pa.Table:
        if not state.num_rows:
            return _NO_STATE
        ids, x, at, v, s, _, home = pickle.loads(state["payload"][0].as_py())
        u2, v2, s2, home2 = _received(found, _FOUND)
        both = np.r_[at, np.searchsorted(ids, u2)], np.r_[v, v2], np.r_[s, s2], k, np.r_[np.zeros(len(v), bool), np.ones(len(v2), bool)], np.r_[home, home2]
        at, v, s, fresh, home = _best(*both)
        return _state(state["block"][0].as_py(), ids, x, at, v, s, fresh, home)

    return run


def _reverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each edge to the block that it ends in."""
    for batch in batches:
        for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
            ids, _, at, v, s, fresh, home = pickle.loads(payload.as_py())
            yield from _sent(_parcels(home, v, ids[at], s, fresh, np.full(len(v), block))).to_batches()


_BACK = (np.int64, np.int64, np.float32, bool, np.int64)


def _around(k: int, state: pa.Table, back: pa.Table) -> tuple[np.ndarray, ...]:
    """Centre (number), neighbour, fresh, and the neighbour's block: a block's edges both ways, of those that end in a hub its nearest."""
    ids, _, at, v, s, fresh, home = pickle.loads(state["payload"][0].as_py())
    c, u, sb, fb, ub = _received(back, _BACK)
    c, u, sb, fb, ub = _best(np.searchsorted(ids, c), u, sb, k, fb, ub)
    c, u, f, h = np.r_[at, c], np.r_[v, u], np.r_[fresh, fb], np.r_[home, ub]
    order = np.lexsort((~f, u, c))  # of an edge that is there both ways, the fresh one
    c, u, f, h = c[order], u[order], f[order], h[order]
    keep = np.r_[True, (c[1:] != c[:-1]) | (u[1:] != u[:-1])] if len(c) else np.zeros(0, bool)
    return c[keep], u[keep], f[keep], h[keep]


def _request(k: int):
    """A block's neighbourhoods, for itself (dest is the block, with from), and the nodes it needs, for their blocks."""

    def run(state: pa.Table, back: pa.Table) -> pa.Table:
        out: list[tuple[int, int, bytes]] = []
        if state.num_rows:
            block = state["block"][0].as_py()
            c, u, f, h = _around(k, state, back)
            live = np.isin(c, c[f])  # centres without a fresh neighbour have nobody to introduce
            c, u, f, h = c[live], u[live], f[live], h[live]
            _, first = np.unique(u, return_index=True)
            out = [(d, block, p) for d, p in _parcels(h[first], u[first])]
            if len(c):
                out.append((block, -1, pickle.dumps((c, u, f), 5)))
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["dest", "source", "payload"])

    return run


def _supply(k: int):
    """The nodes asked of a block, with vectors and the score from which each takes a neighbour; neighbourhoods pass through."""

    def run(state: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if state.num_rows:
            block = state["block"][0].as_py()
            ids, x, at, v, s, *_ = pickle.loads(state["payload"][0].as_py())
            last = np.full(len(ids), np.inf, np.float32)
            np.minimum.at(last, at, s)
            last[np.bincount(at, minlength=len(ids)) < k] = -np.inf
            for source, payload in zip(asked["source"].to_pylist(), asked["payload"]):
                if source < 0:
                    out.append((block, False, payload.as_py()))
                else:
                    (wanted,) = pickle.loads(payload.as_py())
                    own = np.searchsorted(ids, wanted)
                    out.append((source, True, pickle.dumps((wanted, x[own], last[own], np.full(len(own), block)), 5)))
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.bool_(), pa.binary()))], names=["dest", "supplied", "payload"])

    return run


def _introduce(k: int):
    """Within a block of centres: pairs of neighbours, one of them fresh, nearer than the last of the list they may enter."""

    def run(parts: pa.Table) -> pa.Table:
        supplied = parts["supplied"].to_numpy()
        around = [pickle.loads(p.as_py()) for p in parts.filter(pa.array(~supplied))["payload"]]
        if not around:
            return _sent([])
        centre, member, fresh = around[0]
        ids, x, last, home = _received(parts.filter(pa.array(supplied)), ())
        order = np.argsort(ids)
        ids, x, last, home = ids[order], x[order], last[order], home[order]
        at = np.searchsorted(ids, member)
        out, held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))], 0
        for own in np.split(np.arange(len(centre)), np.flatnonzero(np.diff(centre)) + 1):
            new, all_ = at[own][fresh[own]], at[own]
            s = x[new] @ x[all_].T
            i, j = np.nonzero((s > last[new][:, None]) & (new[:, None] != all_[None, :]))
            out.append((new[i], all_[j], s[i, j]))
            i, j = np.nonzero((s > last[all_][None, :]) & (new[:, None] != all_[None, :]))
            out.append((all_[j], new[i], s[i, j]))
            held += len(out[-1][0]) + len(out[-2][0])
            if held > 2_000_000:
                out, held = [tuple(_best(*(np.concatenate(c) for c in zip(*out)), k))], 0
        u, v, s = _best(*(np.concatenate(c) for c in zip(*out)), k)
        return _sent(_parcels(home[u], ids[u], ids[v], s, home[v]))

    return run


def build(nodes: DataFrame, k: int = 32, settled: float = 0.01) -> DataFrame:
    """The blocks of a graph with up to k near nodes of every node. Ends when fewer than that share of the edges are new."""
    found = [nodes.select(F.col(t).alias("t"), "node", "block", "x").groupBy("t").applyInArrow(_first_lists(k), PARCEL) for t in ("t0", "t1", "t2")]
    found = found[0].unionByName(found[1]).unionByName(found[2])
    state = cut(nodes.select("block", "node", "x").groupBy("block").cogroup(found.groupBy("dest")).applyInArrow(_open(k), STATE), "graph")
    while True:
        back = state.mapInArrow(_reverse, PARCEL)
        asked = state.groupBy("block").cogroup(back.groupBy("dest")).applyInArrow(_request(k), "dest long, source long, payload binary")
        parts = state.groupBy("block").cogroup(asked.groupBy("dest")).applyInArrow(_supply(k), "dest long, supplied boolean, payload binary")
        found = parts.groupBy("dest").applyInArrow(_introduce(k), PARCEL)
        state = cut(state.groupBy("block").cogroup(found.groupBy("dest")).applyInArrow(_merge(k), STATE), "graph")
        counts = state.agg(F.sum("edges").alias("n"), F.sum("fresh").alias("new")).first()
        if (counts["new"] or 0) <= settled * (counts["n"] or 0):
            return state


def links_of(state: DataFrame, degree: int) -> DataFrame:
    """u and list: the neighbours of each node, both ways, that a search goes to."""

    def run(state: pa.Table, back: pa.Table) -> pa.Table:
        if not state.num_rows:
            return pa.table({"u": pa.array([], pa.int64()), "list": pa.array([], pa.list_(pa.int64()))})
        ids = pickle.loads(state["payload"][0].as_py())[0]
        c, u, *_ = _around(degree // 2, state, back)
        starts = np.searchsorted(c, np.arange(len(ids) + 1))
        return pa.table({"u": pa.array(ids, pa.int64()), "list": pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(u, pa.int64()))})

    back = state.mapInArrow(_reverse, PARCEL)
    return cut(state.groupBy("block").cogroup(back.groupBy("dest")).applyInArrow(run, "u long, list array<long>"), "links")


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        s = [float(np.dot(np.array(a.values), np.array(b.values))) for a, b in zip(batch.column("qvec"), batch.column("vec"))]
        yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("node"), pa.array(s, pa.float64())], ["q", "node", "s"])


def scored(pairs: DataFrame, classes: DataFrame, queries: DataFrame) -> DataFrame:
    """q, node and their inner product, of the original vectors in double precision."""
    both = pairs.join(classes.select("node", "vec"), "node").join(queries.select("q", "qvec"), "q")
    return both.select("q", "node", "vec", "qvec").mapInArrow(_score, "q long, node long, s double")


class _Group:
    """The searches of a group: beams (node, score, expanded) of its queries, and the nodes that it has seen."""

    def __init__(self, q: np.ndarray, vectors: np.ndarray):
        self.q, self.vectors = q, vectors
        self.node, self.s, self.done = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), np.float32), np.zeros((len(q), 0), bool)
        self.seen = np.zeros(0, np.int64)

    def take(self, ids: np.ndarray, x: np.ndarray, expanded: np.ndarray, beam: int) -> None:
        """Score new nodes for every query and keep the best; expanded: the nodes whose neighbours these are."""
        self.done |= np.isin(self.node, expanded)
        self.seen = np.union1d(self.seen, ids)
        for i in range(0, len(ids), 4096):
            s = self.vectors @ x[i : i + 4096, :-1].T
            node = np.concatenate([self.node, np.broadcast_to(ids[i : i + 4096], s.shape)], 1)
            score, done = np.concatenate([self.s, s], 1), np.concatenate([self.done, np.zeros(s.shape, bool)], 1)
            best = np.argsort(-score, axis=1, kind="stable")[:, :beam]
            self.node, self.s, self.done = (np.take_along_axis(a, best, 1) for a in (node, score, done))

    def wanted(self, width: int) -> np.ndarray:
        """The best nodes of each beam that were not expanded."""
        turn = ~self.done & (np.cumsum(~self.done, axis=1) <= width)
        return np.unique(self.node[turn])


def _advance(beam: int, width: int, first: bool):
    """A group's row and the vectors it was given, to its row after a round and one for each node to expand."""

    def run(state: pa.Table, given: pa.Table) -> pa.Table:
        if first:
            group = _Group(state["q"].to_numpy(), _floats(state["qx"]))
            expanded = np.zeros(0, np.int64)
        else:
            group, expanded = pickle.loads(state["payload"][0].as_py())
        order = np.argsort(given["node"].to_numpy())
        group.take(given["node"].to_numpy()[order], _floats(given["x"])[order], expanded, beam)
        wanted = group.wanted(width)
        g = state["g"][0].as_py()
        columns = [pa.array([g] * (1 + len(wanted)), pa.int64()), pa.array([None, *wanted.tolist()], pa.int64()), pa.array([pickle.dumps((group, wanted), 5), *[None] * len(wanted)], pa.binary())]
        return pa.table(columns, names=["g", "u", "payload"])

    return run


def _new_nodes(state: pa.Table, lists: pa.Table) -> pa.Table:
    """The neighbours of a group's expanded nodes that it hasn't seen."""
    group, _ = pickle.loads(state["payload"][0].as_py())
    near = np.unique(lists["list"].combine_chunks().flatten().to_numpy()) if lists.num_rows else np.zeros(0, np.int64)
    new = np.setdiff1d(near, group.seen, assume_unique=True)
    return pa.table({"to": pa.array(np.full(len(new), state["g"][0].as_py()), pa.int64()), "node": pa.array(new, pa.int64())})


def _beams(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column("payload"):
                group, _ = pickle.loads(payload.as_py())
                node = group.node[:, :most]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(group.q, node.shape[1])), pa.array(node.ravel())], ["q", "node"])

    return run


def beam_for(n: int) -> int:
    """The beam of a table of n nodes."""
    return 8 * max(8, math.ceil(math.log2(n + 1)))


def search(nodes: DataFrame, links: DataFrame, queries: DataFrame, top: int, beam: int, width: int, starts: int = 8) -> DataFrame:
    """q and node: candidates that greedy search finds for each search (g, q, qx, own, place), the best of its beam.

    own: the query's own node, or null; place: the leaf where it would be; g: its group; width: nodes that a round expands for a query.
    """
    first = nodes.withColumn("r", F.row_number().over(Window.partitionBy("place").orderBy(F.xxhash64("node")))).where(F.col("r") <= starts).select("place", "node")
    entries = queries.join(first, "place").select("g", "node").unionByName(queries.where("own is not null").select("g", F.col("own").alias("node"))).distinct()
    vectors = nodes.select("node", "x")
    kept = "g long, u long, payload binary"
    given = entries.join(vectors, "node").select(F.col("g").alias("of"), "node", "x")
    state = cut(queries.select("g", "q", "qx").groupBy("g").cogroup(given.groupBy("of")).applyInArrow(_advance(beam, width, True), kept), "beams")
    while state.where("u is not null").limit(1).count():
        lists = state.where("u is not null").select("g", "u").join(links, "u").select(F.col("g").alias("of"), "list")
        rows = state.where("u is null").select("g", "payload")
        new = rows.groupBy("g").cogroup(lists.groupBy("of")).applyInArrow(_new_nodes, "to long, node long")
        given = new.join(vectors, "node").select(F.col("to").alias("of"), "node", "x")
        state = cut(rows.groupBy("g").cogroup(given.groupBy("of")).applyInArrow(_advance(beam, width, False), kept), "beams")
    return state.where("u is null").select("payload").mapInArrow(_beams(top + top // 2), "q long, node long")


def nearest(vectors: DataFrame, every: int = 20, top: int = 20, key: str = "vec_id", vector: str = "embedding", k: int = 32, beam: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score: the ``top`` nearest rows found for each row whose key is divisible by ``every``."""
    spark: SparkSession = vectors.sparkSession
    path = scratch(spark, "nearest")
    with temporary(spark):
        return cut(_nearest(vectors, every, top, key, vector, k, beam), "nearest", path)


def _nearest(vectors: DataFrame, every: int, top: int, key: str, vector: str, k: int, beam: int | None) -> DataFrame:
    rows = cut(valid(vectors, key, vector).withColumns({"k1": F.xxhash64("vec"), "k2": F.xxhash64(F.lit(1), F.col("vec"))}), "vectors")
    # Members of a node beyond its first top + 1 can't be among any query's top.
    place = Window.partitionBy("k1", "k2").orderBy("id")
    homes = rows.groupBy("k1", "k2").agg(F.min("id").alias("node"))
    members = cut(rows.join(homes, ["k1", "k2"]).select("id", "vec", "node"), "members")
    first = rows.select("id", "k1", "k2").withColumn("r", F.row_number().over(place)).where(F.col("r") <= top + 1).join(homes, ["k1", "k2"]).select("node", "id")
    classes = members.where(F.col("id") == F.col("node")).select("node", "vec")
    bands = Bands(classes, LEAF, BLOCK, SAMPLE)
    nodes = _nodes(classes, bands)
    links = links_of(build(nodes, k), 2 * k)
    beam = max(beam or beam_for(max((b["n"] for b in bands.of.values()), default=1)), top + top // 2)
    asked = members.where(F.col("id") % every == 0).select(F.col("id").alias("q"), F.col("vec").alias("qvec"), F.col("node").alias("own"))
    asked = cut(asked, "queries")
    counts = {r["length"]: r["n"] for r in asked.groupBy(F.size("qvec").alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()}

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A search for each query and band of its length."""
        for batch in batches:
            length = np.array([len(x) for x in batch.column("qvec")])
            for (d, _), of in bands.of.items():
                rows = np.flatnonzero(length == d)
                if len(rows):
                    part = batch.take(pa.array(rows))
                    x = _matrix(part.column("qvec"))
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
                    at = leaves(np.c_[x, np.zeros(len(x))].astype(np.float32), *of["trees"][0])
                    groups = max(1, -(-counts[d] // GROUP))
                    g, count = at * groups // 2 ** of["depth"], max(1, -(-groups // 2 ** of["depth"]))
                    g = (of["no"] << 40) + g * count + _crc(part.column("q").to_pylist(), 3) % count
                    qx = pa.array([v.tobytes() for v in x.astype(np.float32)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(g), part.column("q"), qx, pa.array((of["no"] << 40) + at), part.column("own")], ["g", "q", "qx", "place", "own"])

    begun = asked.select("q", "qvec", "own").mapInArrow(entered, "g long, q long, qx binary, place long, own long")
    here = nodes.select(F.col("node").alias("own"), F.shiftright("place", 40).alias("band"))
    begun = begun.join(here, "own").withColumn("own", F.when(F.col("band") == F.shiftright("place", 40), F.col("own")))
    found = search(nodes, links, cut(begun.drop("band"), "searches"), top + 1, beam, max(1, beam // 4))
    expanded = scored(found, classes, asked).join(first, "node").where("id != q")
    ranked = expanded.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "id"))).where(F.col("rank") <= top)
    return ranked.select(F.col("q").alias("query_id"), "rank", F.col("id").alias("vec_id"), F.col("s").alias("score"))
