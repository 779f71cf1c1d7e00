"""Near-duplicate components by a signature-coordinate inverted join, exact after candidates.

Every document becomes the set of its word shingles. Documents with equal sets form a class, and one of each class goes on.
A class is posted under its signature's coordinate-value pairs (tokens). Two sets of the sought similarity agree in at
least ``match`` of the ``COORDINATES`` tokens but for one pair in ten million, so tokens are ordered by rarity and of
those that others share only the first are posted: two classes with ``match`` common tokens meet in one of these (prefix),
and the long lists of frequent tokens are skipped.

What is asked for is components, so a list need not be multiplied out. First come rounds of stars: every list names one
pivot (the member with the most shared tokens, later one by hash of the largest component that it holds), collisions of classes
with pivots are counted, and each class is compared with the pivot it collides with most. That is one pair a class and round, and it
merges groups of near copies however large; rounds end when hardly a class finds a link. Lists that still hold several components are then merged: within a list, a pair of different components counts its collisions
in the first list that it shares and nowhere else; from ``match`` on a finer sketch of ``FINE`` coordinates is compared, again with a miss of
one in ten million; pairs that stay are confirmed on the full sets. Long lists are cut into blocks that meet pairwise, so that no
task holds a whole one. No pair is given up, no list is cut short, and no pair within a component is made.

Defined results: documents without words have the empty set and are linked with nothing; rows that share a doc_id are one
node (all of them kept if it is the smallest of its component); rows with a null doc_id take no part, with null as component
and kept; an empty table gives an empty result; other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cut, partitions, scratch, temporary, tidy

COORDINATES, FINE = 48, 2048
SKETCH = "doc_id long, n_shingles long, k1 long, k2 long, signature array<long>"
SETS = "rep long, shingles binary, mask long, coarse binary, fine binary"
#: Share of pairs at exactly the sought similarity that may agree in fewer tokens.
MISSED = 1e-7
#: Members of a list that one task compares, and words whose hashes a worker remembers.
BLOCK, REMEMBERED = 4096, 200_000

_random = np.random.default_rng(7)
_FACTORS = _random.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDED = _random.integers(1, 2**63, COORDINATES, dtype=np.uint64)
_TAGS = np.arange(COORDINATES, dtype=np.uint64) << np.uint64(56)
_FINE_FACTORS = _random.integers(1, 2**31, FINE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FINE_ADDED = _random.integers(0, 2**32, FINE, dtype=np.uint32)

#: How many of the two halves of a byte are zero.
_EQUAL_HALVES = np.array([(i < 16) + (i % 16 == 0) for i in range(256)], np.uint8)


def least_matches(similarity: float, coordinates: int = COORDINATES) -> int:
    """The most coordinates in which pairs of that similarity agree with a probability of at least 1 - MISSED."""
    chance = lambda at: exp(lgamma(coordinates + 1) - lgamma(at + 1) - lgamma(coordinates - at + 1) + at * log(similarity) + (coordinates - at) * log1p(-similarity))
    at, below = 0, 0.0
    while (below := below + chance(at)) <= MISSED:
        at += 1
    return at


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


class Shingler:
    """Sets of word shingles as sorted 64-bit hashes. A worker hashes each word once."""

    def __init__(self, width: int):
        self.width, self.known = width, _Hashes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # of bytes: A-Z alone, and the six ASCII white spaces
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return h
        width = min(self.width, len(h))
        out = np.full(len(h) - width + 1, width, np.uint64)
        for i in range(width):
            out = (out ^ h[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(out ^ (out >> np.uint64(32)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The tokens of a set: 56 bits of the least hash under each coordinate, tagged with the coordinate."""
    least = np.full(COORDINATES, 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[i : i + 4096, None] * _FACTORS + _ADDED).min(0))
    return ((least >> np.uint64(8)) | _TAGS).view(np.int64)


def fine_sketch(shingles: np.ndarray) -> np.ndarray:
    """Four bits of the least 32-bit hash under each of FINE coordinates."""
    x, least = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32), np.full(FINE, 2**32 - 1, np.uint32)
    for i in range(0, len(x), 256):
        least = np.minimum(least, (x[i : i + 256, None] * _FINE_FACTORS + _FINE_ADDED).min(0))
    four = ((least * np.uint32(0x9E3779B1)) >> np.uint32(28)).astype(np.uint8)
    return four[::2] << 4 | four[1::2]


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            sizes, k1, k2, signatures = [], [], [], []
            for text in batch.column(1):
                found = shingler(text.as_py())
                digest = xxhash.xxh3_128_digest(found.tobytes())
                sizes.append(len(found))
                k1.append(int.from_bytes(digest[:8], "big", signed=True))
                k2.append(int.from_bytes(digest[8:], "big", signed=True))
                signatures.append(signature(found) if len(found) else None)
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, k1, k2)), pa.array(signatures, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "k1", "k2", "signature"])

    return run


def _sets(width: int):
    """Texts with the tokens that their class posts, to sets and sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            out = []
            for tokens, text in zip(batch.column("tokens"), batch.column("text")):
                found = shingler(text.as_py())
                if not len(found):  # another text of the same doc_id
                    out.append((b"", 0, bytes(4 * COORDINATES), bytes(FINE // 2)))
                    continue
                own = signature(found)
                posted = np.isin(own, tokens.values.to_numpy())
                mask = int((posted.astype(np.uint64) << np.arange(COORDINATES, dtype=np.uint64)).sum())
                out.append((found.tobytes(), mask, own.astype(np.uint32).tobytes(), fine_sketch(found).tobytes()))
            columns = [pa.array(c, k) for c, k in zip(zip(*out), (pa.binary(), pa.int64(), pa.binary(), pa.binary()))] if out else [pa.array([], k) for k in (pa.binary(), pa.int64(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), *columns], ["rep", "shingles", "mask", "coarse", "fine"])

    return run


def _confirm(percent: int):
    """Pairs with both sets to those that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("shingles_a"), batch.column("shingles_b")):
                own, other = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(own, other, assume_unique=True))
                good.append(common > 0 and 100 * common >= percent * (len(own) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _alike(fine_match: int):
    """Pairs with both sketches to those that collide often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, FINE // 2) for c in ("fine_a", "fine_b"))
            yield batch.select(["a", "b"]).filter(pa.array(_EQUAL_HALVES[x ^ y].sum(1, dtype=np.int64) >= fine_match, pa.bool_()))

    return run


def components(edges: DataFrame, passes: int | None = None) -> DataFrame:
    """node and component (its smallest reachable node) of every end of the edges (a, b): labels pass along edges and jump.

    With so many passes, labels may still be too fine: equal labels are in one component, and stars have one label.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("c")), "labels")
    while passes is None or passes > 0:
        passed = both.join(labels.select(F.col("node").alias("near_node"), "c"), F.col("b") == F.col("near_node")).groupBy(F.col("a").alias("node")).agg(F.min("c").alias("near"))
        nearer = labels.join(passed, "node").select("node", "c", F.least("c", "near").alias("n"))
        jump = labels.select(F.col("node").alias("n"), F.col("c").alias("far"))
        now = cut(nearer.join(jump, "n", "left").select("node", F.least("n", "far").alias("n"), "c"), "labels")
        labels = now.select("node", F.col("n").alias("c"))
        if passes is not None:
            passes -= 1
        elif not now.where("n != c").limit(1).count():
            break
    return labels.select("node", F.col("c").alias("component"))


def _posted(classes: DataFrame, match: int) -> DataFrame:
    """rep, shared and tokens: of the tokens that other classes share, the rarest that a pair with ``match`` matches can't all avoid."""
    tokens = classes.select("rep", F.explode("signature").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = tokens.join(shared, "token").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("own")).where(F.size("own") >= match)
    prefix = F.slice("own", F.lit(1), F.size("own") - match + 1)
    return own.select("rep", F.size("own").alias("shared"), F.transform(prefix, lambda t: t["token"]).alias("tokens"))


def _stars(lists: DataFrame, by: Column) -> DataFrame:
    """a, b: each class with the pivot that it collides with most often, of another component. A list's pivot is its greatest member ``by``."""
    pivots = lists.groupBy("token").agg(F.max(F.struct(by.alias("by"), "rep", "c")).alias("p"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi")
    met = lists.join(pivots.select("token", F.col("p.rep").alias("p"), F.col("p.c").alias("pc")), "token").where("c != pc")
    counted = met.groupBy("rep", "p").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("rep").agg(F.max(F.struct("n", F.xxhash64("p").alias("h"), "p")).alias("best"))
    return best.select(F.col("rep").alias("a"), F.col("best.p").alias("b"))


def _open_blocks(lists: DataFrame, block: int) -> DataFrame:
    """token, x, y, i, rep, c: members of the lists with several components, once for each pair of blocks x <= y that its block i meets in.

    A list of up to ``block`` members is one block. A longer one is cut; blocks of its largest component don't meet each other.
    """
    sizes = lists.groupBy("token", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.max(F.struct("n", "c")).alias("big")).where("k > 1")
    long_list = F.col("n") > block
    others = F.when(long_list, F.ceil(2 * (F.col("n") - F.col("big.n")) / block)).otherwise(1).cast("int")
    largest = F.when(long_list, F.ceil(2 * F.col("big.n") / block)).otherwise(0).cast("int")
    rows = lists.join(sizes.select("token", others.alias("others"), largest.alias("largest"), F.col("big.c").alias("big")), "token")
    in_largest = (F.col("largest") > 0) & (F.col("c") == F.col("big"))
    dealt = lambda n: F.pmod(F.xxhash64("rep"), F.greatest(n, F.lit(1))).cast("int")
    rows = rows.withColumn("i", F.when(in_largest, F.col("others") + dealt(F.col("largest"))).otherwise(dealt(F.col("others"))))
    partners = F.sequence(F.lit(0), F.when(in_largest, F.col("others") - 1).otherwise(F.col("others") + F.col("largest") - 1))
    rows = rows.select("token", "i", "rep", "c", F.explode(partners).alias("j"))
    return rows.select("token", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), "i", "rep", "c")


def _meet(match: int, fine_match: int):
    """Rows of list blocks, in order, to the pairs of different components that collide often enough and share no earlier list."""
    names = ("token", "x", "y", "i", "rep", "c", "mask")
    ways = np.arange(COORDINATES, dtype=np.uint64)

    def pairs(g: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        x, y = g["x"][0], g["y"][0]
        c, found, n = g["c"], *np.unique(g["c"], return_counts=True)
        if len(found) < 2:
            return
        earlier = (np.uint64(1) << (g["token"][:1].view(np.uint64)[0] >> np.uint64(56))) - np.uint64(1)
        big = c == found[n.argmax()]
        if x == y:  # pairs within the largest component are none, so the others meet all
            left, right = np.flatnonzero(~big), np.arange(len(c))
        else:
            left, right = np.flatnonzero(g["i"] == x), np.flatnonzero(g["i"] == y)
        for s in range(0, len(left), 64):
            l = left[s : s + 64]
            near = np.zeros((len(l), len(right)), np.uint8)
            for k in range(COORDINATES):
                near += g["coarse"][l, k][:, None] == g["coarse"][right, k][None, :]
            near = (near >= match) & (c[l][:, None] != c[right][None, :])
            if x == y:
                near &= big[right][None, :] | (l[:, None] < right[None, :])
            a, b = np.nonzero(near)
            a, b = l[a], right[b]
            for t in range(0, len(a), 4096):
                p, q = a[t : t + 4096], b[t : t + 4096]
                same = ((g["coarse"][p] == g["coarse"][q]).astype(np.uint64) << ways).sum(1, dtype=np.uint64)
                first = (same & g["mask"][p].view(np.uint64) & g["mask"][q].view(np.uint64) & earlier) == 0
                p, q = p[first], q[first]
                close = _EQUAL_HALVES[g["fine"][p] ^ g["fine"][q]].sum(1, dtype=np.int64) >= fine_match
                yield g["rep"][p[close]], g["rep"][q[close]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(groups: list[dict]) -> Iterator[pa.RecordBatch]:
            made = [p for g in groups for p in pairs(g)]
            if made:
                a, b = (np.concatenate(m) for m in zip(*made))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        rest: dict = {}
        for batch in batches:
            rows = {k: batch.column(k).to_numpy() for k in names}
            for k, width, kind in (("coarse", COORDINATES, np.uint32), ("fine", FINE // 2, np.uint8)):
                rows[k] = np.frombuffer(b"".join(batch.column(k).to_pylist()), kind).reshape(-1, width)
            if rest:
                rows = {k: np.concatenate([rest[k], v]) for k, v in rows.items()}
            if not len(rows["x"]):
                continue
            new = (np.diff(rows["token"]) != 0) | (np.diff(rows["x"]) != 0) | (np.diff(rows["y"]) != 0)
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(rows["x"])]
            yield from out([{k: v[i:j] for k, v in rows.items()} for i, j in zip(cuts[:-2], cuts[1:-1])])
            rest = {k: v[cuts[-2] :].copy() for k, v in rows.items()}
        if rest:
            yield from out([rest])

    return run


def link_classes(classes: DataFrame, docs: DataFrame, width: int, percent: int, rounds: int = 6, settled: float = 0.002, block: int | None = None) -> DataFrame:
    """node and component of the classes (rep, signature) that are linked with another one.

    rounds and settled (a share of the classes) end the stars; they spare pairs and don't change the result.
    """
    spark, match = classes.sparkSession, least_matches(percent / 100)
    fine_match = least_matches(percent / 100 + (1 - percent / 100) / 16, FINE)
    active = cut(_posted(classes, match), "posted")
    sets = cut(docs.join(active, docs["doc_id"] == active["rep"]).select("rep", "tokens", "text").mapInArrow(_sets(width), SETS), "sets")
    postings = active.select(F.explode("tokens").alias("token"), "rep", "shared")
    tidy(spark)
    links, found, n = [], None, active.count()
    lists = postings.withColumns({"c": F.col("rep"), "size": F.lit(1)})
    while found is None or len(links) < 2 or found > settled * n and len(links) < rounds:
        by = F.col("shared") if found is None else F.struct("size", F.xxhash64("rep", F.lit(len(links))))
        near = cut(_both(_stars(lists, by), sets, "fine").mapInArrow(_alike(fine_match), "a long, b long"), "near")
        links.append(cut(_confirmed(near, sets, percent), "links"))
        found = links[-1].count()
        tidy(spark)
        labels = components(reduce(DataFrame.unionByName, links))
        sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
        labels = cut(labels.join(sizes, "component").select(F.col("node").alias("rep"), F.col("component").alias("c"), "size"), "labels")
        lists = postings.join(labels, "rep", "left").select("token", "rep", "shared", F.coalesce("c", "rep").alias("c"), F.coalesce("size", F.lit(1)).alias("size"))
    lists = cut(lists, "lists")
    tidy(spark)
    met = _open_blocks(lists, block or BLOCK).join(sets.drop("shingles"), "rep")
    met = met.repartition(partitions(spark), "token", "x", "y").sortWithinPartitions("token", "x", "y")
    pairs = cut(met.select("token", "x", "y", "i", "rep", "c", "mask", "coarse", "fine").mapInArrow(_meet(match, fine_match), "a long, b long"), "pairs")
    tidy(spark)
    links.append(cut(_confirmed(pairs, sets, percent), "links"))
    return components(reduce(DataFrame.unionByName, links))


def _both(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    of = lambda end: sets.select(F.col("rep").alias(end), F.col(column).alias(f"{column}_{end}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", f"{column}_a", f"{column}_b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    return _both(pairs, sets, "shingles").mapInArrow(_confirm(percent), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs.

    width: words of a shingle; percent: documents are linked with 100 * common >= percent * all shingles of the two sets.
    """
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = cut(texts.mapInArrow(_sketch(width), SKETCH), "sketch")
    known = sketch.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = known.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.min_by("signature", "doc_id").alias("signature"), F.max("doc_id").alias("last"))
    classes = cut(classes, "classes")
    path = scratch(spark, "linked")
    with temporary(spark):
        labels = cut(link_classes(classes, texts, width, percent), "linked", path)
    # Classes of one document that are linked with nothing are their own component, and need no join.
    homes = classes.join(labels, classes["rep"] == labels["node"], "left").where("last != rep or component is not null")
    homes = homes.select("k1", "k2", F.coalesce("component", "rep").alias("home")).withColumn("n_home", F.lit(1))
    found = sketch.select("doc_id", "n_shingles", "k1", "k2").join(homes, ["k1", "k2"], "left")
    linked = F.col("n_home").isNotNull() & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    component = F.when(linked, F.col("home")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def dedup(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, that are kept: one document of each component."""
    gone = near_duplicates(docs, width, percent).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
