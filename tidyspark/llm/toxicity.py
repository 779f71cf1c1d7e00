"""Toxicity by compression distance: zstandard dictionaries trained on ordinary and on toxic text.

The ordinary dictionary is trained on windows of ordinary documents. The toxic one is trained on windows of toxic documents that
toxic text tells apart: the toxic documents are dealt into halves, and a short window of one half counts if a dictionary of the other
half saves more bytes of it, over the ordinary one, than of nearly all (``TELLING``) short windows of ordinary documents; this is done twice, the
second time with dictionaries of such windows. Toxic documents consist mostly of ordinary words, so without this the two
dictionaries differ by chance more than by what is toxic. Every window of a text is compressed with the ordinary dictionary and with
the same one extended by the toxic dictionary's content; both keep the trained entropy tables. The bytes saved are the evidence of a window. How many bytes
make a window strong is calibrated as a quantile on ordinary documents that did not train the dictionaries, and a logistic model on all documents
that did not turns the windows of a whole text into a score.

Only a bounded sample of labelled rows trains the model (``per_class`` documents a class, whole texts); scoring reads every window of
every text. Nothing but the text enters a score.

Defined results: null and empty texts have no window and get the score of a text without evidence; without labels of
both classes every score is the share of toxic labels (0 without labels); repeated labels of a document count once, toxic
if any is; labels with a null doc_id or a null class are ignored; a null doc_id is not held out; repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

WINDOW, STEP = 64, 48
#: Short windows, among which the telling ones are found, and the share of ordinary ones that save less.
SHORT, SHORT_STEP, TELLING = 24, 8, 0.995
ORDINARY_BYTES, TOXIC_BYTES, HALF_BYTES = 65_536, 4_096, 16_384
#: A trained dictionary begins with this; its tables end well before HEADER.
MAGIC, HEADER = b"\x37\xa4\x30\xec", 1024
SCORED = "doc_id long, score double"


@dataclass
class Model:
    """ordinary, toxic: dictionaries; strong: bytes saved by a strong window; weights of the features, the constant last; prior: share of toxic labels."""

    prior: float
    ordinary: bytes = b""
    toxic: bytes = b""
    strong: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))


def windows(text: str | None, size: int = WINDOW, step: int = STEP) -> list[bytes]:
    """Overlapping windows over the whole text; any run of size - step bytes is whole in one of them."""
    data = (text or "").lower().encode()
    return [data[i : i + size] for i in range(0, max(1, len(data) - size + step), step)] if data else []


def _compressor(dictionary: bytes):
    params = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_LAZY2, min_match=4, search_log=5, window_log=17, hash_log=16, chain_log=16, target_length=64,
        write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    made = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_FULLDICT if dictionary[:4] == MAGIC else zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=made, compression_params=params).compress


def extended(ordinary: bytes, toxic: bytes) -> bytes:
    """The ordinary dictionary with the toxic one's content in front of most of its own, under the same tables."""
    content = toxic[HEADER:] if toxic[:4] == MAGIC else toxic
    return ordinary[:HEADER] + content + ordinary[HEADER:] if ordinary[:4] == MAGIC else content + ordinary


def _saved(plain, both, of: list[bytes]) -> list[int]:
    return [len(plain(w)) - len(both(w)) for w in of]


class Scorer:
    """Features and scores of texts under a model."""

    def __init__(self, model: Model):
        self.model = model
        if len(model.ordinary):
            self.plain, self.both = _compressor(model.ordinary), _compressor(extended(model.ordinary, model.toxic))

    def features(self, text: str | None) -> list[float]:
        saved = sorted(_saved(self.plain, self.both, windows(text)), reverse=True)
        if not saved:
            return [0.0] * 6
        strong = sum(x > self.model.strong for x in saved)
        return [saved[0], sum(saved[:3]) / 3, sum(saved) / len(saved), np.log1p(strong), strong / len(saved), np.log1p(len(saved))]

    def score(self, text: str | None) -> float:
        w = self.model.weights
        if not len(w):
            return self.model.prior
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.features(text), w[:-1]) + w[-1], -30, 30))))


def _dictionary(samples: list[bytes], size: int, segment: int = 16) -> bytes:
    """A trained dictionary; of samples too few to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def telling_windows(toxic: list[str], ordinary: list[str], dictionary: bytes) -> list[bytes]:
    """Short windows of toxic texts that dictionaries of other toxic texts tell apart. dictionary: of ordinary texts, but not of these."""
    plain = _compressor(dictionary)
    halves = [[w for t in toxic[i::2] for w in windows(t, SHORT, SHORT_STEP)] for i in (0, 1)]
    control = [w for t in ordinary for w in windows(t, SHORT, SHORT_STEP)]
    found, size = halves, HALF_BYTES
    for _ in range(2):
        told: list[list[bytes]] = [[], []]
        for i in (0, 1):
            if own := _dictionary(found[i], size):
                both = _compressor(extended(dictionary, own))
                bound = max(2, np.quantile(_saved(plain, both, control), TELLING)) if control else 2
                told[1 - i] = [w for w, n in zip(halves[1 - i], _saved(plain, both, halves[1 - i])) if n > bound]
        found, size = told, TOXIC_BYTES
    return found[0] + found[1]


def _logistic(x: np.ndarray, y: np.ndarray, prior: float, ridge: float = 1.0) -> np.ndarray:
    """Weights by Newton's method on standardised features, with the constant moved from the sample's share to prior."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / spread, np.ones(len(x))]
    w, penalty = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + penalty, z.T @ (y - p) - penalty @ w)
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    w[-1] += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return np.r_[w[:-1] / spread, w[-1] - (w[:-1] * mean / spread).sum()]


def fit(sample: list[tuple[str, int]], prior: float) -> Model:
    """A model from (text, toxic) pairs: every other pair of a class trains the dictionaries, the rest calibrate."""
    by = [[t or "" for t, y in sample if y == label] for label in (0, 1)]
    if not 0 < prior < 1 or min(map(len, by)) < 4:
        return Model(prior)
    ordinary = _dictionary([w for t in by[0][::2] for w in windows(t, WINDOW, WINDOW)], ORDINARY_BYTES, 32)
    if not ordinary:
        return Model(prior)
    rest = [by[0][1::2], by[1][1::2]]
    telling = telling_windows(by[1][::2], rest[0][::4], ordinary)
    if not telling:
        return Model(prior)
    model = Model(prior, ordinary, _dictionary(telling, TOXIC_BYTES))
    scorer = Scorer(model)
    calm = _saved(scorer.plain, scorer.both, [w for t in rest[0] for w in windows(t)])
    model.strong = max(2.0, float(np.quantile(calm, TELLING))) if calm else 2.0
    x = np.array([scorer.features(t) for own in rest for t in own])
    model.weights = _logistic(x, np.repeat([0.0, 1.0], [len(own) for own in rest]), prior)
    return model


def in_training_fold(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> Model:
    """A model from a bounded sample of the labelled documents outside the held-out fold.

    per_class: documents a class, those of the smallest hashes of doc_id, with their whole texts. The driver gets 2 * per_class
    texts and two counts.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & in_training_fold(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    if len(counts) < 2:
        return Model(prior)
    chosen = known.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    chosen = chosen.unionByName(known.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").collect()  # chosen: 2 * per_class rows at most
    one = {r["doc_id"]: (r["text"], r["toxic"]) for r in sorted(rows, key=lambda r: r["text"])}
    return fit([one[i] for i in sorted(one)], prior)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from the threshold on) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            scores = [scorer.score(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    bounded_batches(docs.sparkSession)
    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCORED)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose text scores below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(text) < threshold for text in batch.column("text").to_pylist()], pa.bool_()))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
