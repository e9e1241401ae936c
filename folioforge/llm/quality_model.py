"""Operator 5, a quality classifier on random-indexing word vectors.

Every word and every word shape has a fixed sparse random index vector; its word vector is the sum of the index vectors of
its neighbours in the training texts, normalised. A document is the mean of its words' vectors, beside the mean of their
shapes' vectors. A two-layer numpy network gives a logit; a temperature fitted on a fold it hasn't seen calibrates it.

Learning takes at most ``TRAIN_ROWS`` labelled documents and ``TRAIN_WORDS`` words, those with the least hash of doc_id that
``learn`` admits, in order of that hash; the bound doesn't grow with the input. Executors cut the chosen texts into words, and the
driver reads those within the bound. Of a text longer than an eighth of it a run of words is learnt from, at a place that its doc_id
draws: so no length keeps a document out, and none is a burden to the driver.
Scoring is a narrow map over whole texts; a score is a function of the text and the model alone, whatever stands beside it.

Null or empty text: a document without words has the zero vector and is scored as such. Null doc_id: scored, never learnt
from. Null quality: not learnt from; of several labels for a document their mean decides. No labels, or one class only: every
score is the share of label 1 (0.5 without labels). Repeated rows and further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import PUNCTUATION, Words, cut, filter_texts, map_texts, mixed, whole_texts
from .language_id import is_held_out

DIMENSIONS = 32
BUCKETS = 1 << 15
SHAPES = 1024
NEIGHBOURS = 2
HIDDEN = 24
TRAIN_ROWS = 3000
TRAIN_WORDS = 2_500_000
#: Of one document at most TRAIN_WORDS divided by this many words are learnt from.
LONG = 8
SEED = 20
EPOCHS = 300

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Classes of bytes: 0 lower case or not ASCII, 1 capital, 2 digit, 3 full stop and comma, 4 other sentence marks, 5 symbols.
_CLASS = np.full(256, 5, np.int64)
_CLASS[97:123] = _CLASS[128:] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[44, 46]] = 3
_CLASS[[33, 34, 39, 40, 41, 45, 58, 59, 63]] = 4


def index_vectors() -> np.ndarray:
    """A fixed ternary vector, three quarters zeros, for each bucket of words and each shape."""
    return np.random.default_rng(SEED).choice(np.array([-1, 0, 0, 0, 0, 0, 0, 1], np.float32), (BUCKETS + SHAPES, DIMENSIONS))


def word_ids(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every word with where each text's begin, and shape of every word as it is written, likewise."""
    data = [x.encode("utf-8", "surrogatepass") for x in texts]
    plain = Words(data, PUNCTUATION)
    plain.data = _LOWER[plain.data]
    buckets = (plain.hashes() & np.uint64(BUCKETS - 1)).astype(np.int64)
    written = Words(data)
    kind = _CLASS[written.data]
    capitals = np.concatenate(([0], np.cumsum(kind == 1)))
    length = written.end - written.start
    last, before = kind[written.end - 1], kind[np.maximum(written.end - 2, written.start)]
    shouted = (capitals[written.end] - capitals[written.start]) * 2 > length
    size = np.minimum(np.log2(length).astype(np.int64), 4)
    # A word that says the word before it in the same text again.
    written.data = _LOWER[written.data]
    same = written.hashes()
    again = np.concatenate(([False], same[1:] == same[:-1]))[: len(same)]
    again[written.first[written.first < len(same)]] = False
    shape = (((last * 6 + before) * 2 + shouted) * 5 + size) * 2 + again
    return buckets, plain.first, BUCKETS + shape, written.first


def pooled(vectors: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The mean vector of each text's words."""
    out = np.zeros((len(first) - 1, vectors.shape[1]), np.float32)
    n = np.diff(first)
    some = np.flatnonzero(n)
    if len(some):
        out[some] = np.add.reduceat(vectors[ids], first[:-1][some], axis=0) / n[some, None]
    return out


@dataclass
class Model:
    """What scoring needs; vectors: of words and shapes. share: the answer without a network."""

    share: float = 0.5
    vectors: np.ndarray | None = None
    layers: tuple | None = None
    temperature: float = 1.0

    def features(self, texts: list[str]) -> np.ndarray:
        buckets, at, shapes, shapes_at = word_ids(texts)
        return np.hstack((pooled(self.vectors, buckets, at), pooled(self.vectors, shapes, shapes_at)))

    def score(self, texts: list[str]) -> np.ndarray:
        if self.layers is None:
            return np.full(len(texts), self.share)
        # Nine places: how many texts are scored at once may change the last bits of a matrix product.
        return np.round(1 / (1 + np.exp(-np.clip(logits(self.layers, self.features(texts)) / self.temperature, -30, 30))), 9)


def logits(layers: tuple, x: np.ndarray) -> np.ndarray:
    mean, scale, w1, b1, w2, b2 = layers
    return np.tanh(((x - mean) / scale) @ w1 + b1) @ w2 + b2


def network(x: np.ndarray, y: np.ndarray) -> tuple:
    """Two layers, fitted by Adam on the cross entropy with a little weight decay."""
    rng = np.random.default_rng(SEED)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-4
    z = (x - mean) / scale
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.log(share / (1 - share))]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for t in range(1, EPOCHS + 1):
        h = np.tanh(z @ p[0] + p[1])
        d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y) / len(y)
        back = d[:, None] * p[2] * (1 - h * h)
        for i, g in enumerate((z.T @ back + 1e-3 * p[0], back.sum(axis=0), h.T @ d + 1e-3 * p[2], d.sum())):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - 0.02 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return mean, scale, p[0], p[1], p[2], p[3]


def temperature_of(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least cross entropy on unseen rows."""
    tried = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    return float(min(tried, key=lambda t: np.logaddexp(0, np.where(y > 0.5, -z, z) / t).mean()))


def _groups(rows: list, most: int = 50_000) -> list[list]:
    """The rows in runs of about so many words, which bound the memory of learning."""
    out: list[list] = [[]]
    held = 0
    for r in rows:
        if held and held + len(r[0]) > most:
            out.append([])
            held = 0
        out[-1].append(r)
        held += len(r[0])
    return out


def trained(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """rows: buckets, shapes and label of each training document, in order of their hash."""
    y = np.array([r[2] for r in rows], np.float64)
    if len(set(y.tolist())) < 2:
        return Model(share=float(y.mean()) if len(y) else 0.5)
    index = np.vstack((index_vectors(), np.zeros((1, DIMENSIONS), np.float32)))
    context = np.zeros((len(index), DIMENSIONS))
    gap = np.full(NEIGHBOURS, len(index) - 1)  # as wide as the window, so that neighbours are within a text
    groups = _groups(rows)
    for group in groups:
        for k in (0, 1):
            ids = np.concatenate([x for r in group for x in (r[k], gap)])
            own = index[ids]
            around = np.zeros_like(own)
            for s in range(1, NEIGHBOURS + 1):
                around[s:] += own[:-s]
                around[:-s] += own[s:]
            for d in range(DIMENSIONS):
                context[:, d] += np.bincount(ids, weights=around[:, d], minlength=len(index))
    context = context[:-1].astype(np.float32)
    vectors = context / (np.linalg.norm(context, axis=1, keepdims=True) + 1e-6)

    def means(group: list, k: int) -> np.ndarray:
        return pooled(vectors, np.concatenate([r[k] for r in group]), np.cumsum([0, *(len(r[k]) for r in group)]))

    x = np.vstack([np.hstack((means(g, 0), means(g, 1))) for g in groups]).astype(np.float64)
    unseen = np.arange(len(y)) % 5 == 4
    temperature = 1.0
    if len(set(y[~unseen].tolist())) == 2 and unseen.any():
        temperature = temperature_of(logits(network(x[~unseen], y[~unseen]), x[unseen]), y[unseen])
    return Model(float(y.mean()), vectors, network(x, y), temperature)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, train_rows: int = TRAIN_ROWS, train_words: int = TRAIN_WORDS) -> Model:
    """A model of labels.quality from labelled documents that ``learn`` (on doc_id) admits, within both bounds."""
    given = labels.select("doc_id", "quality").filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & learn)
    chosen = given.groupBy("doc_id").agg(F.avg("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    wanted = {r[0]: int(r[1] >= 0.5) for r in chosen.collect()}
    if not wanted:
        return Model()
    # Of rows with the same doc_id the text with the least hash: a hot doc_id is one row after the partial aggregation.
    ids = docs.sparkSession.createDataFrame([(x,) for x in wanted], "doc_id bigint")
    texts = (
        docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id", "left_semi")
        .groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    )

    most = max(1, train_words // LONG)

    def make():
        def work(part: pa.RecordBatch) -> list:
            ids = part.column("doc_id").to_numpy()
            buckets, at, shapes, shapes_at = word_ids(whole_texts(part.column("text")))

            def runs(x: np.ndarray, at: np.ndarray) -> list[bytes]:
                """Each text's words, or a run of ``most`` of them from a place that the doc_id draws."""
                out = []
                for i, a, b in zip(ids.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    a += int(mixed(np.array([i], np.int64).view(np.uint64))[0]) % max(1, b - a - most + 1)
                    out.append(x[a : min(b, a + most)].astype("<i4").tobytes())
                return out

            return [part.column("doc_id"), pa.array(np.minimum(np.diff(at), most)), pa.array(runs(buckets, at), pa.binary()), pa.array(runs(shapes, shapes_at), pa.binary())]

        return work

    # Words stay on the executors' side until it is known which documents are read; the driver reads those alone.
    read = cut(map_texts(texts, "doc_id bigint, n bigint, buckets binary, shapes binary", make))
    left, fit_ = train_words, []
    for r in sorted(read.select(F.xxhash64("doc_id").alias("h"), "doc_id", "n").collect()):
        if left <= 0:  # in order of the hash, so what is left out says nothing of its length
            break
        left -= r["n"]
        fit_.append(r["doc_id"])
    of = {x: k for k, x in enumerate(fit_)}
    within = sorted(((of[r["doc_id"]], np.frombuffer(r["buckets"], "<i4"), np.frombuffer(r["shapes"], "<i4"), wanted[r["doc_id"]]) for r in _few(read, fit_)), key=lambda r: r[0])
    return trained([r[1:] for r in within])


def _few(df: DataFrame, ids: list) -> Iterator[Row]:
    """The rows of those ids, one partition at a time."""
    return df.join(F.broadcast(df.sparkSession.createDataFrame([(x,) for x in ids], "doc_id bigint")), "doc_id", "left_semi").toLocalIterator()


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted of every row."""

    def make():
        def work(part: pa.RecordBatch) -> list:
            score = model.score(whole_texts(part.column("text")))
            return [part.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]

        return work

    return map_texts(docs, "doc_id bigint, score double, predicted int", make)


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; learnt from labels that aren't held out."""
    model = fit(docs, labels, ~is_held_out(3, 1))
    return scores(docs, model).select("doc_id", is_held_out(3, 1).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, that the classifier doesn't reject."""
    model = fit(docs, labels, ~is_held_out(3, 1))

    def make():
        return lambda part: model.score(whole_texts(part.column("text"))) >= 0.5

    return filter_texts(docs, make)
