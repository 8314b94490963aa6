"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the presence of hashed word features (a word and its first 3 to 8 letters) is trained in
numpy from confirmed toxic texts P and unlabelled texts U. With class prior p and logistic loss, the risk is
p R_P(+) + max(0, R_U(-) - p R_P(-)). While the second part is not negative, the whole is stepped down; where it is,
only that part is stepped up, as the published rule has it.
The prior is the share of toxic rows among the labelled rows of the training folds. U is a sample of those folds'
documents with labels unseen.

Training is on bounded samples (max_positive and max_unlabelled rows: those with the least hashes of doc_id, then of
the text), as numpy trains on the driver. Features are counted on the executors, each text whole; those chosen, at most
max_features, are the ones that P has so much more often than the class that U and the prior leave. The driver gets
these features and, of each sampled text, which of them it has. Scoring is a pass over all whole texts. The label
table's null or repeated rows: a document counts as toxic if any of its rows says 1.

Null and empty texts have no features and get the score of the bias alone. If no row is labelled toxic in the
training folds, all scores are 0. Repeated rows get equal scores. Extra columns of documents pass through except those
named as results.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, cut, staged, text_or_empty

SPACE = 1 << 22
CACHE = 150_000
LONGEST_CACHED = 64
# fixed values: characters taken off the ends of a token
EDGE = " \t\r\n.,;:!?\"'()[]{}<>*%$#&@|/\\+-=_~`^0123456789«»“”„’‘…"


def word_features(token: str) -> tuple[int, ...]:
    """Hashes of a lower-case word and of its beginnings."""
    word = token.strip(EDGE)
    if len(word) < 2:
        return ()
    found = {zlib.crc32(b"w" + word.encode()) % SPACE}
    found |= {zlib.crc32(b"p" + word[:n].encode()) % SPACE for n in range(3, min(len(word), 9))}
    return tuple(found)


class _Words(dict):
    def __init__(self, keep: dict[int, int] | None):
        self.keep = keep

    def __missing__(self, token):
        found = word_features(token)
        if self.keep is not None:
            found = tuple(self.keep[f] for f in found if f in self.keep)
        if len(token) <= LONGEST_CACHED:
            if len(self) >= CACHE:
                self.clear()
            self[token] = found
        return found


def text_features(text: str, words: _Words) -> set[int]:
    return set().union(*filter(None, map(words.__getitem__, set(text.lower().split()))))


def folds(column) -> F.Column:
    return F.crc32(column.cast("string")) % 5


def _counts(texts: DataFrame) -> DataFrame:
    """f and n: in how many of the texts each feature is."""

    def run(batches):
        words = _Words(None)
        for batch in batches:
            found = [sorted(text_features(t, words)) for t in batch.column(0).to_pylist()]
            f, n = np.unique(np.concatenate([np.zeros(0, np.int32), *(np.array(x, np.int32) for x in found)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int32)), pa.array(n.astype(np.int64))], names=["f", "n"])

    return texts.mapInArrow(run, "f int, n long").groupBy("f").agg(F.sum("n").alias("n"))


def _rows(texts: DataFrame, chosen: np.ndarray) -> list[np.ndarray]:
    """Of each text the places among the chosen features of those that it has."""
    places = {f: k for k, f in enumerate(chosen.tolist())}

    def run(batches):
        words = _Words(places)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(text_features(t, words)) for t in batch.column(0).to_pylist()], pa.list_(pa.int32()))], names=["f"])

    found = texts.mapInArrow(run, "f array<int>").toArrow().column(0)
    out = []
    for chunk in found.chunks:
        ends, values = chunk.offsets.to_numpy(), chunk.values.to_numpy()
        out += [values[a:b] for a, b in zip(ends, ends[1:])]
    return out


def _sample(rows: DataFrame, n: int) -> DataFrame:
    """The n rows (doc_id, text) with the least hashes, as texts in a table. n longs come to the driver."""
    own, tie = F.xxhash64("doc_id"), F.xxhash64("text")
    h = [r[0] for r in rows.select(own.alias("h")).distinct().orderBy("h").limit(n).collect()]
    some = rows.filter(own <= (h[-1] if h else 0)).select(own.alias("h"), tie.alias("t"), text_or_empty().alias("text"))
    return staged(some.orderBy("h", "t").limit(n).select("text").repartition(32))  # the filter leaves more than n only if ids repeat


def choose(pos: DataFrame, unl: DataFrame, n_pos: int, n_unl: int, prior: float, most: int) -> np.ndarray:
    """The features whose share in P most exceeds the one that the prior leaves for the negative class."""
    counts = pos.filter("n >= 3").withColumnRenamed("n", "p").join(unl.withColumnRenamed("n", "u"), "f", "left")
    share_p = F.col("p") / n_pos
    share_n = F.greatest((F.coalesce("u", F.lit(0)) / n_unl - prior * share_p) / (1 - prior), F.lit(0.0))
    error = F.sqrt((share_p + 1 / n_pos) / n_pos + (share_n + 1 / n_unl) / n_unl)
    good = counts.select("f", share_p.alias("p"), share_n.alias("q"), ((share_p - share_n) / error).alias("z")).filter("z > 2.5 and p > 3 * q")
    return np.sort(np.array([r[0] for r in good.orderBy(F.desc("z"), "f").limit(most).select("f").collect()], dtype=np.int64))


class Risk:
    """The two parts of the risk of weights (the bias last) and their gradients, over all samples."""

    def __init__(self, pos: list[np.ndarray], unl: list[np.ndarray], prior: float, n_features: int):
        self.p, self.u, self.prior, self.n = self._sparse(pos), self._sparse(unl), prior, n_features

    @staticmethod
    def _sparse(docs):
        return np.repeat(np.arange(len(docs)), [len(d) for d in docs]), np.concatenate([np.zeros(0, np.int64), *docs]).astype(np.int64), len(docs)

    def _margin(self, s, w):
        return np.bincount(s[0], weights=w[s[1]], minlength=s[2]) + w[-1]

    def _back(self, s, g):
        return np.append(np.bincount(s[1], weights=g[s[0]], minlength=self.n), g.sum())

    def parts(self, w: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray]:
        """p R_P(+) and its gradient, R_U(-) - p R_P(-) and its gradient."""
        z_p, z_u = self._margin(self.p, w), self._margin(self.u, w)
        s_p, s_u = (1 / (1 + np.exp(-np.clip(z, -40, 40))) for z in (z_p, z_u))
        first = self.prior * np.logaddexp(0, -z_p).mean()
        rest = np.logaddexp(0, z_u).mean() - self.prior * np.logaddexp(0, z_p).mean()
        return first, self.prior * self._back(self.p, (s_p - 1) / self.p[2]), rest, self._back(self.u, s_u / self.u[2]) - self.prior * self._back(self.p, s_p / self.p[2])


def train(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, n_features: int, steps: int = 400, rate: float = 0.05, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk, by Adam over all samples."""
    risk = Risk(pos, unl, prior, n_features)
    w = np.append(np.zeros(n_features), np.log(prior / (1 - prior)))
    decay = np.append(np.full(n_features, l2), 0.0)
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, steps + 1):
        _, g_first, rest, g_rest = risk.parts(w)
        g = (g_first + g_rest if rest >= 0 else -g_rest) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = 4000, max_unlabelled: int = 12_000, max_features: int = 4096) -> tuple[np.ndarray, np.ndarray, float]:
    """Chosen features, their weights and the bias, from the folds other than 0."""
    bounded_batches(docs.sparkSession)
    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(folds(F.col("doc_id")) != 0)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic is not null").filter(folds(F.col("doc_id")) != 0)
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # the prior holds for the documents at hand: labels whose documents are gone don't count
    marks = cut(marks.join(seen.select("doc_id").distinct(), "doc_id", "left_semi"))
    n, toxic = marks.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    if not toxic:
        return np.zeros(0, dtype=np.int64), np.zeros(0), -np.inf
    prior = min(0.95, max(1e-4, toxic / n))
    bound = [r[0] for r in marks.filter("toxic = 1").select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(max_positive).collect()][-1]
    known = marks.filter("toxic = 1").filter(F.xxhash64("doc_id") <= bound).select("doc_id")  # at most max_positive ids
    pos, unl = _sample(seen.join(F.broadcast(known), "doc_id", "left_semi"), max_positive), _sample(seen, max_unlabelled)
    chosen = choose(_counts(pos), _counts(unl), pos.count(), unl.count(), prior, max_features)
    return (chosen, *train(_rows(pos, chosen), _rows(unl, chosen), prior, len(chosen)))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text") -> DataFrame:
    """Adds score and predicted to every row of docs."""
    bounded_batches(docs.sparkSession)
    chosen, weights, bias = model
    weights = weights.tolist()
    kept = [f for f in docs.schema.fields if f.name.lower() not in ("score", "predicted")]
    base = docs.select(*[F.col(f"`{f.name}`") for f in kept], text_or_empty(text).alias("_whole_text"))

    def run(batches):
        words = _Words({f: k for k, f in enumerate(chosen.tolist())})
        for batch in batches:
            at = batch.num_columns - 1
            z = np.array([bias + sum(weights[k] for k in sorted(text_features(t, words))) for t in batch.column(at).to_pylist()])
            s = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            if bias == -np.inf:
                s[:] = 0.0
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(at)), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=[*(f.name for f in kept), "score", "predicted"])

    return base.mapInArrow(run, T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def toxicity(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """doc_id, held_out (fold 0), score, predicted for every document."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, **limits))
    return scored.select("doc_id", F.coalesce(folds(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
