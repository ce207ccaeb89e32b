"""Language identification by averaged hashed subword embeddings.

A text's vector is the mean embedding of its byte 2- to 4-grams (A-Z
lower-cased), hashed into ``buckets``; a linear softmax reads the language from
it. Both are trained together by stochastic gradient descent in numpy, on a
bounded sample of labelled documents. On every fifth sampled document of each
language, kept out of training, the softmax is calibrated by a temperature, and
the score below which a prediction is to be rejected is set.

Every language that occurs is learned. The sample has ``sample_docs`` documents
in all, shared by the languages, but ``least_docs`` of each at least: it and the
model, one row of ``buckets`` numbers a language, grow with nothing else.

As mean and softmax input are linear, a prediction needs only the product of
embeddings and output weights: one row of numbers a bucket.

Defined results: ``und`` with score 0 for a null text or one without any
letter, and for every text where no label can be learned from; ties go to the
first language by code point; repeated rows are predicted alike; with fewer than
five documents of every language nothing is kept out, the temperature is 1 and
nothing is rejected; a ``keep`` column named like a result comes out as
``kept_`` and its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp
from .common import carried, small_batches

UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    buckets: int = 8192
    dims: int = 16
    orders: tuple[int, ...] = (2, 3, 4)
    #: Bound of the sample: so many labelled documents in all, by a seeded hash,
    #: shared by the languages, of which each has so many at least and at most.
    sample_docs: int = 6000
    least_docs: int = 12
    docs_per_language: int = 1200
    epochs: int = 10
    #: Steps at least, by more epochs where the sample is small.
    steps: int = 1000
    batch: int = 32
    rate: float = 0.5
    #: Share of right predictions, of the part kept out, that rejection may cost.
    rejected: float = 0.005
    seed: int = 7


@dataclass
class Model:
    settings: Settings
    languages: list[str] = field(default_factory=list)
    table: np.ndarray | None = None  # buckets x languages: embeddings times output weights
    bias: np.ndarray | None = None
    temperature: float = 1.0
    threshold: float = 0.0

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = (x @ self.table + self.bias) / self.temperature
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(1, keepdims=True)


def features(data: np.ndarray, off: np.ndarray, s: Settings) -> np.ndarray:
    """texts x buckets: shares of the n-grams of each text (all zero if it has none)."""
    lower = np.arange(256, dtype=np.uint32)
    lower[65:91] += 32
    x = lower[data]
    n = len(off) - 1
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(off))
    total = np.zeros(n * s.buckets, np.int64)
    gram = x.copy()
    for order in range(2, max(s.orders) + 1):
        gram = gram[:-1] * np.uint32(0x01000193) + x[order - 1 :] if len(gram) > 1 else gram[:0]
        if order in s.orders and len(gram):
            whole = row[: len(gram)] == row[order - 1 :][: len(gram)]  # none crosses a text's edge
            h = (gram * np.uint32(0x9E3779B1) ^ np.uint32(order * 0x1B873593)) * np.uint32(0xC2B2AE35)
            bucket = (h >> np.uint32(8)) % np.uint32(s.buckets)
            total += np.bincount((row[: len(gram)] * s.buckets + bucket)[whole], minlength=n * s.buckets)
    counts = total.reshape(n, s.buckets).astype(np.float32)
    return counts / np.maximum(counts.sum(1, keepdims=True), 1)


def _batches(column: pa.Array, s: Settings) -> Iterator[tuple[int, int, np.ndarray]]:
    data, off = textnp.buffers(column)
    for i, j, d, o in textnp.pieces(data, off, 1 << 19, 256):
        yield i, j, features(d, o, s)


def _sample(labelled: DataFrame, s: Settings, text: str, lang: str, key: str) -> tuple[list[str], np.ndarray, list, list]:
    """Languages, and of each sampled document its language's number and sparse features."""
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    n = {r["l"]: r["n"] for r in known.groupBy(F.col(lang).alias("l")).agg(F.count("*").alias("n")).collect()}  # one row a language
    languages = sorted(n)
    if not languages:
        return [], np.zeros(0, int), [], []
    each = max(s.least_docs, min(s.docs_per_language, s.sample_docs // len(languages)))
    share = [(k, int(2**62 * min(1.0, each / n[k]))) for k in languages]
    shares = labelled.sparkSession.createDataFrame(share, "__lang string, __share long")
    u = F.shiftrightunsigned(F.xxhash64(F.col(key), F.col(text), F.lit(s.seed)), 2)
    small_batches(labelled.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, val = [], []
            for _, _, x in _batches(b.column("t"), s):
                for r in x:
                    i = np.flatnonzero(r).astype(np.int32)
                    at.append(i.tobytes())
                    val.append(r[i].tobytes())
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("l"), pa.array(at, pa.binary()), pa.array(val, pa.binary())], names=["k", "l", "at", "val"])

    known = known.select(F.xxhash64(F.col(key)).alias("k"), F.col(lang).alias("l"), F.col(text).alias("t"), u.alias("u"))
    picked = known.join(F.broadcast(shares), F.col("l") == F.col("__lang")).where("u < __share").select("k", "l", "t")
    rows = picked.mapInArrow(run, "k long, l string, at binary, val binary")
    got = sorted(rows.collect(), key=lambda r: (r["k"], r["at"]))
    number = {k: i for i, k in enumerate(languages)}
    return languages, np.array([number[r["l"]] for r in got]), [np.frombuffer(r["at"], np.int32) for r in got], [np.frombuffer(r["val"], np.float32) for r in got]


def train(labelled: DataFrame, s: Settings = Settings(), text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Fit on the rows of ``labelled``; ``key`` only seeds the choice of the sample."""
    languages, y, at, val = _sample(labelled, s, text, lang, key)
    model = Model(s, languages)
    if not languages or not len(y):
        return Model(s)
    rng = np.random.default_rng(s.seed)
    k = len(languages)
    emb = rng.normal(0, 1.0, (s.buckets, s.dims)).astype(np.float32)
    out = np.zeros((s.dims, k), np.float32)
    bias = np.zeros(k, np.float32)

    def dense(rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), s.buckets), np.float32)
        for i, r in enumerate(rows):
            x[i, at[r]] = val[r]
        return x

    nth = np.zeros(len(y), np.int64)  # place of each row among its language's
    for i in range(k):
        mine = np.flatnonzero(y == i)
        nth[rng.permutation(mine)] = np.arange(len(mine))
    apart, fit = np.flatnonzero(nth % 5 == 4), np.flatnonzero(nth % 5 != 4)
    per_epoch = -(-len(fit) // s.batch)
    epochs = max(s.epochs, -(-s.steps // per_epoch))
    steps, step = epochs * per_epoch, 0
    n_of = np.bincount(y, minlength=k)
    weight = (len(y) / np.maximum(n_of, 1) / max(1, np.count_nonzero(n_of))).astype(np.float32)
    for _ in range(epochs):
        rng.shuffle(fit)
        for i in range(0, len(fit), s.batch):
            rows = fit[i : i + s.batch]
            rate = np.float32(s.rate * (1 - step / steps))
            step += 1
            x = dense(rows)
            h = x @ emb
            z = h @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= weight[y[rows]][:, None] / len(rows)
            into = p @ out.T
            out -= rate * 10 * (h.T @ p)
            bias -= rate * p.sum(0)
            emb -= rate * 100 * (x.T @ into)
    model.table, model.bias = emb @ out, bias
    if not len(apart):
        return model

    z = np.concatenate([dense(apart[i : i + 256]) @ model.table + bias for i in range(0, len(apart), 256)])
    best = (np.inf, 1.0)
    for t in np.geomspace(0.05, 20, 60):
        q = z / t
        q = q - q.max(1, keepdims=True)
        loss = float(np.mean(np.log(np.exp(q).sum(1)) - q[np.arange(len(q)), y[apart]]))
        best = min(best, (loss, float(t)))
    model.temperature = best[1]
    q = np.exp((z - z.max(1, keepdims=True)) / model.temperature)
    score, pred = (q / q.sum(1, keepdims=True)).max(1), z.argmax(1)
    right = np.sort(score[pred == y[apart]])
    model.threshold = float(right[int(len(right) * s.rejected)]) if len(right) else 1.0
    return model


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred, score (0 to 1) and accepted (the score reaches the calibrated threshold)."""
    small_batches(docs.sparkSession)
    s = model.settings
    own = ["lang_pred", "score", "accepted"]
    into, names, back = carried(keep, own)
    schema = docs.select(*into).schema.add("lang_pred", "string").add("score", "double").add("accepted", "boolean")
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_of = np.array([*model.languages, UNDETERMINED], object)
        for b in batches:
            n = b.num_rows
            pred, score = np.full(n, len(model.languages)), np.zeros(n)
            if model.languages:
                for i, j, x in _batches(b.column("__text"), s):
                    p = model.probabilities(x)
                    pred[i:j], score[i:j] = p.argmax(1), p.max(1)
            none = ~b.column("__letters").to_numpy(zero_copy_only=False)
            pred[none], score[none] = len(model.languages), 0.0
            score = np.clip(score, 0, 1)
            out = [pa.array(names_of[pred], pa.string()), pa.array(score), pa.array((score >= model.threshold) & (pred < len(model.languages)))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *out], names=[*names, *own])

    return docs.select(*into, F.col(text).alias("__text"), letters.alias("__letters")).mapInArrow(run, schema).select(*back, *own)
