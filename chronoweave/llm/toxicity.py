"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of
its hashed words and word beginnings; the document's is their noisy-or, one
minus the product of what the sentences leave over. Only documents have labels:
the gradient of the noisy-or hands each document's label down to the sentences
that explain it, and these are then the ones :func:`locate` finds.

Training runs in numpy on a bounded sample of labelled documents, over the
features that set toxic documents of the sample apart.

Defined results: a null or empty text has no sentence and scores 0; without
any labelled document every score is 0; repeated rows score alike; a ``keep``
column named like a result comes out as ``kept_`` and its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp
from .common import carried, small_batches


@dataclass(frozen=True)
class Settings:
    bits: int = 22
    #: Lengths in bytes of the word beginnings that are features beside the word.
    beginnings: tuple[int, ...] = (4, 5, 6)
    #: Bound of the sample: so many documents of either label, by a seeded hash.
    docs_per_label: int = 2500
    #: A feature has a weight if at least so many documents of the sample hold it
    #: and its shares among toxic and other documents differ by so many standard errors.
    least_docs: int = 3
    least_z: float = 4.5
    epochs: int = 20
    #: Steps at least, by more epochs where the sample is small.
    steps: int = 3000
    batch: int = 32
    rate: float = 0.3
    decay: float = 1e-4
    start_bias: float = -6.0
    seed: int = 11


@dataclass
class Model:
    settings: Settings
    ids: np.ndarray | None = None  # the features that have weights
    values: np.ndarray | None = None
    bias: float = 0.0

    def table(self) -> np.ndarray | None:
        """Weights by feature; None without a model."""
        if self.ids is None:
            return None
        w = np.zeros(1 << self.settings.bits, np.float32)
        w[self.ids] = self.values
        return w


def _separators() -> tuple[np.ndarray, np.ndarray]:
    """(bytes outside words, bytes that end a sentence); words: ASCII letters, digits, non-ASCII."""
    b = np.arange(256)
    inside = (b >= 128) | ((b >= 48) & (b <= 57)) | ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122))
    return ~inside, np.isin(b, [ord(c) for c in ".!?\n"])


@dataclass
class Bags:
    """Features of a run of texts: ids by sentence, sentences by text."""

    ids: np.ndarray  # features, a sentence's together
    per_sentence: np.ndarray  # features before each sentence
    per_text: np.ndarray  # sentences before each text
    start: np.ndarray  # byte at which a sentence's first word begins, in the run
    end: np.ndarray  # byte past its last word


def bags(data: np.ndarray, off: np.ndarray, s: Settings) -> Bags:
    outside, stops = _separators()
    a, e, first = textnp.word_spans(data, off, outside)
    c = textnp.prefix_sums(data, textnp.tables()[2])
    stop = np.cumsum(stops[data])
    text = textnp.owners(first)
    # words of one sentence: same text, no stop between
    mark = stop[a] if len(a) else np.zeros(0, np.int64)
    fresh = np.ones(len(a), bool)
    fresh[1:] = (mark[1:] != mark[:-1]) | (text[1:] != text[:-1])
    sentence = np.cumsum(fresh) - 1
    heads = np.flatnonzero(fresh)
    n = len(heads)
    shift = np.uint64(64 - s.bits)
    ids = [(textnp.span_hash(c, a, e) >> shift)]
    own = [sentence]
    for k in s.beginnings:
        long = np.flatnonzero(e - a >= k)
        ids.append((textnp.span_hash(c, a[long], a[long] + k) ^ np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) >> shift)
        own.append(sentence[long])
    flat, owner = np.concatenate(ids).astype(np.int32), np.concatenate(own)
    order = np.argsort(owner, kind="stable")
    per_sentence = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
    per_text = np.searchsorted(text[heads], np.arange(len(off)))
    tails = np.concatenate([heads[1:] - 1, [len(a) - 1]]) if n else heads
    return Bags(flat[order], per_sentence, per_text, a[heads], e[tails])


def _sums(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return c[before[1:]] - c[before[:-1]]


def sentence_scores(b: Bags, table: np.ndarray, bias: float) -> np.ndarray:
    z = _sums(table[b.ids], b.per_sentence) + bias
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def document_scores(p: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Noisy-or of each text's sentences."""
    return -np.expm1(_sums(np.log1p(-np.minimum(p, 1 - 1e-12)), per_text))


def _sample(docs: DataFrame, labels: DataFrame, s: Settings, text: str, label: str, key: str) -> list:
    """(label, features by sentence) of a bounded number of labelled documents, in a fixed order."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.col(label).cast("int").alias("y"))
    n = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    u = F.shiftrightunsigned(F.xxhash64(F.col("__key"), F.lit(s.seed)), 2)
    wanted = F.lit(False)
    for k, c in n.items():
        wanted = wanted | ((F.col("y") == k) & (u < int(2**62 * min(1.0, s.docs_per_label / c))))
    # about docs_per_label ids of either label; the limit proves the bound of what is broadcast
    few = known.where(wanted).limit(4 * s.docs_per_label)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = textnp.buffers(b.column("t"))
            ids, per = [], []
            for _, _, d, o in textnp.pieces(data, off):
                x = bags(d, o, s)
                for i, j in zip(x.per_text[:-1], x.per_text[1:], strict=True):
                    ids.append(x.ids[x.per_sentence[i] : x.per_sentence[j]].tobytes())
                    per.append(np.diff(x.per_sentence[i : j + 1]).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("y"), pa.array(ids, pa.binary()), pa.array(per, pa.binary())], names=["k", "y", "ids", "per"])

    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("__id"), F.col(text).alias("t"))
    rows = texts.join(F.broadcast(few), F.col("__id") == F.col("__key")).select(F.xxhash64("__key").alias("k"), "y", "t")
    got = rows.mapInArrow(run, "k long, y int, ids binary, per binary").collect()
    got.sort(key=lambda r: (r["k"], r["y"], r["ids"]))
    return [(r["y"], np.frombuffer(r["ids"], np.int32), np.frombuffer(r["per"], np.int32)) for r in got]


def _narrow(row: tuple, place: np.ndarray) -> tuple:
    """The row with its chosen features only, numbered by ``place``."""
    y, ids, lens = row
    at = place[ids]
    own = np.repeat(np.arange(len(lens)), lens)
    return y, at[at >= 0], np.bincount(own[at >= 0], minlength=len(lens))


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), text: str = "text", label: str = "toxic", key: str = "doc_id") -> Model:
    """Fit on the texts of ``docs`` that ``labels`` (``key``, ``label`` 0 or 1) marks."""
    rows = [r for r in _sample(docs, labels, s, text, label, key) if len(r[1])]
    model = Model(s)
    if not rows:
        return model
    held = np.zeros((2, 1 << s.bits))
    total = np.array([sum(r[0] == k for r in rows) for k in (0, 1)], float)
    for y, ids, _ in rows:
        held[y, np.unique(ids)] += 1
    n0, n1 = np.maximum(total, 1)
    both = held.sum(0) / (n0 + n1)
    z = (held[1] / n1 - held[0] / n0) / np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n0 + 1 / n1))
    chosen = np.flatnonzero((held.sum(0) >= s.least_docs) & (np.abs(z) >= s.least_z))
    place = np.full(1 << s.bits, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    rows = [_narrow(r, place) for r in rows]
    size = len(chosen)
    w, b = np.zeros(size), s.start_bias
    seen, seen_b = np.full(size, 1e-2), 1e-2
    rng = np.random.default_rng(s.seed)
    for _ in range(max(s.epochs, -(-s.steps * s.batch // len(rows)))):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), s.batch):
            part = [rows[k] for k in order[i : i + s.batch]]
            y = np.array([r[0] for r in part])
            ids = np.concatenate([r[1] for r in part])
            lens = np.concatenate([r[2] for r in part])
            before = np.concatenate([[0], np.cumsum(lens)])
            per_text = np.concatenate([[0], np.cumsum([len(r[2]) for r in part])])
            p = 1 / (1 + np.exp(-np.clip(_sums(w[ids], before) + b, -40, 40)))
            whole = np.clip(document_scores(p, per_text), 1e-9, 1 - 1e-9)
            hand_down = np.where(y == 1, -(1 - whole) / whole, 1.0)
            g = np.repeat(hand_down, np.diff(per_text)) * p
            touched = np.bincount(ids, np.repeat(g, lens), size) / len(part)
            at = np.flatnonzero(touched)
            step = touched[at] + s.decay * w[at]
            seen[at] += step**2
            w[at] -= s.rate * step / np.sqrt(seen[at])
            gb = g.sum() / len(part)
            seen_b += gb**2
            b -= s.rate * gb / np.sqrt(seen_b)
    model.ids, model.values, model.bias = chosen.astype(np.int32), w.astype(np.float32), float(b)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.5) -> DataFrame:
    """``keep``, score, predicted (1 from ``threshold`` on), n_sentences and n_offending."""
    small_batches(docs.sparkSession)
    own = ["score", "predicted", "n_sentences", "n_offending"]
    into, names, back = carried(keep, own)
    schema = docs.select(*into).schema.add("score", "double").add("predicted", "integer").add("n_sentences", "long").add("n_offending", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for b in batches:
            n = b.num_rows
            got, sentences, bad = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
            if table is not None:
                data, off = textnp.buffers(b.column("__text"))
                for i, j, d, o in textnp.pieces(data, off):
                    x = bags(d, o, model.settings)
                    p = sentence_scores(x, table, model.bias)
                    got[i:j] = document_scores(p, x.per_text)
                    sentences[i:j] = np.diff(x.per_text)
                    bad[i:j] = _sums(p >= threshold, x.per_text)
            got = np.clip(got, 0, 1)
            out = [pa.array(got), pa.array((got >= threshold).astype(np.int32)), pa.array(sentences), pa.array(bad)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *out], names=[*names, *own])

    return docs.select(*into, F.col(text).alias("__text")).mapInArrow(run, schema).select(*back, *own)


def locate(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.5) -> DataFrame:
    """One row an offending sentence: ``keep``, sentence (number), start and end (bytes), score, text."""
    small_batches(docs.sparkSession)
    kinds = {"sentence": "long", "start": "long", "end": "long", "score": "double", "sentence_text": "string"}
    into, names, back = carried(keep, list(kinds))
    schema = docs.select(*into).schema
    for name, kind in kinds.items():
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for b in batches:
            if table is None:
                continue
            data, off = textnp.buffers(b.column("__text"))
            for i, _, d, o in textnp.pieces(data, off):
                x = bags(d, o, model.settings)
                p = sentence_scores(x, table, model.bias)
                hit = np.flatnonzero(p >= threshold)
                own = np.searchsorted(x.per_text, hit, "right") - 1
                spans = [bytes(d[u:v]).decode("utf-8", "replace") for u, v in zip(x.start[hit], x.end[hit], strict=True)]
                out = [pa.array(hit - x.per_text[own]), pa.array(x.start[hit] - o[own]), pa.array(x.end[hit] - o[own]), pa.array(p[hit]), pa.array(spans, pa.string())]
                rows = [b.column(c).take(pa.array(own + i)) for c in names]
                yield pa.RecordBatch.from_arrays([*rows, *out], names=[f.name for f in schema])

    return docs.select(*into, F.col(text).alias("__text")).mapInArrow(run, schema).select(*back, *kinds)
