"""Scoring texts by an n-gram model kept as Elias-Fano tries.

The model interpolates words, pairs and triples of whitespace words (A-Z
lower-cased) and an end token by absolute discounting. An n-gram seen c times
after a context seen C times has (c - D) / C; what its context's n-grams were
discounted, D times their number over C, goes to the next lower order. Below the
words, the mass is spread evenly over an explicit open vocabulary: the words of
the training texts and as many unseen ones and one more (``open_words``), so
that an unseen word always scores below any word seen. The first word of a text
has no pair before it, and the second has the text's start before its pair.
Probabilities are quantised downwards, in two bytes for words and one for pairs
and triples, so that over the open vocabulary they sum to 1 at most.

Every word of a text but the end token is the middle v of just one triple
(u, v, w). So triples dealt by v bring everything together: the count of v, the
pairs (v, w), the triples and the pairs (u, v) as contexts. Blocks of documents
travel as rows; a block's distinct triples go, packed, to the shard of v, which
builds a trie of all counts, memory-mapped from its compact form, and answers
from it, in the order in which the block asked. Shards are asked, and blocks
scored, in ``rounds`` parts, so that the shuffle files of one part are gone
before the next begins.

No word is too frequent for a shard: a hot word's triples are dealt by (v, u),
those of a hot pair (u, v) by the triple, and a hot word's pairs by the pair,
after equal ones met in their block. What shards know of hot contexts, counts
and numbers of successors, is summed over all of them. The hot words and pairs,
2^19 of either at most whatever the corpus, are all that the driver collects.

A block gives one row a shard at most, and a row for each of its distinct words
at most; shards are as many as the measured number of tokens asks for.

Defined results: a null or empty text is one end token; repeated rows count and
score each; ids may be null or repeat; without training documents the open
vocabulary is one word, and all scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnp
from .common import drop_table, own_batches, packed, q, release, shuffle_parts, small_batches, table, unpacked
from .eliasfano import NEAR, Trie, _starts

U64 = np.uint64
END = U64(0x454E44)  # stands for the end token among word hashes
START = U64(0x5354415254)  # stands before the first word, as u of a triple alone
#: Steps of the quantised log10 probabilities: a byte spans nine decades, two bytes twenty.
STEP = 9.0 / 254
FINE = 20.0 / 65534
#: Kinds of what a block asks a shard for.
PAIR, TRIPLE = 2, 3


@dataclass(frozen=True)
class Settings:
    #: What is discounted of the counts of words, pairs and triples.
    discounts: tuple[float, float, float] = (0.75, 0.75, 0.9)
    #: Unseen words in the open vocabulary, for each word of the training texts and once more.
    open_words: float = 1.0
    block_bytes: int = 5 << 20
    #: Tokens of a shard, on average.
    shard_tokens: int = 1 << 20
    rounds: int = 3


def quantise(p: np.ndarray, step: float = STEP, top: int = 255) -> np.ndarray:
    """Codes 1 to ``top`` (certainty) of probabilities, rounded down; 0, no probability at all, below the lowest step."""
    with np.errstate(divide="ignore"):
        code = top + np.floor(np.log10(np.minimum(p, 1.0)) / step + 1e-9)
    return np.where(code >= 1, code, 0).astype(np.int64)


def dequantise(code: np.ndarray, step: float = STEP, top: int = 255) -> np.ndarray:
    return np.where(code > 0, 10.0 ** ((code.astype(np.float64) - top) * step), 0.0)


# -- what a block holds ------------------------------------------------------------

TEXTS = "block long, n_words int, words binary, n_docs int, ids binary, known binary, held binary, per_doc binary, n_tokens long, tokens binary, n_train long, n_train_docs long"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
_TEXTS = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in TEXTS.split(", ")])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _with_ends(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end token after each text; tokens before each text."""
    n = np.diff(first)
    before = first + np.arange(len(first))
    out = np.full(before[-1], END, U64)
    out[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
    return out, before


def _blocks(docs: DataFrame, s: Settings) -> DataFrame:
    """Rows of a block's distinct words (sorted hashes) and its tokens as places among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        held: list[tuple] = []
        size = 0

        def block() -> pa.RecordBatch:
            tokens, ids, known, out, per = (np.concatenate(x) for x in zip(*held, strict=True))
            words, local = np.unique(tokens, return_inverse=True)
            # sorted hashes: their differences, a plane of bytes at a time, leave the upper planes nearly empty
            steps = np.diff(words, prepend=U64(0)).view(np.uint8).reshape(-1, 8).T.copy()
            row = (number, len(words), packed(steps), len(ids), ids.tobytes(), known.tobytes(), out.tobytes(), per.astype(np.int64).tobytes(), len(tokens), packed(local.astype(np.int32)), int(per[~out].sum()), int((~out).sum()))
            return _batch([row], _TEXTS)

        for b in batches:
            data, off = textnp.buffers(b.column("__text"))
            ids = b.column("doc").fill_null(0).to_numpy()
            known = b.column("doc").is_valid().to_numpy(zero_copy_only=False)
            out = b.column("held").to_numpy(zero_copy_only=False)
            for i, j, d, o in textnp.pieces(data, off):
                t, before = _with_ends(*textnp.words(d, o))
                held.append((t, ids[i:j], known[i:j], out[i:j], np.diff(before)))
                size += len(d)
                if size >= s.block_bytes:
                    yield block()
                    number, size = number + 1, 0
                    held.clear()
        if held:
            yield block()

    return docs.mapInArrow(run, TEXTS)


@dataclass(frozen=True)
class Hot:
    """Frequent words and pairs (u, v), sorted by hash; what was seen of them is near their counts and the same everywhere."""

    words: np.ndarray
    words_seen: np.ndarray
    pairs: np.ndarray
    pairs_seen: np.ndarray

    @staticmethod
    def place(of: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The place of each x in the sorted ``of``, -1 where it is not."""
        i = np.minimum(np.searchsorted(of, x), max(0, len(of) - 1))
        return np.where(of[i] == x, i, -1) if len(of) else np.full(len(x), -1)


def pair_key(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return textnp.mix(u * U64(0x9E3779B97F4A7C15) + v)


class Block:
    """A block's triples."""

    def __init__(self, r: dict):
        self.words = np.cumsum(np.frombuffer(unpacked(r["words"], 8 * r["n_words"], np.uint8).reshape(8, -1).T.tobytes(), U64), dtype=U64)
        self.tokens = unpacked(r["tokens"], r["n_tokens"], np.int32).astype(np.int64)
        self.per = np.frombuffer(r["per_doc"], np.int64)
        self.before = np.concatenate([[0], np.cumsum(self.per)])
        self.doc = textnp.owners(self.before)
        self.out = np.frombuffer(r["held"], bool)
        last = np.zeros(len(self.tokens), bool)
        last[self.before[1:] - 1] = True
        self.middle = np.flatnonzero(~last)
        first = np.zeros(len(self.tokens), bool)
        first[self.before[:-1]] = True
        # the start of a text goes by the place past the last word
        self.u = np.where(first[self.middle], len(self.words), self.tokens[np.maximum(self.middle - 1, 0)])
        self.v, self.w = self.tokens[self.middle], self.tokens[self.middle + 1]
        self.train = ~self.out[self.doc[self.middle]]

    def hashes(self, i: np.ndarray) -> np.ndarray:
        return np.append(self.words, START)[i]

    def distinct(self, *columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """(the distinct rows of columns of places, sorted; which one each row is)."""
        bits = (len(self.words) + 1).bit_length()
        if bits * len(columns) <= 63:
            key = np.zeros(len(columns[0]), np.int64)
            for c in columns:
                key = key << bits | c
            key, which = np.unique(key, return_inverse=True)
            return [key >> bits * k & (1 << bits) - 1 for k in reversed(range(len(columns)))], which
        order = np.lexsort(columns[::-1])
        ranked = [c[order] for c in columns]
        new = _starts(*ranked)
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        return [c[new] for c in ranked], which

    def asked(self, hot: Hot, shards: int, part: int, parts: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """What the block asks the shards of one part.

        (v, u, w, shard, number in training texts) of the distinct triples by
        shard, v, u and w; the middles whose triples these are; which one each is.
        """
        by = textnp.mix(self.words.copy())[self.v]
        m = np.flatnonzero((Hot.place(hot.words, self.words) >= 0)[self.v]) if len(hot.words) else []
        if len(m):
            hv = self.words[self.v[m]]
            pair = pair_key(self.hashes(self.u[m]), hv)
            by[m] = textnp.mix(np.where(Hot.place(hot.pairs, pair) >= 0, pair_key(self.words[self.w[m]], pair), pair))
        return self._dealt(np.arange(len(self.v)), by, self.u, shards, part, parts)

    def asked_pairs(self, hot: Hot, shards: int, part: int, parts: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """The same of the pairs (v, w) of hot words v."""
        at = np.flatnonzero((Hot.place(hot.words, self.words) >= 0)[self.v])
        by = pair_key(self.words[self.w[at]], self.words[self.v[at]])
        return self._dealt(at, by, None, shards, part, parts)

    def _dealt(self, at: np.ndarray, by: np.ndarray, u: np.ndarray | None, shards: int, part: int, parts: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        shard = (by % U64(shards)).astype(np.int64)
        mine = np.flatnonzero(shard % parts == part)
        at, shard = at[mine], shard[mine]
        got, which = self.distinct(self.v[at], *([u[at]] if u is not None else []), self.w[at])
        of = np.empty(len(got[0]), np.int64)
        of[which] = shard
        n = np.bincount(which, self.train[at], len(of)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        v, w = got[0][order], got[-1][order]
        return [v, got[1][order] if u is not None else v, w, of[order], n[order]], at, back[which]


def _near(h: np.ndarray) -> np.ndarray:
    """The bits of hashes by which words are told among the neighbours of a word."""
    return h >> U64(64 - NEAR)


def _narrow(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : NEAR // 8].tobytes()


def _wide(b: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, : NEAR // 8] = np.frombuffer(b, np.uint8).reshape(n, NEAR // 8)
    return out.reshape(-1).view("<u8").astype(U64)


# -- hot words and pairs -------------------------------------------------------------


def _often(cutoff: int, words: np.ndarray | None):
    """Blocks -> (key, number) of what is frequent in a block's training texts: words, or pairs of the hot ``words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                x = Block(r)
                if words is None:
                    n, key = np.bincount(x.v, x.train, len(x.words)).astype(np.int64), x.words
                else:
                    hot = np.append(Hot.place(words, x.words) >= 0, True)
                    at = np.flatnonzero(hot[x.u] & hot[x.v] & x.train)
                    key, n = np.unique(pair_key(x.hashes(x.u[at]), x.hashes(x.v[at])), return_counts=True)
                m = n >= cutoff
                yield pa.RecordBatch.from_arrays([pa.array(key[m].view(np.int64)), pa.array(n[m].astype(np.int64))], names=["key", "n"])

    return run


def _hot(texts: DataFrame, tokens: int, n: int, blocks: int, shards: int, s: Settings) -> Hot:
    """Words and pairs with more tokens than half of a shard's, all of a shard's in any case; blocks report what could sum up to that."""
    least = max(2, min(s.shard_tokens, -(-tokens // shards)), n >> 18)
    cutoff = max(1, least // (2 * max(1, blocks)))

    def found(words: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        often = texts.mapInArrow(_often(cutoff, words), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        rows = often.where(F.col("n") > least // 2).collect()  # 2 n / least <= 2^19 rows
        key, count = np.array([r["key"] for r in rows], np.int64).view(U64), np.array([r["n"] for r in rows], np.int64)
        order = np.argsort(key)
        return key[order], count[order]

    none = np.zeros(0, U64)
    if n <= least // 2:
        return Hot(none, none.astype(np.int64), none, none.astype(np.int64))
    words, words_seen = found(None)
    return Hot(words, words_seen, *(found(words) if len(words) else (none, none.astype(np.int64))))


# -- asking the shards ----------------------------------------------------------------

ASKED = "block long, shard int, kind int, n int, n_v int, v binary, runs binary, u binary, w binary, train binary"
_ASKED = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in ASKED.split(", ")])
ANSWERED = "block long, shard int, kind int, n int, n_v int, codes binary, more binary, shares binary, counts binary, nexts binary"
_ANSWERED = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in ANSWERED.split(", ")])
#: Blocks that stand for a shard's own rows: its trie, its number of words, its part of the hot words and pairs.
MODEL, WORDS, HOT_WORDS, HOT_PAIRS = -1, -2, -3, -4


def _asked(hot: Hot, shards: int, part: int, parts: int):
    """Blocks -> their distinct triples, and pairs of hot words, packed by shard; those shards whose number falls to ``part``."""

    def rows(block: int, kind: int, x: Block, got: list[np.ndarray]) -> Iterator[tuple]:
        v, u, w, shard, n = got
        if not len(v):
            return
        edge = np.flatnonzero(np.concatenate([_starts(shard), [True]]))
        for a, z in zip(edge[:-1], edge[1:], strict=True):
            first = np.flatnonzero(_starts(v[a:z]))
            runs = np.diff(np.concatenate([first, [z - a]])).astype(np.int32)
            yield (
                block, int(shard[a]), kind, int(z - a), len(first), x.words[v[a:z][first]].tobytes(), packed(runs),
                _narrow(_near(x.hashes(u[a:z]))) if kind == TRIPLE else None, _narrow(_near(x.words[w[a:z]])), packed(n[a:z].astype(np.int32)),
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                r = b.slice(at, 1).to_pylist()[0]
                x = Block(r)
                out = list(rows(r["block"], TRIPLE, x, x.asked(hot, shards, part, parts)[0]))
                if len(hot.words):
                    out += rows(r["block"], PAIR, x, x.asked_pairs(hot, shards, part, parts)[0])
                yield _batch(out, _ASKED)

    return run


def _summed(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the columns, sorted, and the sums of ``n`` over each."""
    order = np.lexsort(columns[::-1])
    ranked = [c[order] for c in columns]
    new = _starts(*ranked)
    return [c[new] for c in ranked], np.bincount(np.cumsum(new) - 1, n[order], int(new.sum())).astype(np.int64) if len(n) else n[order]


def _model(v: np.ndarray, u: np.ndarray, w: np.ndarray, train: np.ndarray, triple: np.ndarray, hot: Hot, n: int, s: Settings) -> tuple[Trie, np.ndarray, list[tuple]]:
    """(a shard's trie, the counts of its words, rows of its words' number and its parts of hot contexts)."""
    m = (train > 0) & triple
    (v3, u3, w3), n3 = _summed([v[m], u[m], w[m]], train[m])
    m = (train > 0) & ~triple
    (v2, w2), n2 = _summed([v[m], w[m]], train[m])
    # pairs of words that are not hot come from their triples; of hot ones those
    # that only triples have here get a place but no probability
    often = Hot.place(hot.words, v3) >= 0
    (va, wa), na = _summed([np.concatenate([v3, v2]), np.concatenate([w3, w2])], np.concatenate([np.where(often, 0, n3), n2]))
    words, at = np.unique(va, return_inverse=True)
    count = np.bincount(at, na, len(words)).astype(np.int64)
    hot_word = Hot.place(hot.words, words)
    d1, d2, d3 = s.discounts
    codes1 = np.where(hot_word < 0, quantise((count - d1) / max(n, 1), FINE, 65535), 0)
    # a hot context's count is summed up only later: what was seen of it stands in
    size = np.where(hot_word >= 0, hot.words_seen[np.maximum(hot_word, 0)] if len(hot.words) else 1, np.maximum(count, 1))
    codes2 = np.where(na > 0, quantise(np.maximum(na - d2, 1e-300) / size[at]), 0)
    new = _starts(v3, u3) if len(v3) else np.zeros(0, bool)
    pair = np.cumsum(new) - 1
    c_pair = np.bincount(pair, n3, int(new.sum())).astype(np.int64)
    wide = np.bincount(pair, minlength=int(new.sum()))
    place = np.full(len(c_pair), -1)
    if len(hot.pairs):
        seen_u = _near(np.append(hot.words, START))  # hot pairs are of hot words, which stand apart by their first bits
        by_u = np.argsort(seen_u)
        i = Hot.place(seen_u[by_u], u3[new])
        whole = np.append(hot.words, START)[by_u][np.maximum(i, 0)]
        place = np.where(i >= 0, Hot.place(hot.pairs, pair_key(whole, v3[new])), -1)
    size = np.where(place >= 0, hot.pairs_seen[np.maximum(place, 0)] if len(hot.pairs) else 1, np.maximum(c_pair, 1))
    codes3 = quantise(np.maximum(n3 - d3, 1e-300) / size[pair]) if len(pair) else pair
    share = np.where(place >= 0, 255, np.minimum(quantise(d3 * wide / np.maximum(c_pair, 1)), 254))
    trie = Trie.build(words, codes1, (at, wa, codes2), (np.searchsorted(words, v3), u3, w3, codes3, share[pair] if len(pair) else pair))
    more = [(WORDS, 0, 0, int(((count > 0) & (hot_word < 0)).sum()), 0, *[None] * 5)]
    for kind, mine, total, number in ((HOT_WORDS, hot_word, count, np.bincount(at, na > 0, len(words))), (HOT_PAIRS, place, c_pair, wide)):
        i = np.flatnonzero(mine >= 0)
        if len(i):
            more.append((kind, 0, 0, len(i), 0, packed(mine[i].astype(np.int64)), None, None, packed(total[i].astype(np.int64)), packed(number[i].astype(np.int64))))
    return trie, count, more


def _answered(hot: Hot, n: int, s: Settings, keep_model: bool):
    """What all blocks asked a shard -> their answers; its trie if wanted."""

    def run(t: pa.Table) -> pa.Table:
        rows = t.drop_columns(["v", "runs", "u", "w", "train"]).to_pylist()
        bounds = np.concatenate([[0], np.cumsum(t.column("n").to_numpy())])
        bounds_v = np.concatenate([[0], np.cumsum(t.column("n_v").to_numpy())])
        own = np.frombuffer(b"".join(t.column("v").to_pylist()), U64)
        runs = np.concatenate([unpacked(b, k, np.int32) for b, k in zip(t.column("runs").to_pylist(), t.column("n_v").to_pylist(), strict=True)])
        v = np.repeat(own, runs)
        w = np.concatenate([_wide(b, k) for b, k in zip(t.column("w").to_pylist(), t.column("n").to_pylist(), strict=True)])
        u = np.concatenate([np.zeros(k, U64) if b is None else _wide(b, k) for b, k in zip(t.column("u").to_pylist(), t.column("n").to_pylist(), strict=True)])
        train = np.concatenate([unpacked(b, k, np.int32) for b, k in zip(t.column("train").to_pylist(), t.column("n").to_pylist(), strict=True)])
        kind = np.repeat(t.column("kind").to_numpy(), t.column("n").to_numpy())
        built, count, more = _model(v, u, w, train, kind == TRIPLE, hot, n, s)
        blob = built.to_bytes()
        del built, train
        trie = Trie.mapped(blob)
        out = [(MODEL, 0, 0, 0, 0, blob, None, None, None, None)] if keep_model else []
        out += more
        at, known = trie.find(own)
        counts = np.where(known, count[np.minimum(at, len(count) - 1)], 0) if len(count) else np.zeros(len(own), np.int64)
        nexts = trie.number_next(at, known).astype(np.int32)
        at, known = np.repeat(at, runs), np.repeat(known, runs)
        code2, place = trie.pairs(at, known, w)
        code3, share = trie.triples(at, known, u, place)
        for i, r in enumerate(rows):
            a, z, av, zv = bounds[i], bounds[i + 1], bounds_v[i], bounds_v[i + 1]
            if r["kind"] == TRIPLE:
                out.append((r["block"], r["shard"], TRIPLE, r["n"], r["n_v"], packed(code3[a:z]), packed(code2[a:z]), packed(share[a:z]), packed(counts[av:zv]), packed(nexts[av:zv])))
            else:
                out.append((r["block"], r["shard"], PAIR, r["n"], r["n_v"], packed(code2[a:z]), None, None, None, None))
        shard = rows[0]["shard"]
        return pa.Table.from_batches([_batch([(x[0], shard, *x[2:]) if x[0] < 0 else x for x in out], _ANSWERED)])

    return run


# -- scoring ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Totals:
    """What the shards know together: tokens and words of the training texts, and hot contexts with counts and numbers of successors."""

    n: int
    v: int
    ends: int
    word_count: np.ndarray
    word_next: np.ndarray
    pair_count: np.ndarray
    pair_next: np.ndarray


def unigram(count: np.ndarray, n: int, v: int, s: Settings) -> np.ndarray:
    """Probabilities of words by their counts, those of the open vocabulary's unseen words included."""
    if not n:
        return np.ones(len(count))
    unseen = s.discounts[0] * v / n / (v + s.open_words * (v + 1))
    return dequantise(quantise(np.maximum(count - s.discounts[0], 1e-300) / n, FINE, 65535), FINE, 65535) * (count > 0) + unseen


def _scored(hot: Hot, shards: int, t: Totals, s: Settings):
    d2, d3 = s.discounts[1:]

    def ordered(parts: list[dict], kind: int, column: str, number: str, dtype: type) -> np.ndarray:
        got = [unpacked(p[column], p[number], dtype) for p in parts if p["kind"] == kind]
        return np.concatenate(got) if got else np.zeros(0, dtype)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        for b in batches:
            for at in range(b.num_rows):
                r = b.slice(at, 1).to_pylist()[0]
                x = Block(r)
                answers = sorted(r["answers"] or [], key=lambda p: p["shard"])
                count, nexts = np.zeros(len(x.words), np.int64), np.zeros(len(x.words), np.int64)
                often = Hot.place(hot.words, x.words)
                p3, p2, share = (np.zeros(len(x.v)) for _ in range(3))
                for part in range(s.rounds):
                    parts = [p for p in answers if p["shard"] % s.rounds == part]
                    (v, u, w, shard, _), there, which = x.asked(hot, shards, part, s.rounds)
                    code3, code2 = ordered(parts, TRIPLE, "codes", "n", np.uint8), ordered(parts, TRIPLE, "more", "n", np.uint8)
                    if len(code3) != len(v):
                        raise ValueError("a shard's answer is missing")
                    three, left = dequantise(code3), dequantise(ordered(parts, TRIPLE, "shares", "n", np.uint8))
                    # counts of words that are not hot, each from its one shard
                    first = _starts(shard, v) if len(v) else np.zeros(0, bool)
                    count[v[first]], nexts[v[first]] = ordered(parts, TRIPLE, "counts", "n_v", np.int64), ordered(parts, TRIPLE, "nexts", "n_v", np.int32)
                    if len(hot.pairs):
                        pair = Hot.place(hot.pairs, pair_key(x.hashes(u), x.words[v]))
                        m = pair >= 0
                        c = np.maximum(t.pair_count[pair[m]], 1)
                        three[m] *= np.minimum(1.0, hot.pairs_seen[pair[m]] / c)
                        left[m] = np.where(t.pair_count[pair[m]] > 0, np.minimum(1.0, d3 * t.pair_next[pair[m]] / c), 1.0)
                    p3[there], p2[there], share[there] = three[which], dequantise(code2)[which], left[which]
                m = often >= 0
                count[m], nexts[m] = t.word_count[often[m]], t.word_next[often[m]]
                count[x.words == END] = t.ends
                for part in range(s.rounds if len(hot.words) else 0):
                    parts = [p for p in answers if p["shard"] % s.rounds == part]
                    (v, *_), there, which = x.asked_pairs(hot, shards, part, s.rounds)
                    got = ordered(parts, PAIR, "codes", "n", np.uint8)
                    if len(got) != len(v):
                        raise ValueError("a shard's answer is missing")
                    p2[there] = dequantise(got)[which] * np.minimum(1.0, hot.words_seen[often[x.v[there]]] / np.maximum(count[x.v[there]], 1))
                low = unigram(count, t.n, t.v, s)
                p = low[x.tokens]
                c = np.maximum(count, 1)
                left = np.where(count > 0, np.minimum(1.0, d2 * nexts / c), 1.0)
                p[x.middle + 1] = np.minimum(1.0, p3 + share * (p2 + left[x.v] * p[x.middle + 1]))
                base = np.log10((count + 1) / (t.n + t.v + 1))[x.tokens]
                sums = [np.add.reduceat(a, x.before[:-1]) for a in (base, np.log10(p), (count > 0).astype(np.int64)[x.tokens])]
                ids, known = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["known"], bool)
                cols = [pa.array(ids, pa.int64(), mask=~known), pa.array(x.out), pa.array(x.per), pa.array(sums[2]), pa.array(np.full(len(ids), t.n)), pa.array(sums[0]), pa.array(sums[1])]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def score(docs: DataFrame, held_out: Column, s: Settings = Settings(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from all rows that ``held_out`` does not mark, and scores all.
    """
    return _score(docs, held_out, s, text, doc_id, False)[0]


def train_and_score(docs: DataFrame, held_out: Column, s: Settings = Settings(), text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The scores, and the model: one trie (shard, trie binary) a shard, as a table in the shared folder."""
    return _score(docs, held_out, s, text, doc_id, True)


def _hot_sums(spark: SparkSession, answers: DataFrame, kind: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and numbers of successors of the ``n`` hot words or pairs, over all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(unpacked(r[c], r["n"], np.int64)) for c in ("codes", "counts", "nexts")], names=["i", "c", "k"])

    count, nexts = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n:
        parts = answers.where(F.col("block") == kind).select("n", "codes", "counts", "nexts").mapInArrow(run, "i long, c long, k long")
        for r in parts.groupBy("i").agg(F.sum("c").alias("c"), F.sum("k").alias("k")).collect():  # n rows at most
            count[r["i"]], nexts[r["i"]] = r["c"], r["k"]
    return count, nexts


def _score(docs: DataFrame, held_out: Column, s: Settings, text: str, doc_id: str, keep_model: bool) -> tuple[DataFrame, DataFrame | None]:
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(q(doc_id).cast("long").alias("doc"), F.coalesce(held_out, F.lit(False)).alias("held"), q(text).cast("string").alias("__text"))
    texts, texts_path = table(spark, _blocks(rows, s))
    small_batches(spark, 2)  # blocks of some MB
    sums = texts.agg(F.count("*").alias("blocks"), F.sum("n_tokens").alias("tokens"), F.sum("n_train").alias("n"), F.sum("n_train_docs").alias("ends")).first()
    n, ends, tokens = sums["n"] or 0, sums["ends"] or 0, sums["tokens"] or 0
    shards = int(max(2 * shuffle_parts(spark), -(-tokens // s.shard_tokens)))
    hot = _hot(texts, tokens, n, sums["blocks"], shards, s)
    answers, paths = None, []
    for part in range(s.rounds):
        asked = texts.mapInArrow(_asked(hot, shards, part, s.rounds), ASKED).groupBy("shard")
        got, path = table(spark, asked.applyInArrow(_answered(hot, n, s, keep_model), ANSWERED))
        answers = got if answers is None else answers.union(got)
        paths.append(path)
        release(spark)
    v = (answers.where(F.col("block") == WORDS).agg(F.sum("n").alias("v")).first()["v"] or 0) + (ends > 0)
    words, pairs = _hot_sums(spark, answers, HOT_WORDS, len(hot.words)), _hot_sums(spark, answers, HOT_PAIRS, len(hot.pairs))
    totals = Totals(n, v + int((words[0] > 0).sum()), ends, *words, *pairs)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scores = None
    # the blocks meet their answers in parts too: each part's shuffle files go before the next
    for part in range(s.rounds):
        of = F.pmod(F.col("block"), F.lit(s.rounds)) == part
        by_block = answers.where(of & (F.col("block") >= 0)).groupBy("block").agg(F.collect_list(F.struct("shard", "kind", "n", "n_v", "codes", "more", "shares", "counts", "nexts")).alias("answers"))
        got, _ = table(spark, texts.where(of).join(by_block, "block", "left").mapInArrow(_scored(hot, shards, totals, s), schema))
        scores = got if scores is None else scores.union(got)
        release(spark)
    model = answers.where(F.col("block") == MODEL).select("shard", F.col("codes").alias("trie")) if keep_model else None
    for path in [texts_path, *([] if keep_model else paths)]:
        drop_table(spark, path)
    own_batches(spark)
    return scores, model
