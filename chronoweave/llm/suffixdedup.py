"""Removing repeated passages: bytes covered by a string of ``length`` bytes that also starts elsewhere.

1.  Anchors. In every run of ``length - gram + 1`` neighbouring byte grams the
    least by hash is an anchor. What is chosen depends on the bytes of the run
    alone, so both places of a repeated string hold the same anchor at the same
    offset. An anchor's context is all that a string of ``length`` bytes around
    it can reach.
2.  Anchors are dealt by hash. Contexts that are equal as a whole fold into one,
    in their block first: their strings repeat. Where an anchor has several
    contexts, one of each is fetched.
3.  The contexts of an anchor are cut into eight-byte symbols aligned at the
    anchor and suffix-sorted (:mod:`.suffixarray`). Neighbours in the suffix
    array that agree on the whole symbols of a string form classes; within a
    class the few bytes before and after them decide exactly.
4.  An anchor with more than ``hot_contexts`` contexts, such as one in a line that
    many different texts share, would be one task's. Its strings are dealt one by
    one instead, by the hash of each, equal ones folded in their block first.
5.  Repeated strings go back to their documents and are laid over the bytes.

Blocks of documents, of a bounded number of bytes or one document each, travel
as rows; anchors are packed by block and shard, of which there are as many as
the measured bytes ask for. Rows are never more than the anchors themselves.
Hashes have 64 bits; the contexts that are compared as such are compared by
their bytes.

Defined results: a null or empty text has no bytes; a text shorter than
``length`` keeps all; repeated rows are documents each, so that they repeat one
another; overlaps count; strings are judged on the input; ids may be null or
repeat: nothing is joined by them; a ``keep`` column named like a result comes
out as ``kept_`` and its name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textnp
from .common import carried, packed, q, release, shuffle_parts, small_batches, table, unpacked
from .suffixarray import suffix_array

U64 = np.uint64
#: Contexts (in symbols) that one suffix array takes, unless one anchor has more.
SORTED_AT_ONCE = 200_000


@dataclass(frozen=True)
class Settings:
    length: int = 200
    gram: int = 64
    block_bytes: int = 1 << 21
    #: Bytes of text whose anchors make up a shard, on average.
    shard_bytes: int = 1 << 25
    #: Different contexts of one anchor from which on its strings are dealt one by one.
    hot_contexts: int = 4096

    @property
    def run(self) -> int:
        return self.length - self.gram + 1

    @property
    def before(self) -> int:
        return self.length - self.gram


def _slide(x: np.ndarray, w: int, f: np.ufunc) -> np.ndarray:
    """f over every run of w neighbours, by doubling."""
    s = 1
    while s * 2 <= w:
        x = f(x[:-s], x[s:])
        s *= 2
    return f(x[: -(w - s)], x[w - s :]) if s < w else x


def anchors(data: np.ndarray, off: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, gram hashes, context hashes) of a block's anchors, by position."""
    n, none = len(data), np.zeros(0, np.int64)
    if n < s.length:
        return none, none.astype(U64), none.astype(U64)
    c = textnp.prefix_sums(data, textnp.tables()[1])
    at = np.arange(n - s.gram + 1)
    h = textnp.span_hash(c, at, at + s.gram)
    doc = textnp.owners(off)
    inside = doc[: n - s.length + 1] == doc[s.length - 1 :]  # runs that lie in one text
    least = np.where(inside, _slide(h, s.run, np.minimum), U64(0))
    rim = np.zeros(s.run - 1, U64)
    chosen = _slide(np.concatenate([rim, least, rim]), s.run, np.maximum) == h
    chosen &= doc[: len(h)] == doc[s.gram - 1 :]
    p = np.flatnonzero(chosen)
    lo, hi = _reach(p, off, doc, s)
    x = textnp.mix(textnp.span_hash(c, lo, hi) + ((p - lo) * 4096 + (hi - p)).astype(U64))
    return p, h[p], x


def _reach(p: np.ndarray, off: np.ndarray, doc: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Where the contexts of anchors at p begin and end: within their texts."""
    d = doc[p]
    return np.maximum(p - s.before, off[d]), np.minimum(p + s.length, off[d + 1])


BLOCKS = "block long, shard int, n int, h binary, x binary, twice binary, ids binary, known binary, off binary, n_docs int, n_bytes long, data binary, n_all int, pos binary, fresh binary, own binary"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
_ROWS = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in BLOCKS.split(", ")])


def _dealt(h: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard of each hash, order by shard and hash)."""
    shard = (h % U64(shards)).astype(np.int64)
    return shard, np.lexsort((h, shard))


def _runs(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, first, past the last) of the runs of equal, sorted shards."""
    edge = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(shard) else np.zeros(1, int)
    for a, z in zip(edge[:-1], edge[1:], strict=True):
        yield int(shard[a]), int(a), int(z)


def _blocks(docs: DataFrame, s: Settings, shards: int, keep: list[str]) -> DataFrame:
    """Rows of two kinds: a block's texts, ``keep`` columns and anchor positions (shard -1), and its distinct (anchor, context) pairs in each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for b in batches:
            data, off = textnp.buffers(b.column("__text"))
            known = b.column("doc").is_valid().to_numpy(zero_copy_only=False)
            ids = b.column("doc").fill_null(0).to_numpy()
            for i, j, d, o in textnp.pieces(data, off, s.block_bytes):
                p, h, x = anchors(d, o, s)
                shard = (h % U64(shards)).astype(np.int64)
                order = np.lexsort((x, h, shard))
                p, h, x, shard = p[order], h[order], x[order], shard[order]
                fresh = np.ones(len(p), bool)
                fresh[1:] = (h[1:] != h[:-1]) | (x[1:] != x[:-1])
                twice = np.bincount(np.cumsum(fresh) - 1, minlength=int(fresh.sum())) > 1
                own = _kept(b.select(keep).slice(i, j - i)) if keep else None
                rows = [(number, -1, len(twice), None, None, None, ids[i:j].tobytes(), known[i:j].tobytes(), o.tobytes(), j - i, len(d), packed(d), len(p), packed(p), packed(fresh), own)]
                h, x, shard = h[fresh], x[fresh], shard[fresh]
                for k, a, z in _runs(shard):
                    rows.append((number, k, z - a, h[a:z].tobytes(), x[a:z].tobytes(), packed(twice[a:z]), *[None] * 10))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROWS, strict=True)], schema=_ROWS)
                number += 1

    return docs.mapInArrow(run, BLOCKS)


def _kept(b: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(b)
    return sink.getvalue().to_pybytes()


# what becomes of an anchor; the last two are those of anchors whose strings are dealt one by one
UNIQUE, REPEATED, SOUGHT, REPEATED_AND_FETCHED, SOUGHT_ALONE, REPEATED_AND_ALONE = range(6)


def _folded(s: Settings):
    """Codes of a shard's (anchor, context) pairs."""

    def run(t: pa.Table) -> pa.Table:
        n = t.column("n").to_numpy()
        h = np.frombuffer(b"".join(t.column("h").to_pylist()), U64)
        x = np.frombuffer(b"".join(t.column("x").to_pylist()), U64)
        twice = np.concatenate([unpacked(b, k, bool) for b, k in zip(t.column("twice").to_pylist(), n, strict=True)])
        order = np.lexsort((x, h))
        hs, xs = h[order], x[order]
        new_h = np.ones(len(h), bool)
        new_h[1:] = hs[1:] != hs[:-1]
        new_x = new_h.copy()
        new_x[1:] |= xs[1:] != xs[:-1]
        g, c = np.cumsum(new_h) - 1, np.cumsum(new_x) - 1
        contexts = np.bincount(g[new_x])[g]
        copies = np.bincount(c, 1 + twice[order])[c]
        alone = np.where(contexts > s.hot_contexts, 2, 0)
        code = np.where(copies > 1, REPEATED, np.where(contexts > 1, SOUGHT + alone, UNIQUE)).astype(np.uint8)
        code[new_x & (copies > 1) & (contexts > 1)] = REPEATED_AND_FETCHED
        code[(code == REPEATED_AND_FETCHED) & (alone > 0)] = REPEATED_AND_ALONE
        out = np.empty(len(h), np.uint8)
        out[order] = code
        cut = np.concatenate([[0], np.cumsum(n)])
        each = [packed(out[a:z]) for a, z in zip(cut[:-1], cut[1:], strict=True)]
        alone = [bool((out[a:z] >= SOUGHT_ALONE).any()) for a, z in zip(cut[:-1], cut[1:], strict=True)]
        return pa.table({"block": t.column("block"), "shard": t.column("shard"), "n": t.column("n"), "codes": pa.array(each, pa.binary()), "alone": pa.array(alone)})

    return run


def _codes(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions of a block's anchors, their codes, whether each is the first of its context in the block)."""
    out = [unpacked(p["codes"], p["n"], np.uint8) for p in sorted(r["parts"] or [], key=lambda p: p["shard"])]
    got = np.concatenate(out) if out else np.zeros(0, np.uint8)
    if len(got) != r["n"]:
        raise ValueError("a shard's answer is missing")
    fresh = unpacked(r["fresh"], r["n_all"], bool)
    return unpacked(r["pos"], r["n_all"], np.int64), got[np.cumsum(fresh) - 1], fresh


def _alone(r: dict, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of all strings around a block's anchors whose strings are dealt one by one."""
    p, codes, _ = _codes(r)
    data, off = unpacked(r["data"], r["n_bytes"], np.uint8), np.frombuffer(r["off"], np.int64)
    p = p[codes >= SOUGHT_ALONE]
    lo, hi = _reach(p, off, textnp.owners(off), s)
    step = np.zeros(len(data) + 1, np.int64)
    last = np.minimum(p, hi - s.length)
    fit = last >= lo
    np.add.at(step, lo[fit], 1)
    np.add.at(step, last[fit] + 1, -1)
    at = np.flatnonzero(np.cumsum(step)[:-1] > 0)
    c = textnp.prefix_sums(data, textnp.tables()[1])
    return at, textnp.span_hash(c, at, at + s.length)


def _asked_alone(s: Settings, shards: int):
    """Blocks with codes -> their distinct string hashes by shard, each with whether the block has it twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["block", "shard", "n", "h", "twice"], (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        for b in batches:
            for r in b.to_pylist():
                h, count = np.unique(_alone(r, s)[1], return_counts=True)
                shard, order = _dealt(h, shards)
                h, twice, shard = h[order], count[order] > 1, shard[order]
                rows = [(r["block"], k, z - a, packed(h[a:z]), packed(twice[a:z])) for k, a, z in _runs(shard)]
                cols = list(zip(*rows, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=names)

    return run


def _answered_alone(t: pa.Table) -> pa.Table:
    """A shard's strings of all blocks -> which of them repeat."""
    n = t.column("n").to_numpy()
    h = np.concatenate([unpacked(b, k, U64) for b, k in zip(t.column("h").to_pylist(), n, strict=True)])
    twice = np.concatenate([unpacked(b, k, bool) for b, k in zip(t.column("twice").to_pylist(), n, strict=True)])
    _, at = np.unique(h, return_inverse=True)
    again = np.bincount(at, 1 + twice)[at] > 1
    cut = np.concatenate([[0], np.cumsum(n)])
    each = [packed(again[a:z]) for a, z in zip(cut[:-1], cut[1:], strict=True)]
    return pa.table({"block": t.column("block"), "shard": t.column("shard"), "n": t.column("n"), "again": pa.array(each, pa.binary())})


def _contexts(s: Settings, shards: int):
    """Blocks with codes -> packed contexts of the anchors to be compared, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = s.before + s.length
        for b in batches:
            for r in b.to_pylist():
                p, codes, fresh = _codes(r)
                at = np.flatnonzero(((codes == SOUGHT) | (codes == REPEATED_AND_FETCHED)) & fresh)
                if not len(at):
                    continue
                data, off = unpacked(r["data"], r["n_bytes"], np.uint8), np.frombuffer(r["off"], np.int64)
                p = p[at]
                doc = textnp.owners(off)
                lo, hi = _reach(p, off, doc, s)
                c = textnp.prefix_sums(data, textnp.tables()[1])
                h = textnp.span_hash(c, p, p + s.gram)
                cols = p[:, None] - s.before + np.arange(width)
                ok = (cols >= lo[:, None]) & (cols < hi[:, None])
                text = np.where(ok, data[np.clip(cols, 0, len(data) - 1)], 0).astype(np.uint8)
                idx = np.where(codes[at] == SOUGHT, at, -1).astype(np.int32)
                shard = (h % U64(shards)).astype(np.int64)
                rows = []
                for k in np.unique(shard):
                    m = shard == k
                    lens = np.stack([p[m] - lo[m], hi[m] - p[m]], 1).astype(np.uint16)
                    rows.append((r["block"], int(k), int(m.sum()), h[m].tobytes(), idx[m].tobytes(), lens.tobytes(), packed(text[m])))
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["block", "shard", "n", "h", "idx", "lens", "texts"])

    return run


def repeated_windows(group: np.ndarray, text: np.ndarray, lens: np.ndarray, s: Settings) -> np.ndarray:
    """contexts x (before + 1) booleans: does the string that starts x bytes before the anchor occur in another context of the group?

    ``group`` is sorted; ``text``: contexts as bytes, the anchor at ``before``;
    ``lens``: bytes that exist before and from the anchor.
    """
    n, starts = len(group), s.before + 1
    words = s.before // 8 + s.length // 8
    symbols = text.reshape(n, words, 8).view(">u8").reshape(n, words)
    _, ranks = np.unique(symbols, return_inverse=True)
    ranks = ranks.reshape(n, words).astype(np.int64)
    whole = s.length // 8 - 1  # full symbols in a string that is not aligned
    offsets = s.before // 8 + 1  # positions at which those can start
    sa = suffix_array(ranks.reshape(-1))
    row, col = np.divmod(sa, words)
    keep = col < offsets
    row, col = row[keep], col[keep]
    native = symbols.astype(U64)
    hit = np.zeros((n, starts), bool)
    # classes: neighbours in the suffix array that agree on `whole` symbols
    flat = np.concatenate([ranks.reshape(-1), np.full(whole, -1)])
    begin = row * words + col
    same = np.ones(max(0, len(begin) - 1), bool)
    for k in range(whole):
        same &= flat[begin[1:] + k] == flat[begin[:-1] + k]
    cls = np.concatenate([[0], np.cumsum(~same)]) if len(begin) else begin
    for a in range(offsets):
        m = col == a
        r, k = row[m], cls[m]
        x0 = s.before - 8 * a  # the aligned symbols start x0 bytes before the anchor
        for b in range(8):
            x = x0 + b
            if x > s.before or x < 0:
                continue
            fit = (lens[r, 0] >= x) & (lens[r, 1] >= s.length - x)
            rr, kk = r[fit], k[fit]
            if len(rr) < 2:
                continue
            tail = 8 - b
            after = native[rr, a + whole] >> U64(8 * (8 - tail)) if tail else np.zeros(len(rr), U64)
            front = (native[rr, a - 1] & U64((1 << 8 * b) - 1)) if b else np.zeros(len(rr), U64)
            key = (after << U64(8 * b) | front) if b < 8 else front
            order = np.lexsort((key, kk, group[rr]))
            g, k2, v = group[rr][order], kk[order], key[order]
            eq = (g[1:] == g[:-1]) & (k2[1:] == k2[:-1]) & (v[1:] == v[:-1])
            twice = np.zeros(len(rr), bool)
            twice[1:] |= eq
            twice[:-1] |= eq
            hit[rr[order[twice]], x] = True
    return hit


def _compared(s: Settings):
    """A shard's contexts -> for each block, its anchors' starts of repeated strings as bits."""

    def run(t: pa.Table) -> pa.Table:
        n = t.column("n").to_numpy()
        width = s.before + s.length
        h = np.frombuffer(b"".join(t.column("h").to_pylist()), U64)
        idx = np.frombuffer(b"".join(t.column("idx").to_pylist()), np.int32)
        lens = np.frombuffer(b"".join(t.column("lens").to_pylist()), np.uint16).reshape(-1, 2).astype(np.int64)
        text = np.concatenate([unpacked(b, k * width, np.uint8) for b, k in zip(t.column("texts").to_pylist(), n, strict=True)]).reshape(-1, width)
        block = np.repeat(t.column("block").to_numpy(), n)
        order = np.argsort(h, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1], [True]]))
        bits = np.zeros((len(h), (s.before + 8) // 8), np.uint8)
        most = max(1, SORTED_AT_ONCE * 8 // width)
        i = 0
        while i < len(edge) - 1:
            j = i + 1
            while j < len(edge) - 1 and edge[j + 1] - edge[i] <= most:
                j += 1
            m = order[edge[i] : edge[j]]
            _, group = np.unique(h[m], return_inverse=True)
            bits[m] = np.packbits(repeated_windows(group, text[m], lens[m], s), axis=1)
            i = j
        wanted = np.flatnonzero((idx >= 0) & bits.any(1))
        by = wanted[np.argsort(block[wanted], kind="stable")]
        cuts = np.flatnonzero(np.concatenate([[True], block[by][1:] != block[by][:-1], [True]])) if len(by) else np.zeros(1, int)
        rows = [(int(block[by[a]]), idx[by[a:z]].tobytes(), bits[by[a:z]].tobytes()) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
        cols = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.table({"block": pa.array(cols[0], pa.int64()), "idx": pa.array(cols[1], pa.binary()), "bits": pa.array(cols[2], pa.binary())})

    return run


def _removed(r: dict, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, which bytes go) of a block."""
    data, off = unpacked(r["data"], r["n_bytes"], np.uint8), np.frombuffer(r["off"], np.int64)
    n = len(data)
    p, codes, _ = _codes(r)
    doc = textnp.owners(off)
    step = np.zeros(n + 1, np.int64)
    full = p[(codes == REPEATED) | (codes == REPEATED_AND_FETCHED) | (codes == REPEATED_AND_ALONE)]
    if len(full):
        lo, hi = _reach(full, off, doc, s)
        last = np.minimum(full, hi - s.length)
        fit = last >= lo
        np.add.at(step, lo[fit], 1)
        np.add.at(step, last[fit] + 1, -1)
    starts = np.cumsum(step)[:n] > 0
    for m in r["marks"] or []:
        idx = np.frombuffer(m["idx"], np.int32)
        bits = np.unpackbits(np.frombuffer(m["bits"], np.uint8).reshape(len(idx), -1), axis=1)[:, : s.before + 1]
        i, x = np.nonzero(bits)
        starts[p[idx[i]] - x] = True
    if r["strings"]:
        at, h = _alone(r, s)
        own, back = np.unique(h, return_inverse=True)
        again = np.concatenate([unpacked(q["again"], q["n"], bool) for q in sorted(r["strings"], key=lambda q: q["shard"])])
        _, order = _dealt(own, r["shards"])
        repeated = np.empty(len(own), bool)
        repeated[order] = again
        starts[at[repeated[back]]] = True
    c = np.concatenate([[0], np.cumsum(starts)])
    at = np.arange(n)
    return data, off, c[at + 1] - c[np.maximum(0, at + 1 - s.length)] > 0


def spans(gone: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal removed runs; none crosses a text's edge."""
    edge = np.zeros(len(gone) + 1, bool)
    edge[off] = True
    a = gone.copy()
    a[1:] &= ~gone[:-1] | edge[1:-1]
    z = gone.copy()
    z[:-1] &= ~gone[1:] | edge[1:-1]
    return np.flatnonzero(a), np.flatnonzero(z) + 1


RESULT = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "kept_text": pa.string()}


def repeated_passages(docs: DataFrame, s: Settings = Settings(), text: str = "text", doc_id: str = "doc_id", with_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: ``keep``, doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (starts and ends in bytes).

    ``with_text``: also ``kept_text``, the remaining text; a character that lost
    any of its bytes is gone.
    """
    if s.before % 8 or s.length % 8:
        raise ValueError("length and gram must be multiples of 8")
    spark = docs.sparkSession
    small_batches(spark)
    measured = docs.agg(F.sum(F.octet_length(q(text).cast("string"))).alias("n")).first()["n"] or 0
    shards = int(max(2 * shuffle_parts(spark), -(-measured // s.shard_bytes)))
    names = [c for c in RESULT if with_text or c != "kept_text"]
    into, inner, back = carried(keep, names)
    rows = docs.select(*into, q(doc_id).cast("long").alias("doc"), q(text).cast("string").alias("__text"))
    all_rows, _ = table(spark, _blocks(rows, s, shards, inner))
    release(spark)
    texts = all_rows.where("shard = -1").select("block", "n", "ids", "known", "off", "n_docs", "n_bytes", "data", "n_all", "pos", "fresh", "own")
    codes = all_rows.where("shard >= 0").select("block", "shard", "n", "h", "x", "twice").groupBy("shard").applyInArrow(_folded(s), "block long, shard int, n int, codes binary, alone boolean")
    codes, _ = table(spark, codes.groupBy("block").agg(F.collect_list(F.struct("shard", "n", "codes")).alias("parts"), F.max("alone").alias("alone")))
    release(spark)
    known = texts.drop("own").join(codes, "block")
    asked = known.mapInArrow(_contexts(s, shards), "block long, shard int, n int, h binary, idx binary, lens binary, texts binary")
    marks = asked.groupBy("shard").applyInArrow(_compared(s), "block long, idx binary, bits binary")
    marks, _ = table(spark, marks.groupBy("block").agg(F.collect_list(F.struct("idx", "bits")).alias("marks")))
    release(spark)
    strings = known.where("alone").mapInArrow(_asked_alone(s, shards), "block long, shard int, n int, h binary, twice binary")
    strings = strings.groupBy("shard").applyInArrow(_answered_alone, "block long, shard int, n int, again binary")
    strings, _ = table(spark, strings.groupBy("block").agg(F.collect_list(F.struct("shard", "n", "again")).alias("strings")))
    release(spark)
    schema = rows.select(*inner).schema
    for f in StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>" + (", kept_text string" if with_text else "")):
        schema = schema.add(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                data, off, gone = _removed(r | {"shards": shards}, s)
                ids, known = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["known"], bool)
                a, z = spans(gone, off)
                first = np.searchsorted(a, off)
                out = []
                for i in range(r["n_docs"]):
                    lo, hi = off[i], off[i + 1]
                    kept = data[lo:hi][~gone[lo:hi]].tobytes() if first[i + 1] > first[i] else data[lo:hi].tobytes()
                    own = [{"start": int(u - lo), "end": int(v - lo)} for u, v in zip(a[first[i] : first[i + 1]], z[first[i] : first[i + 1]], strict=True)]
                    row = (int(ids[i]) if known[i] else None, int(hi - lo), int(hi - lo) - len(kept), len(own), hashlib.sha256(kept).hexdigest(), own)
                    out.append(row + ((kept.decode("utf-8", "ignore"),) if with_text else ()))
                cols = [pa.array(c, RESULT[k]) for c, k in zip(zip(*out, strict=True), names, strict=True)]
                more = pa.ipc.open_stream(r["own"]).read_next_batch().columns if inner else []
                yield pa.RecordBatch.from_arrays([*more, *cols], names=[*inner, *names])

    joined = texts.join(codes.drop("alone"), "block", "left").join(marks, "block", "left").join(strings, "block", "left")
    return joined.mapInArrow(run, schema).select(*back, *names)
