"""Near duplicates by SuperMinHash signatures, banding, verification and grouping.

1.  A document's set is its distinct word shingles. Equal sets, told by a 128-bit
    BLAKE2 digest of the whole sorted set, fold into one class at once: a class
    is one row from here on, however many copies it has. Rows are numbered where
    they are first written, and a class goes by the least of its rows' numbers.
2.  SuperMinHash: each element visits the ``slots`` slots in its own random
    order, and its j-th visit leaves j plus a random fraction. Slots are thus
    correlated within an element and evenly used, which lowers the variance;
    and as soon as no slot holds more than j, the visits after the j-th cannot
    matter: large sets stop after a visit or two.
3.  Banding: ``bands`` bands of ``rows`` slots are keys; classes that share a key
    are candidates. A class is compared with the least class among those of all
    its keys; verified links group the classes. Where a key still holds several
    groups, signatures tell in blocks which may be linked; what may be linked,
    directly or through others, is a cluster, and inside a cluster every pair of
    different groups is compared.
4.  Verification: candidates are confirmed on their full sets by exact counts.
5.  Grouping: links are contracted by union-find in each partition and then
    joined across partitions by stars, in a number of rounds that grows with the
    logarithm of the longest chain.

Comparisons inside a key or a cluster give a spanning forest, never a row a
pair; links never reach the driver, and there is no cap on a key's size.

Defined results: a text without words has an empty set and no links; with fewer
words than a shingle has, the whole sequence is its one shingle; repeated rows
are documents each, so are different texts under one id, and each is linked by
its own text; rows with a null id are linked like others, their component has
the least id that is not null, and none if there is none: then all are kept, and
else none of them. :func:`representatives` keeps exactly one row of each group,
of the least id and among repeated ids the first written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textnp
from .common import drop_table, own_batches, q, release, small_batches, table

U64 = np.uint64
#: Tasks over which the classes of one component are dealt where they meet its name.
SALTS = 32


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    #: Signature agreement below which two classes are not compared: at a
    #: similarity of 0.75 it lies over four standard deviations below the mean.
    least_agreement: float = 0.58
    #: Classes of a block whose signatures, and whose full sets, are compared at once.
    block: int = 512
    unit: int = 256

    @property
    def slots(self) -> int:
        return self.bands * self.rows


def _random(h: np.ndarray, j: int) -> np.ndarray:
    """The j-th random 64 bits of each element."""
    return textnp.mix(h + U64((j + 1) * 0x9E3779B97F4A7C15 % 2**64))


def super_minhash(h: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """Signatures (texts x m, float32) of sets given as flat hashes and offsets.

    All elements take their j-th visit together; a text whose slots are all
    filled by visits up to the j-th is done.
    """
    n = len(first) - 1
    sig = np.full((n, m), np.inf, np.float32)
    own = textnp.owners(first)
    x, order = h, None
    for j in range(m):
        if not len(x):
            break
        r = _random(x, j)
        value = (r >> U64(40)).astype(np.float32) / np.float32(1 << 24) + np.float32(j)
        k = j + ((r & U64(0xFFFFFFFF)) % U64(m - j)).astype(np.int64)
        if j == 0:
            slot = k
        else:
            at = np.arange(len(x))
            slot = order[at, k].astype(np.int64)
            order[at, k] = order[:, j]
        np.minimum.at(sig.reshape(-1), own * m + slot, value)
        open_text = sig.max(1) >= j + 1
        go = open_text[own]
        if not go.all() or j == 0:
            x, own, slot = x[go], own[go], slot[go]
            if j == 0:
                order = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(x), 1))
                order[np.arange(len(x)), slot] = 0
            else:
                order = order[go]
    return sig


def shingle_sets(data: np.ndarray, off: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text, number before each text)."""
    h, first = textnp.words(data, off)
    w, before = textnp.window_hashes(h, first, s.shingle)
    own = textnp.owners(before)
    order = np.lexsort((w, own))
    w, own = w[order], own[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (own[1:] != own[:-1])
    w, own = w[new], own[new]
    return w, np.searchsorted(own, np.arange(len(off)))


def _texts(column: pa.Array, s: Settings) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, off = textnp.buffers(column)
    for i, j, d, o in textnp.pieces(data, off, 1 << 19):
        yield i, j, *shingle_sets(d, o, s)


SIGNED = "n_shingles long, digest binary, keys array<long>, sig binary"


def signatures(docs: DataFrame, s: Settings, text: str, keep: list[str]) -> DataFrame:
    """``keep``, n_shingles, digest (of the whole set), keys (one 64-bit key a band) and sig (8 bits a slot) of ``text``."""
    small_batches(docs.sparkSession)
    own = StructType.fromDDL(SIGNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = (np.arange(s.rows, dtype=U64) * U64(2) + U64(1)) * U64(0x9E3779B97F4A7C15)
        band_no = np.arange(s.bands, dtype=U64) * U64(0xC2B2AE3D27D4EB4F)
        for b in batches:
            sizes, digests, keys, sigs = [], [], [], []
            for _, _, w, before in _texts(b.column(text), s):
                n = np.diff(before)
                sig = super_minhash(w, before, s.slots)
                bits = np.where(np.isfinite(sig), sig, 0).view(np.uint32).astype(U64)
                bands = (textnp.mix(bits.copy()).reshape(-1, s.bands, s.rows) * odd).sum(2, dtype=U64)
                bands = textnp.mix(bands + band_no)
                sizes += n.tolist()
                whole = w.tobytes()
                digests += [hashlib.blake2b(whole[8 * i : 8 * j], digest_size=16).digest() for i, j in zip(before[:-1], before[1:], strict=True)]
                keys += [row.view(np.int64) if k else np.zeros(0, np.int64) for row, k in zip(bands, n, strict=True)]
                low = (textnp.mix(bits) & U64(255)).astype(np.uint8)
                sigs += [row.tobytes() for row in low]
            out = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *out], names=[*keep, *own.names])

    schema = docs.select(*keep).schema
    for f in own:
        schema = schema.add(f)
    return docs.mapInArrow(run, schema)


def _sets(wanted: DataFrame, rows: DataFrame, s: Settings) -> DataFrame:
    """(cls, shingles) of the ``rows`` (row, text) in ``wanted`` (cls)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = []
            for _, _, w, before in _texts(b.column("text"), s):
                sets += [w[i:j].view(np.int64) for i, j in zip(before[:-1], before[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("cls"), pa.array(sets, pa.list_(pa.int64()))], names=["cls", "shingles"])

    texts = rows.select(F.col("row").alias("cls"), "text")
    return texts.join(wanted.hint("merge"), "cls", "left_semi").mapInArrow(run, "cls long, shingles array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, s: Settings) -> tuple[DataFrame, str]:
    """Those (a, b) of ``pairs`` that reach the threshold on their full sets, as a table, and its path."""
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - both
    # the side that may be hot joins last: its rows then weigh what they are, and
    # Spark splits its partition by size
    good = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").where(both * 100 >= union * s.percent)
    return table(pairs.sparkSession, good.select("a", "b"))


def _clusters(grouped: DataFrame, signed: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) that join what may be linked: classes of one key in different groups whose signatures agree enough.

    ``grouped``: key, cls, group; ``signed``: cls, sig, fetched for such keys only. A key's classes are cut into blocks of
    about ``s.block``; each pair of blocks is one row of work, and of the
    agreeing pairs only a spanning forest comes out.
    """
    spark = grouped.sparkSession
    small_batches(spark, 16)
    found = grouped.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.count("*").alias("n"))
    keys, _ = table(spark, found.where("lo <> hi").select("key", F.ceil(F.col("n") / s.block).alias("blocks")))
    placed = grouped.join(keys, "key").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks"))).join(signed, "cls")
    blocks = placed.groupBy("key", "block").agg(F.collect_list(F.struct("cls", "group", "sig")).alias("members"))
    left = blocks.select("key", F.col("block").alias("i"), F.col("members").alias("x"))
    right = blocks.select("key", F.col("block").alias("j"), F.col("members").alias("y"))
    work = left.join(right, "key").where("i <= j").select("x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = int(np.ceil(s.least_agreement * s.slots))
        for b in batches:
            out: list[tuple[int, int]] = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                sides = []
                for v in (x.values, y.values):
                    sig = np.frombuffer(b"".join(v.field("sig").to_pylist()), np.uint8).reshape(-1, s.slots)
                    sides.append((np.asarray(v.field("cls")), np.asarray(v.field("group")), sig))
                (ca, ga, sa), (cb, gb, sb) = sides
                forest = Forest()
                for i in range(len(ca)):
                    hit = np.flatnonzero(((sb == sa[i]).sum(1) >= least) & (gb != ga[i]))
                    there, one = np.unique(gb[hit], return_index=True)
                    out += [(int(ca[i]), int(cb[hit[h]])) for g, h in zip(there.tolist(), one, strict=True) if forest.join(int(ga[i]), g)]
            yield _pairs(out)

    return work.mapInArrow(run, "a long, b long").distinct()


class Forest:
    """Union-find over any integers; of linked ones the least is the root."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root, up = x, self.parent
        while (to := up.get(root, root)) != root:
            root = to
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a: int, b: int) -> bool:
        """Link a and b; were they apart?"""
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*rows, strict=True) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _exact(members: DataFrame, sets: DataFrame, s: Settings) -> tuple[DataFrame, str]:
    """All links inside clusters that still hold several groups, as spanning forests of blocks.

    ``members``: cluster, cls, group. A cluster is cut into blocks; each pair of
    blocks is one task's unit, in which every pair of different groups is
    compared on its full sets.
    """
    spark = members.sparkSession
    found = members.groupBy("cluster").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.count("*").alias("n"))
    open_, open_path = table(spark, found.where("lo <> hi").select("cluster", F.ceil(F.col("n") / s.unit).alias("blocks")))
    placed = members.join(open_, "cluster").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    each = placed.select("cluster", "cls", "group", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    units = each.select("cluster", "cls", "group", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    loaded = units.join(sets.hint("merge"), "cls")

    def run(t: pa.Table) -> pa.Table:
        cls, group, block = (t.column(c).to_numpy() for c in ("cls", "group", "block"))
        lists = t.column("shingles").combine_chunks()
        flat, off = lists.values.to_numpy(), lists.offsets.to_numpy()
        flat = flat[off[0] : off[-1]]
        off = off - off[0]
        _, ids = np.unique(flat, return_inverse=True)
        size = np.diff(off)
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        forest, out = Forest(), []
        mark = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int32)
        for k in np.flatnonzero(block == i):
            mine = ids[off[k] : off[k + 1]]
            mark[mine] = 1
            common = np.add.reduceat(mark[ids], off[:-1])
            mark[mine] = 0
            near = (100 * common >= s.percent * (size + size[k] - common)) & (group != group[k]) & (block == j)
            for m in np.flatnonzero(near):
                if forest.join(int(group[k]), int(group[m])):
                    out.append((int(cls[k]), int(cls[m])))
        return pa.Table.from_batches([_pairs(out)])

    found = table(spark, loaded.groupBy("cluster", "i", "j").applyInArrow(run, "a long, b long"))
    drop_table(spark, open_path)
    return found


def _contract(edges: DataFrame) -> DataFrame:
    """A spanning forest of each partition's links, by union-find."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for b in batches:
            for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
                forest.join(u, v)
        find = forest.find
        nodes = [x for x in forest.parent if find(x) != x]
        for i in range(0, len(nodes), 1 << 16):
            part = nodes[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], names=["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame, per_task: int = 500_000) -> DataFrame:
    """(node, component): the least node that each node of the links (a, b) reaches.

    Union-find contracts up to ``per_task`` links in each task; where that took
    one task it is done. Else the forests' links go on by alternating stars: each
    node hooks its larger neighbours, then its smaller ones, onto the least; every
    round is written to the shared folder, and the rounds end when no link
    changes. The least ones are written before they are joined, so that both sides
    of the join are dealt out anew and the partition of a node with many links can
    be split.
    """
    spark = edges.sparkSession
    small_batches(spark, 10_000)
    e, path = table(spark, edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"))
    tasks = max(1, -(-e.count() // per_task))
    e, fresh = table(spark, _contract(e.coalesce(tasks)))
    drop_table(spark, path)
    if tasks == 1:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    path = fresh

    def checksum(x: DataFrame) -> tuple:
        r = x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(r)

    before = checksum(e)
    while True:
        # large star: to the least neighbour goes every larger neighbour
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, gone1 = table(spark, both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: so does every smaller neighbour, and the node itself
        down, gone2 = table(spark, large.where("u <> v").distinct())
        least, gone3 = table(spark, down.groupBy("u").agg(F.min("v").alias("m")))
        hooked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = hooked.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new, fresh = table(spark, _contract(new))
        for old in (path, gone1, gone2, gone3):
            drop_table(spark, old)
        e, path = new, fresh
        after = checksum(e)
        if after == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = after


def _grouped(docs: DataFrame, s: Settings, text: str, key: str, carry: bool) -> tuple[DataFrame, DataFrame, list[str]]:
    """(the rows as written: row, doc, text, n_shingles, digest; the classes: digest, name (the least (none, doc, row) reachable); all their tables' paths).

    ``carry``: the rows also hold all other columns of ``docs`` in a struct ``own``.
    """
    spark = docs.sparkSession
    rows = docs.select(
        q(key).cast("long").alias("doc"), q(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"),
        *([F.struct(F.lit(0).alias(text), *[q(c) for c in docs.columns if c != text]).alias("own")] if carry else []),
    )
    sigs, sigs_path = table(spark, signatures(rows, s, "text", rows.columns))
    # a class: rows of one and the same set; what is equal for all of them comes from any
    full = sigs.where("n_shingles > 0")
    least = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "row")).alias("least")
    classes = full.groupBy("digest").agg(F.min("row").alias("cls"), least, F.any_value("keys").alias("keys"), F.any_value("sig").alias("sig"))
    classes, classes_path = table(spark, classes)
    keyed, keyed_path = table(spark, classes.select("cls", F.explode("keys").alias("key")))
    shared = keyed.groupBy("key").agg(F.min("cls").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least")
    shared, shared_path = table(spark, shared)
    near = keyed.join(shared, "key").groupBy("cls").agg(F.min("least").alias("a")).where("a < cls").select("a", F.col("cls").alias("b"))
    near, near_path = table(spark, near)
    release(spark)
    # full sets of every class that shares a key with another
    wanted = keyed.join(shared, "key", "left_semi").select("cls").distinct()
    sets, sets_path = table(spark, _sets(wanted, sigs, s))
    release(spark)
    links, links_path = _verified(near, sets, s)
    groups = components(links)
    release(spark)

    grouped = keyed.join(shared, "key", "left_semi").join(groups.withColumnRenamed("node", "cls"), "cls", "left")
    grouped, grouped_path = table(spark, grouped.select("key", "cls", F.coalesce("component", "cls").alias("group")))
    for path in (keyed_path, shared_path, near_path):
        drop_table(spark, path)
    maybe, maybe_path = table(spark, _clusters(grouped, classes.select("cls", "sig"), s))
    drop_table(spark, grouped_path)
    small_batches(spark)
    done = [sigs_path, classes_path, links_path, maybe_path]
    if not maybe.isEmpty():
        # a cluster: all that verified and possible links join; a class without any is its own
        joined = components(links.union(maybe)).select(F.col("node").alias("cls"), F.col("component").alias("cluster"))
        roots = joined.select(F.col("cluster").alias("cls"), "cluster").distinct()
        members = joined.union(roots).join(groups.withColumnRenamed("node", "cls"), "cls", "left")
        members, members_path = table(spark, members.select("cluster", "cls", F.coalesce("component", "cls").alias("group")))
        more, more_path = _exact(members, sets, s)
        groups = components(links.union(more))
        done += [members_path, more_path]
    drop_table(spark, sets_path)
    release(spark)
    own_batches(spark)

    linked = groups.select(F.col("node").alias("cls"), "component")
    linked = linked.union(linked.select(F.col("component").alias("cls"), "component").distinct())
    names = linked.join(classes.select("cls", "least"), "cls").groupBy("component").agg(F.min("least").alias("name"))
    # a component may hold a third of all classes: it is dealt over several tasks
    salted = names.select("component", "name", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    of = classes.select("digest", "cls", "least").join(linked, "cls", "left").withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int"))
    of = of.join(salted, ["component", "salt"], "left")
    return sigs, of.select("digest", F.coalesce("name", "least").alias("name")), done


def near_duplicates(docs: DataFrame, s: Settings = Settings(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the least id reachable), kept."""
    sigs, of, _ = _grouped(docs, s, text, key, False)
    out = sigs.select("doc", "n_shingles", "digest").join(of.withColumnRenamed("digest", "__digest"), (F.col("digest") == F.col("__digest")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("name").isNull(), F.col("doc")).otherwise(F.col("name")["doc"])
    return out.select(F.col("doc").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc"), component.isNull()).alias("kept"))


def representatives(docs: DataFrame, s: Settings = Settings(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without near duplicates: of each group the row of the least id, all its columns as they are."""
    sigs, of, _ = _grouped(docs, s, text, key, True)
    first = of.select(F.col("name")["row"].alias("row")).distinct()
    back = [(F.col("text") if c == text else F.col("own")[c]).alias(c) for c in docs.columns]
    kept = sigs.where("n_shingles > 0").select("row", "text", "own").join(first.hint("merge"), "row", "left_semi")
    return kept.select(*back).union(sigs.where("n_shingles = 0").select(*back))
