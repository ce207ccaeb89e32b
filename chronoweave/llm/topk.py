"""Exact top-k search by inner product on an impact-ordered index, score at a time.

Vectors become integers, and a block of them an index: each dimension is a list
of postings (vector, component) cut into segments of neighbouring values. For a
query, a segment's impact is the query's component times the segment's largest
distance from the dimension's middle value; segments are processed by
descending impact, quantised to ``impact_levels`` steps, each adding its exact
contributions to the accumulators. What the unprocessed segments can still move
a score by is bounded by the sum of each dimension's largest remaining impact.
Processing stops only when that bound proves that few vectors can belong to the
k best; these are rescored exactly. If no proof comes, all segments are
processed.

Accumulators are 64-bit integers where no sum can leave them. Components from
2^24 on lie in blocks of their own; these, and queries with such components,
accumulate in floating point, whose largest possible error widens the proof,
and the possible members are rescored in integers of any size.

Blocks of vectors and groups of query blocks meet by an equi-join; a task holds
one block of vectors, whose index it builds once a group, and one group of
queries. Each pair gives k rows a query, which are ranked by query.

Defined results: a vector that is null, or holds a null or non-finite
component, takes no part; an empty vector scores 0 with every other; vectors of
different lengths meet as if padded by zeros; rows that share the query's id
are its own; ties go to smaller ids; repeated rows are candidates each; ranks
follow the exact scores, of which those outside 64 bits come out as the nearest
64-bit number; rows with a null id take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, table


#: Components from this magnitude on are kept in blocks of their own.
WIDE = 2.0**24
#: Bits of the parts in which wide components are multiplied.
PART = 24


@dataclass(frozen=True)
class Settings:
    k: int = 10
    scale: int = 1024
    block: int = 16384
    queries: int = 512
    #: Query blocks that meet a block of vectors at once.
    group: int = 8
    segments: int = 16
    impact_levels: int = 256
    #: Members that the proof may leave for exact rescoring.
    rescored: int = 256


def usable(embedding: Column) -> Column:
    """The vector as doubles; null if it is null or any component is null or not finite."""
    x = embedding.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), x)


def floors(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles, which hold it exactly: ``scale`` is a power of two.

    What would leave the doubles' range is capped at its end, far outside 64 bits.
    """
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * scale), -np.finfo(np.float64).max, np.finfo(np.float64).max)


def _blocks(vectors: DataFrame, size: int, n: int, name: str, scale: int) -> DataFrame:
    """Rows of ``size`` vectors at most: a number, their ids and their components (row by row); wide vectors apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        held: dict[bool, list] = {False: [], True: []}

        def block(rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            x = np.zeros((len(rows), max(len(v) for _, v in rows)))
            for i, (_, v) in enumerate(rows):
                x[i, : len(v)] = v
            ids = np.array([i for i, _ in rows], np.int64)
            small = np.abs(x).max(initial=0) < WIDE
            data = x.astype(np.int32).tobytes() if small else x.tobytes()
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([ids.tobytes()], pa.binary()), pa.array([data], pa.binary()), pa.array([x.shape[1]], pa.int32()), pa.array([not small])], names=[name, "ids", "x", "width", "wide"])

        for b in batches:
            for i, v in zip(b.column("id").to_pylist(), b.column("v"), strict=True):
                x = floors(np.asarray(v.values, np.float64), scale)
                rows = held[bool(np.abs(x).max(initial=0) >= WIDE)]
                rows.append((i, x))
                if len(rows) == size:
                    yield block(rows)
                    number += 1
                    rows.clear()
        for rows in held.values():
            if rows:
                yield block(rows)
                number += 1

    return vectors.repartition(max(1, -(-n // size))).mapInArrow(run, f"{name} long, ids binary, x binary, width int, wide boolean")


def unpacked_block(r: dict) -> tuple[np.ndarray, np.ndarray]:
    """(ids, components as doubles with integer values) of a row of :func:`_blocks`."""
    ids = np.frombuffer(r["ids"], np.int64)
    return ids, np.frombuffer(r["x"], np.float64 if r["wide"] else np.int32).reshape(len(ids), r["width"]).astype(np.float64)


def exact_products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``x`` with ``q`` (integers as doubles): 64-bit integers, or Python's where those could overflow."""
    most = float(np.abs(x).max(initial=0)), float(np.abs(q).max(initial=0))
    if most[0] < 2.0**62 and most[1] < 2.0**62 and most[0] * most[1] * max(1, len(q)) < 2.0**62:
        return x.astype(np.int64) @ q.astype(np.int64)
    total = np.zeros(len(x), object)
    for i, a in enumerate(_parts(x)):
        for j, b in enumerate(_parts(q)):
            total += (a @ b).astype(object) << (PART * (i + j))
    return total


def _parts(v: np.ndarray) -> list[np.ndarray]:
    """Integers P_i with v = sum P_i * 2^(PART i); all but the last from 0 to 2^PART - 1."""
    out = []
    while np.abs(v).max(initial=0) >= 2.0**PART:
        up = np.floor(v / 2.0**PART)
        out.append((v - up * 2.0**PART).astype(np.int64))
        v = up
    return [*out, v.astype(np.int64)]


class Index:
    """One block: postings by dimension, sorted by component and cut into segments."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, s: Settings):
        self.ids, self.x, self.s = ids, x, s
        n, width = x.shape
        self.most = float(np.abs(x).max(initial=0))
        parts = int(np.clip(n // 256, 1, s.segments))
        self.cuts = np.linspace(0, n, parts + 1).astype(np.int64)
        self.order = np.argsort(x, axis=0, kind="stable").T.copy()
        self._by_kind: dict[str, tuple] = {}

    def _lists(self, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(values less the middle, middle, reach by dimension and segment), as integers or as doubles from -1 to 1."""
        if kind not in self._by_kind:
            x = self.x.astype(np.int64) if kind == "int" else self.x / 2.0 ** np.ceil(np.log2(max(1.0, self.most)))
            values = np.take_along_axis(x, self.order.T, 0).T.copy()
            n = x.shape[0]
            middle = values[:, n // 2].copy()
            low = values[:, self.cuts[:-1]] - middle[:, None]
            high = values[:, self.cuts[1:] - 1] - middle[:, None]
            self._by_kind[kind] = values - middle[:, None], middle, np.maximum(np.abs(low), np.abs(high))
        return self._by_kind[kind]

    def top(self, query_id: int, q: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """(ids, exact scores) of the k best."""
        s, n = self.s, len(self.ids)
        width = min(len(q), self.x.shape[1])
        q = q[:width]
        out = self.ids == query_id
        alive = n - int(out.sum())
        k = min(s.k, alive)
        if k == 0:
            return self.ids[:0], []
        most_q = float(np.abs(q).max(initial=0))
        kind = "int" if 8.0 * max(1, width) * self.most * most_q < 2.0**62 and max(self.most, most_q) < 2.0**62 else "float"
        values, middle, reach = self._lists(kind)
        w = q.astype(np.int64) if kind == "int" else q / 2.0 ** np.ceil(np.log2(max(1.0, most_q)))
        # sums of width terms, each of 4 at most: their rounding stays below this
        slack = 0 if kind == "int" else 16.0 * (width + 2) ** 2 * 2.0**-52
        impact = np.abs(w)[:, None] * reach[:width]
        step = max(1, int(impact.max(initial=0)) // s.impact_levels) if kind == "int" else max(impact.max(initial=0) / s.impact_levels, 2.0**-60)
        order = np.argsort(-(impact // step), axis=None, kind="stable")
        flat = impact.reshape(-1)[order]
        dims, segs = np.divmod(order, impact.shape[1])
        acc = np.full(n, w @ middle[:width], np.int64 if kind == "int" else np.float64)
        look = max(1, len(order) // 32)
        members = None
        for t in range(len(order)):
            d, g = dims[t], segs[t]
            if flat[t]:
                a, b = self.cuts[g], self.cuts[g + 1]
                acc[self.order[d, a:b]] += w[d] * values[d, a:b]
            if t % look == look - 1 and t >= len(order) // 4:
                rest = self._bound(impact, order[t + 1 :], width) + slack
                members = np.flatnonzero((acc + 2 * rest >= self._last(acc, out, k)) & ~out)
                if len(members) <= max(s.rescored, 2 * k):
                    break
                members = None
        if members is None:
            members = np.flatnonzero((acc + 2 * slack >= self._last(acc, out, k)) & ~out)
        score = exact_products(self.x[members, :width], q)
        best = sorted(range(len(members)), key=lambda i: (-score[i], self.ids[members[i]]))[: s.k] if score.dtype == object else np.lexsort((self.ids[members], -score))[: s.k]
        return self.ids[members][best], [int(v) for v in score[best]]

    @staticmethod
    def _last(acc: np.ndarray, out: np.ndarray, k: int) -> float:
        """The k-th highest accumulator of those that are not ``out``."""
        lower = np.where(out, np.iinfo(np.int64).min if acc.dtype == np.int64 else -np.inf, acc)
        return np.partition(lower, len(acc) - k)[len(acc) - k]

    @staticmethod
    def _bound(impact: np.ndarray, rest: np.ndarray, width: int) -> float:
        """Most that the segments in ``rest`` can move one vector's score by."""
        left = np.zeros(impact.size, impact.dtype)
        left[rest] = impact.reshape(-1)[rest]
        return left.reshape(width, -1).max(1).sum()


def top_k(vectors: DataFrame, is_query: Column, s: Settings = Settings(), vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows of each row that ``is_query`` marks."""
    if s.scale <= 0 or s.scale & (s.scale - 1):
        raise ValueError("scale must be a power of two")
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), usable(F.col(embedding)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where("id is not null and v is not null")
    n = rows.agg(F.count("*").alias("all"), F.count_if("q").alias("asked")).first()
    index, index_path = table(spark, _blocks(rows.select("id", "v"), s.block, n["all"], "c", s.scale))
    queries, queries_path = table(spark, _blocks(rows.where("q").select("id", "v"), s.queries, n["asked"], "b", s.scale))
    # the blocks' numbers, one for thousands of vectors, say which pairs there are
    cs = [r["c"] for r in index.select("c").collect()]
    bs = sorted(r["b"] for r in queries.select("b").collect())
    if not bs or not cs:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    groups = -(-len(bs) // s.group)
    dealt = F.pmod(F.xxhash64("b"), F.lit(groups))
    left = index.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"))
    right = queries.select(dealt.alias("g2"), F.struct("ids", "x", "width", "wide").alias("block"), F.explode(F.lit(cs).cast("array<long>")).alias("c2"))
    right = right.groupBy("g2", "c2").agg(F.collect_list("block").alias("asked"))
    met = left.join(right.hint("merge"), (F.col("g") == F.col("g2")) & (F.col("c") == F.col("c2"))).select("ids", "x", "width", "wide", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        for b in batches:
            for at in range(b.num_rows):
                r = b.slice(at, 1).to_pylist()[0]
                index = Index(*unpacked_block(r), s)
                for asked in r["asked"]:
                    got = [(int(i), *index.top(int(i), q)) for i, q in zip(*unpacked_block(asked), strict=True)]
                    who = np.repeat([g[0] for g in got], [len(g[1]) for g in got])
                    found = np.concatenate([g[1] for g in got])
                    score = [v for g in got for v in g[2]]
                    order = [None if low <= v <= high else str(v) for v in score]
                    cols = [pa.array(who, pa.int64()), pa.array(found, pa.int64()), pa.array([min(max(v, low), high) for v in score], pa.int64()), pa.array(order, pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, names=["query_id", "vec_id", "score", "beyond"])

    found = met.mapInArrow(run, "query_id long, vec_id long, score long, beyond string")
    # scores outside 64 bits rank by their digits: by sign and length first, then as text
    digits = F.regexp_replace("beyond", "^-", "")
    minus = F.col("beyond").startswith("-")
    size, text = F.when(minus, -F.length(digits)).otherwise(F.length(digits)), F.when(minus, F.translate(digits, "0123456789", "9876543210")).otherwise(digits)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.coalesce(size, F.lit(0)).desc(), F.coalesce(text, F.lit("")).desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.k)
    return ranked.select("query_id", "rank", "vec_id", "score")
