"""Exact top-k: components of any finite size, ties, repeated rows, vectors of different lengths."""

import math
import random

import pytest
from pyspark.sql import functions as F

from chronoweave.llm import topk

INT64 = 2**63


def brute(rows, ask, k=10):
    """(query, rank) -> (vec_id, score) from Python's integers."""
    whole = lambda x: math.floor(x) * 1024 if abs(x) >= 2.0**53 else math.floor(x * 1024)
    v = [(i, [whole(x) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = {}
    for i, q in v:
        if ask(i):
            best = sorted((-sum(a * b for a, b in zip(q, c, strict=False)), j) for j, c in v if j != i)[:k]
            out |= {(i, r): (j, min(max(-s, -INT64), INT64 - 1)) for r, (s, j) in enumerate(best, 1)}
    return out


def check(spark, rows, settings):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(table, F.col("vec_id") % 100 == 0, settings).collect()
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got} == brute(rows, lambda i: i % 100 == 0)
    assert len({(r.query_id, r["rank"]) for r in got}) == len(got)


def test_large_components(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(600)]
    rows[100] = (100, [3.0e6, -1.0] + [0.5] * 6)
    rows[7] = (7, [3.0e6] + [0.0] * 7)
    rows[200] = (200, [2.0**40, 1.0] + [-0.25] * 6)
    rows[8] = (8, [-(2.0**40)] * 8)
    rows[9] = (9, [1e300] + [0.0] * 7)
    rows[300] = (300, [-1e200, 5.5] + [0.0] * 6)
    rows += [(700, [float(2**31)] * 8), (701, [float("inf")] * 8), (702, None), (703, [None] * 8), (None, [1.0] * 8)]
    check(spark, rows, topk.Settings(block=256, queries=3, group=1))


@pytest.mark.parametrize("rows", [
    [(i, [0.5, 0.25]) for i in range(300)],
    [(0, []), (1, [1.0]), (100, [1.0, 2.0, 3.0]), (2, [0.5] * 5), (3, [])],
    [(0, [1.0])],
    [(0, [0.0] * 4)] + [(i, [0.0] * 4) for i in range(1, 40)],
])
def test_ties_lengths_and_lone_rows(spark, rows):
    check(spark, rows, topk.Settings(block=64))


def test_repeated_rows_are_candidates_each(spark):
    rows = [(0, [1.0]), (1, [2.0]), (1, [2.0]), (2, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(table, F.col("vec_id") % 100 == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2 * 1024 * 1024), (1, 2 * 1024 * 1024), (2, 1024 * 1024)]
