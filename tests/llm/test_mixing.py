"""Mixing: short sources, repeated rows and ids, clashing names, what the SQL says."""

import re
from collections import Counter

import duckdb
import pytest

from chronoweave.llm import mixing, mixing_sql

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_source(got):
    return {s: (g.taken.sum(), g.target.iloc[0], g["size"].sum()) for s, g in got.groupby("source", dropna=False)}


def test_short_sources_come_near_their_targets(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(8)), f"s{i:02d}") for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_quotas(table).toPandas()
    assert (got.taken <= 2 * got["size"]).all()
    for taken, target, _ in by_source(got).values():
        assert abs(taken - target) <= 1.5
    assert got.taken.sum() == pytest.approx(720, abs=2)
    one = mixing.mix_quotas(table.where("doc_id = 0")).toPandas()
    assert one.taken.tolist() == [12]


@pytest.mark.parametrize("sizes", [[1], [1000, 3, 1], [31, 33, 500, 0]])
def test_quota_is_met_and_texts_hold_it(spark, sizes):
    rows = [(10 * i + k, " ".join(f"{i}.{k}.{w}" for w in range(n)), f"s{i}") for i, n in enumerate(sizes) for k in range(2)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_quotas(table).toPandas()
    for taken, target, size in by_source(got).values():
        assert taken <= 2 * size
        assert abs(taken - target) <= max(1.5, target / mixing.Mix.least_blocks)
    words = Counter()
    for r in mixing.mixed_texts(table).collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert {k: v for k, v in zip(got.doc_id, got.taken, strict=True) if v} == dict(words)


def test_repeated_ids_and_clashing_names(spark):
    rows = [(1, "a b c", "s", 7, 1.0), (1, "d e f", "s", 8, 2.0), (1, "a b c", "s", 7, 1.0), (None, "g h", None, 9, 3.0), (2, None, "s", 5, 4.0), (3, " ", "t", 6, 5.0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, taken long, start double")
    mixed = mixing.mixed_texts(table)
    assert mixed.columns == table.columns
    got = sorted(map(tuple, mixed.collect()), key=str)
    assert got == sorted(map(tuple, mixing.mixed_texts(table.repartition(3)).collect()), key=str)
    assert {(r[3], r[4]) for r in got} <= {(r[3], r[4]) for r in rows}
    assert not {5, 6} & {r[3] for r in got}


@pytest.mark.parametrize("n", [1, 3000])
def test_sql_says_the_same(spark, n):
    import pandas as pd

    rows = pd.DataFrame([(i, " ".join(["w"] * (i * 7 % 90)), ["a", "b", "c", None, "e"][i % 5 if i % 11 else 0]) for i in range(n)], columns=["doc_id", "text", "source"])
    con = duckdb.connect()
    con.register("documents", rows)
    want = con.execute(mixing_sql.oracle()).fetchall()
    table = spark.createDataFrame(list(rows.itertuples(index=False, name=None)), "doc_id long, text string, source string")
    got = mixing.mix_quotas(table).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, got)) == sorted(want)
