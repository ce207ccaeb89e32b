"""The quality rules' score and verdict against the same formula in plain Python."""

import math
import os
import random
import re

import duckdb
import pytest
import xxhash

from chronoweave.llm import oracles, quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
RULES = quality.Rules(buckets=512)


def signed(h):
    return h - 2**64 if h >= 2**63 else h


def of_text(t, seed=42):
    return signed(xxhash.xxh64_intdigest(t.encode(), seed))


def of_long(x, seed=42):
    return signed(xxhash.xxh64_intdigest((x % 2**64).to_bytes(8, "little"), seed % 2**64))


def features(text):
    h = [of_text(w) for w in WORD.findall(text or "")]
    return [x % RULES.buckets for x in h] + [of_long(b, of_long(a)) % RULES.buckets for a, b in zip(h, h[1:], strict=False)]


def failed(text):
    w = WORD.findall(text or "")
    spans = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    again = {p for k, s in enumerate(spans) if spans.count(s) > 1 for p in range(k, k + 5)}
    return len(w) < 10 or 100 * len(again) > 20 * len(w)


def brute(rows, trusted):
    half = {i: signed(xxhash.xxh64_intdigest(b"half", of_long(i) % 2**64)) % 2 for i in trusted}
    raw, parts = [0] * RULES.buckets, [[0] * RULES.buckets for _ in range(2)]
    for i, t in rows:
        for x in features(t):
            raw[x] += 1
            if i in half:
                parts[half[i]][x] += 1

    def ratios(target):
        base = math.log((sum(raw) + RULES.buckets) / (sum(target) + RULES.buckets))
        return [math.log((y + 1) / (x + 1)) + base for x, y in zip(raw, target, strict=True)]

    def score(t, r):
        f = features(t)
        return sum(r[x] for x in f) / len(f) if f else 0.0

    other = [ratios(p) for p in reversed(parts)]
    own = sorted(score(t, other[half[i]]) for i, t in rows if i in half and not failed(t))
    at = RULES.quantile * (len(own) - 1)
    low = own[int(at)] + (at - int(at)) * (own[min(int(at) + 1, len(own) - 1)] - own[int(at)])
    whole = ratios([x + y for x, y in zip(*parts, strict=True)])
    return {i: (score(t, whole), not failed(t) and score(t, whole) >= low - RULES.margin) for i, t in rows}


def test_score_and_verdict(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdéf") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    rows = []
    for i in range(160):
        w = rng.choices(vocab, k=rng.randint(5, 90))
        if i % 4 == 3:
            w = [x + rng.choice(["##", "%%%", "&"]) for x in w]
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, "one"), (203, rows[0][1]), (204, "a b c d e " * 9)]
    trusted = [i for i, _ in rows if i % 4 == 0 and i < 120]
    table = spark.createDataFrame([(*r, True, 1.5) for r in rows], "doc_id long, text string, kept boolean, score double")
    got = {r.doc_id: r for r in quality.judge(table, spark.createDataFrame([(i,) for i in trusted], "doc_id long"), RULES).collect()}
    want = brute(rows, trusted)
    assert {v for _, v in want.values()} == {True, False}
    for i, (score, kept) in want.items():
        assert got[i].score == pytest.approx(score, abs=1e-9)
        assert (got[i].kept, got[i].base_failed) == (kept, failed(dict(rows)[i]))
    assert quality.measures(table, keep=("doc_id", "kept")).where("kept").count() == len(rows)


def test_a_large_target_counts_whole(spark, monkeypatch):
    rng = random.Random(4)
    vocab = [a + b for a in "abc" for b in "wxyz"]
    rows = [(i, " ".join(rng.choices(vocab, k=12))) for i in range(21_000)]
    rows += [(i, " ".join(x + "%%%" for x in rng.choices(vocab, k=12))) for i in range(21_000, 21_500)]
    rows += [(5, rows[5][1]), (None, rows[0][1])]
    trusted = range(20_800)
    want = brute(rows, set(trusted))
    assert {v for _, v in want.values()} == {True, False}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in [*trusted, 5, None]], "doc_id long")
    key = "spark.sql.autoBroadcastJoinThreshold"
    own = spark.conf.get(key)
    for bound in (own, "-1"):  # the target's marks broadcast, then met in a shuffle
        spark.conf.set(key, bound)
        monkeypatch.setattr(quality, "BROADCAST_ROWS", 2**26 if bound == own else 0)
        try:
            got = quality.judge(docs, ids, RULES).collect()
        finally:
            spark.conf.set(key, own)
        assert len(got) == len(rows)
        for r in got:
            score, kept = want[r.doc_id]
            assert r.score == pytest.approx(score, abs=1e-9)
            assert r.kept == kept


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize(("name", "sql"), [("quality_measures", oracles.QUALITY_MEASURES), ("op6_suffix_array", oracles.PASSAGES), ("op9_near_duplicates", oracles.NEAR_DUPLICATES)])
def test_sql_says_the_same(spark, name, sql):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(sql)
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, SF).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
