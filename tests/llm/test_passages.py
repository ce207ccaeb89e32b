"""Passages: hot anchors, null and repeated ids, long texts, columns that travel along."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from chronoweave.llm import suffixdedup


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((gone[1:] & ~gone[:-1]).sum() + (gone[0] if len(gone) else 0))
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
    return out


def said(rng, n):
    return "".join(rng.choice("abcdefgh ") for _ in range(n))


@pytest.mark.parametrize("hot", [3, 10**6])
def test_one_line_in_many_different_texts(spark, hot):
    """A shared line, shorter or longer than a passage, with other texts around it."""
    rng = random.Random(1)
    short, long = said(rng, 36), said(rng, 90)
    texts = [said(rng, rng.randrange(60)) + rng.choice([short, long, short + long[:30]]) + said(rng, rng.randrange(60)) for _ in range(60)]
    texts += texts[:3] + [None, "", said(rng, 5000), "é" * 100, "é" * 100 + "x"]
    rows = [(i % 7 if i % 5 else None, t, i) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int")
    s = suffixdedup.Settings(48, 16, hot_contexts=hot, block_bytes=2000, shard_bytes=500)
    got = {r.kept_n_bytes: r for r in suffixdedup.repeated_passages(table.repartition(4), s, with_text=True, keep=("n_bytes",)).collect()}
    assert len(got) == len(rows)
    for (doc, _, i), want in zip(rows, brute(texts, 48), strict=True):
        r = got[i]
        assert (r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.kept_text) == (doc, *want)


def test_a_text_of_several_megabytes(spark):
    rng = np.random.default_rng(2)
    long = rng.integers(97, 123, 3_000_000, dtype=np.uint8).tobytes().decode()
    texts = [long, "x" * 50 + long[1_234_567:1_234_967] + "y" * 50, long[2_999_000:]]
    got = {r.doc_id: r for r in suffixdedup.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(s.start, s.end) for s in got[0].spans] == [(1_234_567, 1_234_967), (2_999_000, 3_000_000)]
    assert (got[1].n_removed, got[2].n_removed) == (400, 1000)
    assert got[0].kept_sha256 == hashlib.sha256((long[:1_234_567] + long[1_234_967:2_999_000]).encode()).hexdigest()
