"""The language model against its formula in plain Python, unquantised."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronoweave.llm import lm
from chronoweave.llm.common import fold

WORD = re.compile(r"[^\x20\x09-\x0D]+")
S = lm.Settings()


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(low), None]


class Brute:
    """Interpolated absolute discounting from plain counts."""

    def __init__(self, train):
        self.c1, self.c2, self.c3 = Counter(), Counter(), Counter()
        for t in train:
            self.c1.update(t)
            self.c2.update(zip(t, t[1:], strict=False))
            self.c3.update(zip(["<s>", *t], t, t[1:], strict=False))
        self.n, self.v = sum(self.c1.values()), len(self.c1)
        self.next1 = Counter(a for a, _ in self.c2)
        self.next2, self.pair = Counter((a, b) for a, b, _ in self.c3), Counter()
        for (a, b, _), k in self.c3.items():
            self.pair[a, b] += k

    def p1(self, w):
        if not self.n:
            return 1.0
        seen = (self.c1[w] - S.discounts[0]) / self.n if self.c1[w] else 0
        return seen + S.discounts[0] * self.v / self.n / (2 * self.v + 1)

    def p2(self, v, w):
        if not self.c1[v]:
            return self.p1(w)
        return max(0, self.c2[v, w] - S.discounts[1]) / self.c1[v] + S.discounts[1] * self.next1[v] / self.c1[v] * self.p1(w)

    def p3(self, u, v, w):
        if not self.pair[u, v]:
            return self.p2(v, w)
        return (max(0, self.c3[u, v, w] - S.discounts[2]) + S.discounts[2] * self.next2[u, v] * self.p2(v, w)) / self.pair[u, v]

    def score(self, t):
        return math.log10(self.p1(t[0])) + sum(math.log10(self.p3(u, v, w)) for u, v, w in zip(["<s>", *t], t, t[1:], strict=False))

    def base(self, t):
        return sum(math.log10((self.c1[x] + 1) / (self.n + self.v + 1)) for x in t)


def check(got, rows, held):
    toks = {i: tokens(t) for i, t in rows}
    model = Brute([t for i, t in toks.items() if not held(i)])
    assert len(got) == len(rows)
    for r in got:
        t = toks[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(t), sum(model.c1[x] > 0 for x in t), model.n)
        assert r.base_score == pytest.approx(model.base(t))
        assert model.score(t) - 0.08 * len(t) <= r.score <= model.score(t) + 1e-6
    return model


def texts(n, seed=3, words=120):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5))) for _ in range(words)]
    out = [" ".join(rng.choices(vocab, range(1, words + 1), k=rng.randint(0, 60))) for _ in range(n)]
    return [None, "", " \n", "one", "One ONE one one", *out, *out[:5]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(texts(150))), "doc_id long, text string")


def crc_held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def test_against_the_formula(spark, docs):
    got = lm.score(docs.repartition(3), fold(F.col("doc_id"), 7) == 2).collect()
    check(got, list(enumerate(texts(150))), crc_held)


def test_hot_words_and_pairs_over_many_shards(spark, docs):
    """Small shards make frequent words and pairs hot; blocks of one partition or of many ask the same."""
    s = lm.Settings(block_bytes=2000, shard_tokens=60, rounds=2)
    rows = [(i, f"the of the {t or ''} of the of the") for i, t in enumerate(texts(150))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    found = []
    plain = lm._hot
    try:
        lm._hot = lambda *a: found.append(plain(*a)) or found[-1]
        one = lm.score(table.coalesce(1), fold(F.col("doc_id"), 7) == 2, s).collect()
        many = lm.score(table.repartition(9), fold(F.col("doc_id"), 7) == 2, s).collect()
    finally:
        lm._hot = plain
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert all(len(h.words) > 2 and len(h.pairs) > 1 for h in found)
    check(one, rows, crc_held)
    check(many, rows, crc_held)


def test_probabilities_sum_to_one_at_most(spark):
    """After every context, all known words, the end and the open vocabulary's unseen words share a mass of 1 at most."""
    words = ["a", "b", "c", "d"]
    train = ["a b", "a c", "a b a d", "b c d", "c a", "d d b", "a a"]
    contexts = [*words, *(f"{u} {v}" for u in words for v in words), "zzz", "zzz a"]
    ask = [x for c in ["", *contexts] for x in [c, *(f"{c} {w}".strip() for w in [*words, "zzz"])]]
    rows = [*enumerate(train), *((100 + i, t) for i, t in enumerate(ask))]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") >= 100).collect()
    model = check(got, rows, lambda i: i >= 100)
    # a text's probability is that of its words times that of its end: with the
    # formula's end taken out, what is left is that of the words
    by_text = {dict(rows)[r.doc_id]: r.score for r in got}
    unseen = model.v + 1

    def prefix(t):
        toks = ["<s>", *t.split()]
        return by_text[t] - math.log10(model.p3(*([toks[-2], toks[-1]] if len(toks) > 1 else ["<s>", None]), None) if len(toks) > 1 else 1.0)

    for c in contexts:
        before = prefix(c)
        mass = 10 ** (by_text[c] - before) + sum(10 ** (prefix(f"{c} {w}") - before) * (unseen if w == "zzz" else 1) for w in [*words, "zzz"])
        assert mass <= 1.35  # both sides are rounded down, the context by up to 0.04 a token
        exact = model.p3(*(["<s>", *c.split()][-2:]), None) + sum(model.p3(*(["<s>", *c.split()][-2:]), w) for w in words) + unseen * model.p3(*(["<s>", *c.split()][-2:]), "zzz")
        assert exact == pytest.approx(1)
    assert model.p1("zzz") < model.p1("d") * 0.999


def test_no_training_text_and_empty_tables(spark, docs):
    got = lm.score(docs, F.lit(True)).collect()
    assert {(r.n_known, r.train_tokens, r.score) for r in got} == {(0, 0, 0.0)}
    assert lm.score(docs.where("false"), F.lit(False)).count() == 0
    assert lm.train_and_score(docs, F.lit(False))[1].count() > 0


def test_null_and_repeated_ids_and_a_long_text(spark):
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(3000)}" for _ in range(60_000))
    rows = [(1, "a b c"), (1, "a b d"), (None, "a b c"), (None, "a b c"), (7, long)]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False), lm.Settings(block_bytes=1000, shard_tokens=5000)).collect()
    model = Brute([tokens(t) for _, t in rows])
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 4), (0, 4), (1, 4), (1, 4), (7, 60_001)]
    score = next(r.score for r in got if r.doc_id == 7)
    assert model.score(tokens(long)) - 0.08 * 60_001 <= score <= model.score(tokens(long)) + 1e-6


def test_held_out_texts_beat_the_base_score(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no tables")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm.score(docs, fold(F.col("doc_id"), 7) == 2).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert got.s / got.n > got.b / got.n
