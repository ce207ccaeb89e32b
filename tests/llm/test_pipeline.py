"""Each stage of the pipeline against plain Python, with null and repeated ids, and the whole."""

import hashlib
import random
import re
from collections import Counter

import pytest

import corpus_pipeline as cp
from chronoweave.llm import mixing, toxicity
from test_neardup import groups
from test_passages import brute

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, `score` double"


def rows():
    rng = random.Random(9)
    vocab = ["".join(rng.choice("bcdfgaeiou") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = say(70)
    out = []

    def add(doc, text):
        i = len(out)
        out.append((doc, text, "en", ["a", "b", None][i % 3], None if text is None else len(text), f"r{i}", float(i)))

    for i in range(120):
        base = say(rng.randint(30, 90))
        bad = i % 4 == 0
        add(i, base + (" . you vilename here" if bad else ""))
        if i % 6 == 1:
            add(1000 + i, base + " " + say(1))
        if i % 10 == 2:
            add(i, say(40))  # another text under the same id
        if i % 10 == 3:
            add(None, base)
        if i % 10 == 5:
            add(2000 + i, say(12) + " " + shared + " " + say(12))
            add(None, say(12) + " " + shared + " " + say(12))
    for text in (None, "", " \n", "one", "one"):
        add(3000, text)
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i % 4 == 0)) for i in range(120) if i % 10 != 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, spark.read.parquet(f"{folder}/documents.parquet")


def key(r):
    return tuple(str(x) for x in r)


def test_toxicity_drops_what_the_model_rejects(spark, tables):
    folder, docs = tables
    got = cp.drop_toxic(spark, docs, folder)
    assert got.columns == docs.columns
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    bad = {r.row for r in toxicity.score(docs, model, keep=("row",)).where("predicted = 1").collect()}
    assert {r.row for r in got.collect()} == {r[5] for r in rows()} - bad
    assert bad == {r[5] for r in rows() if "vilename" in (r[1] or "")}


def test_one_row_of_each_group_stays(spark, tables):
    folder, docs = tables
    got = cp.drop_near_duplicates(spark, docs, folder)
    assert got.columns == docs.columns
    kept = {r.row for r in got.collect()}
    sets, root = groups([(r[0], r[1]) for r in rows()])
    by_root = {}
    for i, r in enumerate(rows()):
        by_root.setdefault(root[i] if sets[i] else f"alone {i}", []).append(r)
    for same in by_root.values():
        mine = [r for r in same if r[5] in kept]
        assert len(mine) == 1
        assert mine[0][0] == min((r[0] for r in same if r[0] is not None), default=None)


def test_passages_are_cut_from_every_row(spark, tables):
    folder, docs = tables
    got = {r.row: r for r in cp.cut_passages(spark, docs, folder).collect()}
    for r, (_, gone, _, _, text) in zip(rows(), brute([r[1] for r in rows()], 200), strict=True):
        if gone and not WORD.search(text):
            assert r[5] not in got
        else:
            want = r[1] if not gone else text
            assert got[r[5]].text == want
            assert got[r[5]].n_chars == (None if want is None else len(want))
            assert (got[r[5]].doc_id, got[r[5]].source, got[r[5]].score) == (r[0], r[3], r[6])


def test_the_mix_holds_the_quotas_words(spark, tables):
    folder, docs = tables
    got = cp.mix_sources(spark, docs, folder)
    assert got.columns == docs.columns
    taken = Counter()
    for r in got.collect():
        taken[r.source] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    for r in mixing.mix_quotas(docs).groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert taken[r["source"]] == r["sum(taken)"]
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 32
    words = {r[5]: Counter(WORD.findall(r[1] or "")) for r in rows()}
    twice = Counter()
    for r in got.collect():
        twice[r.row] += 1
        assert not Counter(WORD.findall(r.text)) - words[r.row]
    assert max(twice.values()) <= 2


def test_tokens_are_those_of_the_library(spark, tables):
    import public_tokenizers as P
    import tiktoken

    from chronoweave.llm import bpe

    folder, docs = tables
    ranks = bpe.read_ranks(P.path(cp.VOCABULARY))
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(ranks)}, special_tokens={})
    got = sorted((r.doc_id is None, r.doc_id or 0, r.source or "", list(r.ids), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in cp.encode_bytes(spark, docs, folder).collect())
    want = []
    for r in rows():
        ids = known.encode_ordinary(r[1] or "")
        want.append((r[0] is None, r[0] or 0, r[3] or "", ids, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_the_whole_and_an_empty_table(spark, tables, tmp_path):
    folder, docs = tables
    got = cp.run(spark, folder).collect()
    by_hand = docs
    for _, stage in cp.STAGES:
        by_hand = stage(spark, by_hand, folder)
        by_hand.write.parquet(str(tmp_path / stage.__name__))
        by_hand = spark.read.parquet(str(tmp_path / stage.__name__))
    assert sorted(map(key, got)) == sorted(map(key, by_hand.collect()))
    docs.where("false").write.parquet(str(tmp_path / "e/documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "e/labels.parquet"))
    assert cp.run(spark, str(tmp_path / "e")).count() == 0
