"""The ten operators against brute force, on small tables with nulls, empties, ties and repeats."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from chronoweave.llm import bpe, chat, langid, mixing, neardup, quality, suffixdedup, topk, toxicity
from chronoweave.llm.eliasfano import EliasFano, Trie
from chronoweave.llm.suffixarray import suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    said = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = said(60)
    out = [None, "", " \n\t", "one", "One two\tthree", "a b c d e", "A b C d e", "###", said(4000)]
    for _ in range(12):
        base = said(rng.randint(20, 120))
        out += [base, base, base + " " + said(2), said(5) + " " + shared + " " + said(9)]
        words = base.split()
        words[rng.randrange(len(words))] = "edit"
        out.append(" ".join(words) + "\n" + " ".join(words))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][i % 3], ["b", "a", None][i % 3], i, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, size bigint, quota string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_mixing(docs, empty, texts):
    got = mixing.mix_quotas(docs).toPandas()
    size = {i: len(WORD.findall(t or "")) for i, t in enumerate(texts)}
    assert dict(zip(got.doc_id, got["size"], strict=True)) == size
    assert (got.taken <= 2 * got["size"]).all()
    for _, g in got.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 3 * 32
        assert g.target.iloc[0] <= 2 * g["size"].sum()
    assert got.target.groupby(got.source, dropna=False).first().sum() == pytest.approx(1.5 * sum(size.values()))
    again = mixing.mix_quotas(docs.repartition(5)).toPandas()
    assert got.set_index("doc_id").taken.sort_index().equals(again.set_index("doc_id").taken.sort_index())
    mixed = mixing.mixed_texts(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert {k: v for k, v in zip(got.doc_id, got.taken, strict=True) if v} == {k: v for k, v in words.items() if v}
    assert mixing.mix_quotas(empty).count() == 0


def test_sainte_lague(spark):
    rng = random.Random(1)
    for _ in range(4):
        rows = [(i, float(rng.randint(1, 50)), rng.randint(0, 30), i, 0) for i in range(9)]
        total = rng.randint(0, 150)
        got = mixing.sainte_lague(spark.createDataFrame([(*r[:4], total) for r in rows], "id int, w double, cap long, pos int, total long"), [], "total").toPandas()
        won = Counter()
        for _ in range(min(total, sum(r[2] for r in rows))):
            best = max((r for r in rows if won[r[0]] < r[2]), key=lambda r: (r[1] / (2 * won[r[0]] + 1), -r[3]))
            won[best[0]] += 1
        assert {r.id: r.quota for r in got.itertuples()} == {r[0]: won[r[0]] for r in rows}


def test_language(spark, docs, empty):
    rng = random.Random(2)
    made = {"xx": ["la", "le", "que", "ou"], "yy": ["der", "sch", "ung", "ist"]}
    rows = [(i, " ".join(rng.choice(made[k]) for _ in range(rng.randint(3, 60))), k) for i in range(300) for k in made]
    table = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    model = langid.train(table.where("doc_id < 200"))
    got = langid.predict(table, model, keep=("doc_id", "lang")).where("doc_id >= 200").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all()
    rest = langid.predict(docs, model).toPandas().set_index("doc_id")
    assert list(rest.lang_pred[[0, 1, 2, 7]]) == ["und"] * 4
    assert rest.score[0] == 0
    assert set(langid.predict(docs, langid.train(empty)).toPandas().lang_pred) == {"und"}


def test_chat(spark):
    said = "</s>[INST] <|x1|> <|im_end|> [/INST]<s>"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 2, None, None), (2, 0, "assistant", ""), (None, 0, "user\n<|", "a"), (3, 1, "user", "b"), (3, 0, "system", "é")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = chat.segments(table)
    got = {r["conv_id"]: r for r in chat.read_back(parts).collect()}
    for c in (1, 2, None, 3):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
        want = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert got[c]["loss_chars"] == len(loss)
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert [got[c]["valid"] for c in (1, 2, 3)] == [False, False, True]
    whole = "".join(r["text"] for r in sorted(parts.where("conv_id = 1").collect(), key=lambda r: r["segment"]))
    assert whole.count("</s>") == whole.count("[INST]") == 0
    assert whole.count("<|im_end|>") == 3
    assert chat.read_back(chat.segments(table.where("false"))).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, u in ((0, 1), (1, 1), (5, 3), (1000, 10**6), (5000, 10**12)):
        v = np.sort(rng.integers(0, u, n))
        e = EliasFano.build(v)
        assert (e.get(np.arange(n)).astype(np.int64) == v).all()
        x = np.concatenate([rng.integers(0, u + 5, 500), v])
        at, exact = e.successor(x)
        assert (at == np.searchsorted(v, x)).all()
        assert (exact == np.isin(x, v)).all()
    words = np.unique(rng.integers(0, 2**64, 60, dtype=np.uint64))
    three = np.unique(rng.integers(0, [60, 20, 40], (4000, 3)), axis=0)
    three = three[three[:, 0] < len(words)]
    two = np.unique(three[:, [0, 2]], axis=0)
    code2, code3 = rng.integers(1, 255, len(two)), rng.integers(1, 255, len(three))
    near = np.unique(rng.integers(0, 2**40, 100, dtype=np.uint64))
    share = (three[:, 0] * 7 + three[:, 1]) % 250
    t = Trie.mapped(Trie.build(words, np.arange(len(words)), (two[:, 0], near[two[:, 1]], code2), (three[:, 0], near[three[:, 1]], near[three[:, 2]], code3, share)).to_bytes())
    assert (t.codes1 == np.arange(len(words))).all()
    known2 = {tuple(k): c for k, c in zip(two.tolist(), code2, strict=True)}
    known3 = {tuple(k): c for k, c in zip(three.tolist(), code3, strict=True)}
    known_pair = {(v, u) for v, u, _ in known3}
    for sparse in (1, 40):
        ask = np.array([(v, u, w) for v in range(len(words)) for u in range(22) for w in range(42)])[::sparse]
        at, there = t.find(np.append(words[ask[:, 0]], np.uint64(5)))
        assert there[:-1].all()
        assert not there[-1]
        c2, place = t.pairs(at[:-1], there[:-1], near[ask[:, 2]])
        c3, s3 = t.triples(at[:-1], there[:-1], near[ask[:, 1]], place)
        assert c2.tolist() == [known2.get((v, w), 0) for v, _, w in ask.tolist()]
        assert c3.tolist() == [known3.get((v, u, w), 0) for v, u, w in ask.tolist()]
        assert s3.tolist() == [(v * 7 + u) % 250 if (v, u) in known_pair else 255 for v, u, _ in ask.tolist()]


def test_toxicity(spark, docs, empty):
    rng = random.Random(4)
    clean = ["sun", "tree", "house", "walk", "river", "stone", "cloud"]
    rows = []
    for i in range(400):
        said = [" ".join(rng.choice(clean) for _ in range(6)) for _ in range(8)]
        bad = i % 4 == 0
        if bad:
            said[3] += " " + rng.choice(["vilename", "vilething"])
        rows.append((i, ". ".join(said) + ".", int(bad)))
    table = spark.createDataFrame(rows, "doc_id int, text string, toxic int")
    model = toxicity.train(table.where("doc_id < 300"), table.select("doc_id", "toxic"))
    got = toxicity.score(table, model, keep=("doc_id", "toxic")).where("doc_id >= 300").toPandas()
    assert (got.predicted == got.toxic).all()
    found = toxicity.locate(table.where("doc_id >= 300"), model).toPandas()
    assert len(found) == 25
    assert (found.sentence == 3).all()
    assert found.sentence_text.str.contains("vile").all()
    rest = toxicity.score(docs, model).toPandas().set_index("doc_id")
    assert list(rest.score[[0, 1]]) == [0, 0]
    assert (toxicity.score(docs, toxicity.train(empty, table)).toPandas().predicted == 0).all()


def test_suffix_array():
    rng = random.Random(7)
    for _ in range(400):
        s = [rng.randint(1, 3) for _ in range(rng.randint(0, 40))]
        assert suffix_array(np.array(s, int)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize(("length", "gram"), [(200, 64), (48, 16)])
def test_passages(docs, texts, empty, length, gram):
    got = suffixdedup.repeated_passages(docs.repartition(3), suffixdedup.Settings(length, gram), with_text=True).toPandas().set_index("doc_id")
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    for i, b in enumerate(data):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((gone[1:] & ~gone[:-1]).sum() + (gone[0] if len(gone) else 0))
        assert (got.n_bytes[i], got.n_removed[i], got.n_spans[i]) == (len(b), gone.sum(), runs)
        assert got.kept_sha256[i] == hashlib.sha256(kept).hexdigest()
        assert got.kept_text[i] == kept.decode("utf-8", "ignore")
    assert suffixdedup.repeated_passages(empty).count() == 0


def test_top_k(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    x = rng.normal(0, 0.1, (700, 16)).astype(np.float32)
    x[5:9] = x[4]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(700, None), (800, [float("nan")] * 16), (900, [0.1, None])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(table, F.col("vec_id") % 100 == 0, topk.Settings(block=256, queries=3)).toPandas()
    q = np.floor(1024 * x.astype(np.float64)).astype(np.int64)
    for i in range(0, 700, 100):
        score = q @ q[i]
        want = sorted((j for j in range(700) if j != i), key=lambda j: (-score[j], j))[:10]
        own = got[got.query_id == i].sort_values("rank")
        assert own.vec_id.tolist() == want
        assert own.score.tolist() == score[want].tolist()
    assert len(got) == 70
    assert topk.top_k(table.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_bpe(spark, docs, texts, empty):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(ranks)}, special_tokens={})
    odd = ["it's 12  3\n\n x", "  a", "é\U0001f600\x00\x1c", "x" * 5000]
    both = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    got = bpe.encode(both, path, P.PATTERN).toPandas().set_index("doc_id").ids
    for i, t in [*enumerate(texts), *((1000 + i, t) for i, t in enumerate(odd))]:
        assert list(got[i]) == known.encode_ordinary(t or "")
    back = bpe.decode(bpe.encode(both, path, P.PATTERN), path, P.PATTERN).toPandas().set_index("doc_id").decoded
    assert all(bytes(back[i]) == (t or "").encode() for i, t in enumerate(texts))
    digest = bpe.digests(both, path, P.PATTERN).toPandas().set_index("doc_id")
    ids = known.encode_ordinary(texts[8])
    assert digest.n_tokens[8] == len(ids)
    assert digest.ids_sha256[8] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert digest.decoded_sha256[8] == hashlib.sha256(texts[8].encode()).hexdigest()
    assert bpe.digests(empty, path, P.PATTERN).count() == 0


def test_near_duplicates(docs, texts, empty):
    sets = {}
    for i, t in enumerate(texts):
        w = WORD.findall(lower(t or ""))
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = neardup.near_duplicates(docs.repartition(3)).toPandas().set_index("doc_id")
    for i in sets:
        assert (got.n_shingles[i], got.component_id[i], got.kept[i]) == (len(sets[i]), find(i), find(i) == i)
    assert neardup.near_duplicates(empty).count() == 0


def test_super_minhash_estimates():
    rng = np.random.default_rng(1)
    agree = []
    for _ in range(60):
        common, a, b = (rng.integers(1, 2**63, n).astype(np.uint64) for n in (60, 20, 20))
        flat, first = np.concatenate([common, a, common, b]), np.array([0, 80, 160])
        s = neardup.super_minhash(flat, first, 128)
        assert np.isfinite(s).all()
        agree.append((s[0] == s[1]).mean())
    assert np.mean(agree) == pytest.approx(0.6, abs=0.02)


def test_clusters_without_a_hub(spark):
    """A chain of texts, each near the next only, is one component."""
    words = [f"w{i}" for i in range(700)]
    chain = [" ".join(words[i : i + 200]) for i in range(0, 480, 20)]
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string")).toPandas()
    assert set(got.component_id) == {0}


def test_quality(docs, texts, empty):
    got = quality.judge(docs, docs.where("doc_id > 8")).toPandas().set_index("doc_id")
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        spans = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        c = Counter(spans)
        again = {p for k, s in enumerate(spans) if c[s] > 1 for p in range(k, k + 5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got.loc[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w))
        assert not (r.kept and r.base_failed)
    assert quality.judge(empty, empty).count() == 0


def test_quality_rejects_junk_that_passes_the_base_rules(spark):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(30)]
    good = [[rng.choice(vocab) for _ in range(150)] for _ in range(300)]
    junk = [[w + rng.choice("#*%&") * 3 if rng.random() < 0.25 else w for w in rng.choices(vocab, k=150)] for _ in range(30)]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(good + junk)], "doc_id long, text string")
    got = quality.judge(table, table.where("doc_id < 200"), quality.Rules(buckets=1024)).toPandas().set_index("doc_id").sort_index()
    assert not got.base_failed.any()
    assert (got.score[300:] > -0.35).all()
    assert not got.kept[300:].any()
    assert got.kept[:300].all()
    few = quality.judge(table, table.where("doc_id = 0")).toPandas()
    assert few.kept.all()


def test_chat_repeated_and_tied_turns_and_a_long_conversation(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", "s")]
    rows += [(2, i, ["user", "assistant"][i % 2], f"turn {i} <|im_end|>") for i in range(30_000)]
    got = {r.conv_id: r for r in chat.read_back(chat.segments(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5))).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"system\ns\nuser\na\nuser\na\nuser\nb\n").hexdigest()
    assert (got[1].n_turns, got[1].valid, got[2].n_turns, got[2].valid) == (4, False, 30_000, True)
    said = "".join(f"turn {i} <|im_end|>" for i in range(1, 30_000, 2))
    assert got[2].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
