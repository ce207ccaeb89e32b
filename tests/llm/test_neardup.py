"""Near duplicates: repeated and null ids, clusters of many blocks, components by stars, whole rows kept."""

import random
import re

import numpy as np
import pytest

from chronoweave.llm import neardup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def groups(rows):
    """The component of each row, by the numbers of the rows."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sets, [find(i) for i in range(len(rows))]


def check(spark, rows, settings=neardup.Settings()):
    sets, root = groups(rows)
    want = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        name = doc if not sets[i] else min(ids, default=None)
        want.append((doc, len(sets[i]), name, name is None or doc == name))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in neardup.near_duplicates(table.repartition(3), settings).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = sorted(((r.doc_id, r.text) for r in neardup.representatives(table, settings).collect()), key=str)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if sets[i]:
            least.setdefault(root[i], []).append(((doc is None, doc or 0), i))
    ids = sorted([rows[min(v)[1]][0] for v in least.values()] + [rows[i][0] for i in range(len(rows)) if not sets[i]], key=str)
    assert sorted((k[0] for k in kept), key=str) == ids
    assert set(kept) <= set(rows)


def test_different_texts_under_one_id_lose_no_link(spark):
    rng = random.Random(1)
    a, b = (" ".join(rng.choice("klmnopq") + str(rng.randrange(99)) for _ in range(60)) for _ in range(2))
    check(spark, [(1, a), (1, b), (2, b), (3, b + " more")])


def test_null_ids_repeated_rows_and_texts_without_words(spark):
    rng = random.Random(2)
    a, b, c = (" ".join(rng.choice("klmnopq") + str(rng.randrange(99)) for _ in range(50)) for _ in range(3))
    check(spark, [(5, a), (None, a), (None, a + " x"), (None, b), (None, b), (7, c), (7, c), (8, ""), (8, None), (None, " "), (9, "one two"), (4, "One TWO"), (3, "one two three four")])


@pytest.mark.parametrize("unit", [8, 256])
def test_a_cluster_of_many_blocks(spark, unit):
    """Edits of one text, of which some are near each other and none is near all."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(80)] = f"e{rng.randrange(4)}"
        rows.append((i, " ".join(w)))
    check(spark, rows, neardup.Settings(unit=unit, block=unit))


def test_components_by_stars(spark):
    rng = random.Random(4)
    path = [(i, i + 1) for i in range(1500)]
    rng.shuffle(path)
    tree = [(10_000 + i, 10_000 + rng.randrange(i)) for i in range(1, 900)]
    loose = [(20_000 + rng.randrange(900), 20_000 + rng.randrange(900)) for _ in range(500)]
    edges = path + tree + loose
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {x: find(x) for x in root if find(x) != x}
    for per_task in (400, 10**6):
        got = neardup.components(spark.createDataFrame(edges, "a long, b long").repartition(5), per_task).collect()
        assert len(got) == len({r.node for r in got})
        assert {r.node: r.component for r in got if r.node != r.component} == want


def test_banding_finds_pairs_at_the_threshold():
    """Of pairs with a similarity of exactly 0.75, all share a band and none agrees too little for a comparison."""
    s = neardup.Settings()
    rng = np.random.default_rng(5)
    missed, least = 0, 1.0
    for _ in range(400):
        common, a, b = (rng.integers(1, 2**63, n).astype(np.uint64) for n in (150, 25, 25))
        sig = neardup.super_minhash(np.concatenate([common, a, common, b]), np.array([0, 175, 350]), s.slots)
        same = (sig[0] == sig[1]).reshape(s.bands, s.rows)
        missed += not same.all(1).any()
        least = min(least, same.mean())
    assert missed == 0
    assert least >= s.least_agreement


def test_extra_columns_with_clashing_names_stay(spark):
    rows = [(1, "a b c d e f", "x", 1), (2, "a b c d e f", "y", 2), (3, None, "z", 3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, row string, `cls.name` int")
    got = neardup.representatives(table)
    assert got.columns == table.columns
    assert sorted(map(tuple, got.collect())) == [rows[0], rows[2]]
    assert neardup.representatives(table.where("false")).count() == 0
