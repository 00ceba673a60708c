import random

import numpy as np
from helpers import components

from locusmill.llm import _tables, jaccard
from locusmill.llm import components as cc


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeXY") for _ in range(rng.randrange(1, 6)))
    docs, line = {}, " ".join(word() for _ in range(30))
    for i in range(n):
        if docs and rng.random() < 0.6:
            w = rng.choice(list(docs.values())).split(" ")
            for _ in range(rng.randrange(0, 1 + len(w) // 15)):
                w[rng.randrange(len(w))] = word()
            docs[i] = " ".join(w) if rng.random() < 0.8 else " ".join(w).upper()
        else:
            docs[i] = " ".join(word() for _ in range(rng.randrange(1, 80))) + (" " + line if rng.random() < 0.5 else "")
    docs[n], docs[n + 1], docs[n + 2], docs[n + 3], docs[n + 4] = "a b c", "A  b\tc", "", None, "   "
    return docs


def found(df, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, **options).collect()}


def test_against_all_pairs(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        df = spark.createDataFrame(sorted(docs.items()), "doc_id long, text string").repartition(4)
        assert found(df) == components(docs)


def test_small_blocks_and_cells(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "REGION", 4)
    monkeypatch.setattr(_tables, "BROADCAST_BYTES", 0)
    docs = corpus(5)
    df = spark.createDataFrame(sorted(docs.items()), "doc_id long, text string")
    assert found(df) == components(docs)


def test_close_pairs_lose_nothing():
    rng = np.random.default_rng(0)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 2**63, rng.integers(20, 200), dtype=np.uint64)
        for _ in range(6):
            s = base.copy()
            at = rng.random(len(s)) < rng.choice([0.0, 0.05, 0.1, 0.2])
            s[at] = rng.integers(0, 2**63, at.sum(), dtype=np.uint64)
            sets.append(np.unique(s))
    n, label = np.array([len(s) for s in sets]), rng.integers(0, 200, len(sets))
    want = set()
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            c = len(np.intersect1d(sets[i], sets[j]))
            if label[i] != label[j] and 100 * c >= 80 * (n[i] + n[j] - c):
                want.add((i, j))
    for cell in (8, 512):
        got, spare = jaccard.close_pairs([jaccard.parity_bits(s) for s in sets], n, label, 80, cell=cell)
        assert want <= set(map(tuple, got)) and len(got) < 3 * len(want) + 50 and (spare >= -1e-6).all()
    trees = jaccard.forest(got, spare, label)
    assert len(trees) <= 2 * len(np.unique(label))


def test_cells_are_cut_on_documents(spark):
    """All documents of a table as one region: cells spare most comparisons and lose no link."""
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    import pyarrow as pa

    from locusmill.llm._words import shingle_sets

    sets = [s for s in shingle_sets(pa.array(list(docs.values())), 5) if len(s)]
    n, label, told = np.array([len(s) for s in sets]), np.arange(len(sets)), {}
    got, _ = jaccard.close_pairs([jaccard.parity_bits(s) for s in sets], n, label, 80, told=told)
    got = set(map(tuple, got))
    where = {}
    for i, s in enumerate(sets):
        for x in s.tolist():
            where.setdefault(x, []).append(i)
    common = {}
    for ids in where.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                common[a, b] = common.get((a, b), 0) + 1
    want = {p for p, c in common.items() if 100 * c >= 80 * (n[p[0]] + n[p[1]] - c)}
    assert want and want <= got
    assert told["cells"] > 10 and told["compared"] < told["pairs"], told


def test_edges(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_duplicates(df).count() == 0
    df = spark.createDataFrame([(5, "a b c d e f", "x"), (5, "a b c d e f", "x"), (3, "A B C D E F", None), (None, "a b c d e f", "y"), (None, None, "z")], "doc_id long, text string, n string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard.near_duplicates(df).collect())
    assert got == [(-1, 0, -1), (-1, 2, 3), (3, 2, 3), (5, 2, 3), (5, 2, 3)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(30)] + [(7, 7), (None, 3)]
    got = {r.node: r.label for r in cc.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}
    root = lambda x: x if up.setdefault(x, x) == x else root(up[x])
    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    assert got == {x: root(x) for x in up}
    assert cc.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
