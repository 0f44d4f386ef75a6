"""Ball-tree search against scoring every document, on its own and as a query on odd rows."""

import math
import re

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, score string, rank int, n string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items, k=50):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n_docs, n_terms, df = len(held), sum(len(t) for _, t in held), {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    asked = {}
    for i, t in items:
        if t is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        found = []
        for i, t in held:
            m = 50 + 50 * len(t) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * t.count(x) // (1000 * t.count(x) + 20 * m)) for x in own if x in t)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def docs():
    r = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)] + ["É", "the", "THE", "ärger"]
    p = 1 / np.arange(1, len(words) + 1)
    own = [(i, " ".join(r.choice(words, r.integers(1, 60), p=p / p.sum()))) for i in range(400)]
    own += [(500, None), (501, ""), (502, " ,.\n"), (None, "w3 w7"), (None, "w3 w7"), (None, "w3-w7"), (503, "w3 w7"), (503, "w3 w7"), (504, "W3_w7"), (505, "the " * 400_000 + "w250"), (506, "x" * 3_000_000 + " w250")]
    return own + [(600 + i, "w3 w7 w250") for i in range(70)]


ITEMS = [(1, "w3 w7 W250, the É?"), (2, None), (3, ""), (4, "nowhere"), (5, "w1 w1 w1"), (6, "w299 w298 w297 w250"), (6, "w11"), (None, "w20 w21"), (7, "w3"), (7, "w3"), (8, " ".join(f"w{i}" for i in range(300)))]


@pytest.mark.parametrize("item_bytes, tree_docs, leaf", [(4 << 20, 4096, 32), (20, 64, 4), (1, 10, 1)])
def test_search_equals_scoring_everything(spark, docs, item_bytes, tree_docs, leaf):
    from mdcorpus.llm.balltree import ranked

    table = spark.createDataFrame([(*d, "s", 1, "n") for d in docs], SCHEMA).repartition(3)
    items = spark.createDataFrame([(*i, 5) for i in ITEMS], "item_id long, text string, doc_id long")
    got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in ranked(table, items, item_bytes=item_bytes, tree_docs=tree_docs, leaf=leaf).collect()]
    assert sorted(got, key=repr) == expected(docs, ITEMS)


def test_empty_tables(spark, docs):
    from mdcorpus.llm.balltree import ranked

    table, items = spark.createDataFrame([(1, "word", "s", 1, "n")], SCHEMA), spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert ranked(table.where("false"), items).collect() == []
    assert ranked(table, items.where("false")).collect() == []
    assert [tuple(r) for r in ranked(table, items).collect()] == [(1, 1, 1, math.floor(1000 * math.log(4 / 3)) * (10**9 // (1000 + 20 * 100)))]


def vectors(r, n, width, clustered):
    out = []
    for i in range(n):
        base = (i % 8) * (width // 8) if clustered else 0
        t = np.unique(base + r.integers(0, width // 8 if clustered else width, r.integers(1, 9)))
        out.append((np.full(len(t), i), t, r.integers(1, 10**10, len(t))))
    return (np.concatenate(x) for x in zip(*out))


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("clustered", [False, True])
def test_bounds_hold_and_the_best_are_found(seed, clustered):
    from mdcorpus.llm.balltree import Found, Tree

    r = np.random.default_rng(seed)
    n, width = 700, 400
    of, term, values = vectors(r, n, width, clustered)
    ids = r.permutation(n)
    tree = Tree.unpacked(Tree.of(of, term, values, ids, np.ones(n, bool), leaf=8).packed())
    dense = np.zeros((n, width), np.int64)
    dense[of, term] = values
    by_id = dense[np.argsort(ids)]  # row i: the document of id i
    for _ in range(20):
        asked = np.unique(r.integers(0, width, r.integers(1, 12)))
        local = np.flatnonzero(np.isin(tree.terms, asked))
        scores = by_id[:, asked].sum(axis=1)
        bound = tree.bounds(local)
        for i in range(len(tree.radius)):
            assert bound[i] >= scores[tree.ids[tree.first[i] : tree.last[i]]].max()
        found = Found(10)
        tree.search(local, found)
        best = [i for i in np.lexsort((np.arange(n), -scores)) if scores[i] > 0][:10]
        assert found.ids.tolist() == best and found.scores.tolist() == scores[best].tolist()


def test_far_balls_are_not_opened():
    """Of eight groups without a common term an item of one group opens that group's leaves alone."""
    from mdcorpus.llm.balltree import Found, Tree

    r = np.random.default_rng(1)
    of, term, values = vectors(r, 2000, 800, True)
    tree = Tree.of(of, term, values, np.arange(2000), np.ones(2000, bool), leaf=8)
    leaves = int((tree.low < 0).sum())
    opened = tree.search(np.flatnonzero((tree.terms >= 100) & (tree.terms < 110)), Found(5))
    assert 0 < opened < leaves / 4


def test_many_equal_documents_make_a_tree():
    from mdcorpus.llm.balltree import Found, Tree

    n = 1000
    tree = Tree.of(np.arange(n), np.zeros(n, np.int64), np.full(n, 7), np.arange(n)[::-1], np.ones(n, bool))
    assert (tree.last - tree.first)[tree.low < 0].max() <= 32
    found = Found(3)
    tree.search(np.array([0]), found)
    assert found.ids.tolist() == [0, 1, 2] and found.scores.tolist() == [7, 7, 7]
