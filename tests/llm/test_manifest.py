"""The Merkle manifest against trees built level by level in plain Python."""

import hashlib
import zlib

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, pos long, key string"
h = lambda text: hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def way_and_root(nodes, at):
    """(siblings on both sides, level by level; the root) for the node at a place."""
    way = []
    while len(nodes) > 1:
        lo = at // 16 * 16
        way.append(("".join(nodes[lo:at]), "".join(nodes[at + 1 : lo + 16])))
        nodes, at = [h("".join(nodes[a : a + 16])) for a in range(0, len(nodes), 16)], at // 16
    return way, nodes[0]


def expected(rows):
    trees = {}
    for doc_id, text, lang, source, n_chars in rows:
        lowered = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        leaf = leaf_of(doc_id, source, lang, n_chars, text)
        chosen = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        trees.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf, leaf_of(doc_id, source, lang, n_chars, lowered) if chosen else leaf))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for t in trees.values():
        t.sort()
    roots = [way_and_root([x[2] for x in trees[s]], 0)[1] for s in order]
    out = []
    for i, s in enumerate(order):
        upper, root = way_and_root(roots, i)
        for k, (known, doc_id, leaf, start) in enumerate(trees[s]):
            way = way_and_root([x[2] for x in trees[s]], k)[0] + upper
            for before, after in way:
                start = h(before + start + after)
            out.append((doc_id if known else None, leaf, roots[i], root, h("".join(b + a for b, a in way)), start, start == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("height", [1, 2, 3])
def test_manifest_equals_trees_built_level_by_level(spark, height):
    from mdcorpus.llm.merkle import manifest_proofs

    rows = [(i * 7 % 1009, f"Text {i} OF it é", "en", "hot", i) for i in range(700)] + [(2000 + i, "X", None, f"s{i:02}", None) for i in range(40)]
    rows += [(5, "Own", "en", None, 3), (None, "A", "en", None, 1), (None, "A", "en", None, 1), (6, None, "fr", None, None), (7, "", "", "", 0), (7, "B", "", "", 0), (7, "B", "", "", 0), (8, "LONG text " * 20000, "de", "s01", 9), (-3, "Neg", "en", "Ä", 1)]
    docs = spark.createDataFrame([(*r, "x", 1, "k") for r in rows], SCHEMA).repartition(5)
    assert sorted(map(tuple, manifest_proofs(docs, height).collect()), key=repr) == expected(rows)


def test_manifest_of_few_rows(spark):
    from mdcorpus.llm.merkle import Manifest, manifest_proofs

    assert manifest_proofs(spark.createDataFrame([], SCHEMA)).collect() == []
    assert Manifest(spark.createDataFrame([], SCHEMA)).root is None
    one = [(1, "Only", "en", "a", 4)]
    got = manifest_proofs(spark.createDataFrame([(*r, "x", 1, "k") for r in one], SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == expected(one) and got[0].root == got[0].leaf and got[0].proof_sha256 == h("")


def test_stored_blocks_hold_every_node(spark):
    from mdcorpus.llm.merkle import Manifest, levels

    docs = spark.createDataFrame([(i, "t", "en", "a" if i else "b", 1, "x", 1, "k") for i in range(600)], SCHEMA)
    m = Manifest(docs, height=1)
    stored = m.stored().collect()
    of_a = sorted((r for r in stored if r.key == "sa"), key=lambda r: r.place)
    assert [r.place for r in of_a] == list(range(38 + 3 + 1)) and (of_a[0].round, of_a[0].block) == (2, 0)
    nodes = {(r.round, r.block): levels(r.digests, min(16, r.n - r.block * 16), 1) for r in of_a}
    for (k, b), held in nodes.items():  # a block's root is a lowest node of a block one round up
        if k < 2:
            above = nodes[(k + 1, b // 16)][0]
            assert above[b % 16 * 32 : b % 16 * 32 + 32] == held[1]


@pytest.mark.parametrize("n, height, fanout", [(1, 0, 16), (1, 3, 16), (16, 1, 16), (17, 2, 16), (300, 3, 16), (4096, 3, 16), (4095, 3, 16), (70, 7, 2), (81, 4, 3), (1, 4, 2)])
def test_addresses_are_a_layout(n, height, fanout):
    """Every node has a place of its own; each half is contiguous, and so is each lower subtree."""
    from mdcorpus.llm.merkle import address, size

    at = [address(n, height, k, np.arange(-(-n // fanout**k)), fanout) for k in range(height + 1)]
    assert sorted(np.concatenate(at).tolist()) == list(range(size(n, height, fanout)))
    assert at[height].tolist() == [0]
    if height:
        low = (height - 1) // 2
        upper = np.concatenate(at[low + 1 :])
        assert upper.max() + 1 == len(upper)
        for tree in range(-(-n // fanout**low)):
            own = np.concatenate([at[k][tree * fanout ** (low - k) : (tree + 1) * fanout ** (low - k)] for k in range(low + 1)])
            assert own.max() - own.min() + 1 == len(own)
