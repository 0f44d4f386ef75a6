"""The quality classifier's features and its boosting steps in plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from mdcorpus.llm import quality as Q

SPACE = b" \t\n\v\f\r"


def by_hand(text: bytes) -> list[float]:
    words = text.split()
    if not words:
        return [0.0] * len(Q.FEATURES)
    w, c = len(words), max(1, len(text))
    of = lambda chars: sum(b in chars for b in text)
    upper, lower, digit = (bytes(range(a, b)) for a, b in ((65, 91), (97, 123), (48, 58)))
    symbols = [b for b in text if 33 <= b < 127 and b not in upper + lower + digit + b".?,;:'\"-|!"] + [b for b in text if b == 127]
    letter = lambda b: b in upper or b in lower or b >= 128
    lines = [x for x in text.split(b"\n") if x]
    capital = [x for x in words if len(x) > 1 and any(map(letter, x)) and not any(b in lower or b >= 128 for b in x)]
    ends = [x for x in words if x[-1] in b"!" or (33 <= x[-1] <= 127 and x[-1] not in upper + lower + digit + b".?,;:'\"-|!")]
    return [
        math.log1p(w), sum(map(len, words)) / w, math.log1p(max(map(len, words))), of(upper) / c, of(lower) / c, of(digit) / c, len(symbols) / c, of(b"|") / w, of(b"!") / w, of(b".?") / w, of(b",;:'\"-") / w, sum(b >= 128 for b in text) / c,
        text.count(b"\n") / w, len(set(words)) / w, max(Counter(words).values()) / w, 1 - len(set(lines)) / max(1, len(lines)), sum(not any(map(letter, x)) for x in words) / w, len(ends) / w, len(capital) / w,
    ]


def texts():
    r = random.Random(4)
    pieces = ["word", "Word", "WORD", "É", "ünd", "1", "42!", "|", "--", "a|b", "!!!", "x.", "y?", ",", "\n", "\n\n", "\t", "  ", "#tag#", "(", "Ab", "B2", "the", "the"]
    yield from ("", " ", "\n\t ", "x", "|", "É", "a\na\n\nb\na", "LONG " * 3 + "long")
    for _ in range(150):
        yield "".join(r.choice(pieces) + r.choice([" ", "", "\n"]) for _ in range(r.randrange(1, 60)))


def test_features_by_hand():
    held = [t.encode() for t in texts()]
    held.append(b"Some words | of a long text! 12\n" * 60_000)  # longer than what is looked at together
    got = Q.features(held)
    for t, row in zip(held, got):
        for name, a, b in zip(Q.FEATURES, row, by_hand(t)):
            assert math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12), (name, t[:80])
    assert np.array_equal(got, np.concatenate([Q.features([t]) for t in held]))  # whatever stands beside a text


def leaves_by_hand(b, g, h, n):
    """Greedy cuts, each the best of all cuts of all leaves, at most LEAVES leaves."""
    gain = lambda G, H: G * G / (H + Q.RIDGE)
    total = lambda v, lo, hi: float(sum(x for x, k in zip(v, b) if lo <= k < hi))
    ones, cuts = [1.0] * len(b), [0, n]
    while len(cuts) <= Q.LEAVES:
        best = (1e-9, None)
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            for at in range(lo + 1, hi):
                if min(total(ones, lo, at), total(ones, at, hi)) >= Q.LEAST_ROWS:
                    own = gain(total(g, lo, at), total(h, lo, at)) + gain(total(g, at, hi), total(h, at, hi)) - gain(total(g, lo, hi), total(h, lo, hi))
                    if own > best[0]:
                        best = (own, at)
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    return [total(g, lo, hi) / (total(h, lo, hi) + Q.RIDGE) for lo, hi in zip(cuts[:-1], cuts[1:]) for _ in range(hi - lo)]


@pytest.mark.parametrize("seed", range(8))
def test_a_boosting_step_by_hand(seed):
    r = np.random.default_rng(seed)
    n, b = 12, r.integers(0, 12, 150)
    y, logit = (r.random(150) < 0.2 + 0.6 * (b > 5)).astype(float), r.normal(0, 1, 150)
    p = 1 / (1 + np.exp(-logit))
    g, h = Q._slopes(y, logit)
    assert np.allclose(g, y - p) and np.allclose(h, p * (1 - p))
    assert np.allclose(Q._leaves(b, g, h, n), leaves_by_hand(b, g, h, n))


@pytest.mark.parametrize("seed", range(8))
def test_a_pair_step_by_hand(seed):
    r = np.random.default_rng(seed)
    i, j = (r.integers(0, Q.PAIR_BINS, 300) for _ in range(2))
    y = (r.random(300) < 0.15 + 0.7 * ((i > 3) ^ (j > 2))).astype(float)
    g, h = Q._slopes(y, r.normal(0, 0.5, 300))
    gain = lambda k: g[k].sum() ** 2 / (h[k].sum() + Q.RIDGE)
    best, want = 0.0, np.zeros((Q.PAIR_BINS, Q.PAIR_BINS))
    for a in range(Q.PAIR_BINS - 1):
        for b in range(Q.PAIR_BINS - 1):
            parts = [[(x <= a) == u and (z <= b) == v for x, z in zip(i, j)] for u in (True, False) for v in (True, False)]
            parts = [np.flatnonzero(k) for k in parts]
            if min(map(len, parts)) >= Q.LEAST_ROWS:
                own = sum(map(gain, parts)) - gain(np.arange(300))
                if own > best:
                    value = [g[k].sum() / (h[k].sum() + Q.RIDGE) for k in parts]
                    best, want = own, np.array([[value[2 * (x > a) + (z > b)] for z in range(Q.PAIR_BINS)] for x in range(Q.PAIR_BINS)])
    got, gain_got = Q._quadrants(i, j, g, h)
    assert np.allclose(got, want) and math.isclose(gain_got, best, rel_tol=1e-9, abs_tol=1e-9) and best > 0


def test_the_sample_is_the_first_by_hash(spark):
    """What is fitted: labelled rows that aren't held out, up to a number, the first by a hash of their ids; null labels none."""
    import zlib

    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, f"{'Good words here.' if i % 2 else '|| bad 1'} {i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2 if i % 7 else None) for i in range(300)], "doc_id long, quality int")
    can = [i for i in range(300) if i % 7 and zlib.crc32(str(i).encode()) % 3 != 1]
    first = [r.doc_id for r in spark.createDataFrame([(i,) for i in can], "doc_id long").orderBy(F.xxhash64("doc_id")).limit(60).collect()]
    own = {r.doc_id: r.text.encode() for r in docs.collect()}
    order = sorted(first)
    want = Q.Model(Q.features([own[i] for i in order]), np.array([i % 2 for i in order], float))
    got = Q.fit(docs, labels, rows=60)
    assert got.intercept == want.intercept and all((a == b).all() for a, b in zip(got.tables, want.tables)) and got.pairs == want.pairs
