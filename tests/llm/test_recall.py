"""Recall of the vector hashing at the settings for many vectors, on planted pairs."""

import numpy as np
import pytest

from mdcorpus.llm.vectors import bucket_keys, hashing


def pairs(cosine, n, width, seed=8):
    r = np.random.default_rng(seed)
    a, b = (r.standard_normal((n, width)) for _ in range(2))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, cosine * a + np.sqrt(1 - cosine**2) * b


@pytest.mark.parametrize("vectors", [800, 51_000, 10**6, 10**8])
@pytest.mark.parametrize("cosine, least", [(0.9, 0.92), (0.92, 0.975), (0.95, 0.998), (0.99, 1.0)])
def test_planted_pairs_share_a_bucket(vectors, cosine, least):
    tables, projections = hashing(vectors)
    a, b = pairs(cosine, 2000, 64)
    met = np.concatenate([(bucket_keys(a[s : s + 250], tables, projections) == bucket_keys(b[s : s + 250], tables, projections)).any(axis=1) for s in range(0, 2000, 250)])
    assert met.mean() >= least, (tables, projections, met.mean())


@pytest.mark.parametrize("vectors", [51_000, 10**6])
def test_few_others_share_a_bucket(vectors):
    """Vectors at right angles meet seldom enough that a bucket of one table holds few of them."""
    tables, projections = hashing(vectors)
    a, b = pairs(0.0, 2000, 64)
    met = np.concatenate([(bucket_keys(a[s : s + 250], tables, projections) == bucket_keys(b[s : s + 250], tables, projections)).mean(axis=1) for s in range(0, 2000, 250)])
    assert met.mean() * vectors < 3000
