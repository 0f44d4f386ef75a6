"""Vectorised word work for use inside tasks: whole batches of texts become numpy arrays of word hashes.

Words are told apart by XXH64. `Spans` is a polynomial modulo 2**64, for uses in which a clash changes no result.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from xxhash import xxh64_intdigest


if TaskContext.get() is not None:  # in a Python worker Arrow shares one pool with numpy, which `give_back` empties
    pa.set_memory_pool(pa.system_memory_pool())


def give_back() -> None:
    """Return memory that is free to the system, so that a worker that waits for its next task holds little."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_SYMBOLS = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_powers: dict[int, np.ndarray] = {}

SPACES = np.ones(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = False  # word characters of `[^\x20\x09-\x0D]+`
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, and doubled in length where too short."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.ones(max(n, 1 << 16), U)
        have = 1
        while have < len(got):
            more = min(have, len(got) - have)
            got[have : have + more] = got[:more] * U(pow(base, have, 1 << 64))
            have += more
        _powers[base] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(29))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(32))


class Spans:
    """Hashes of any spans of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * powers(len(values), BASE), out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, U)
        down = powers(int(starts.max()) + 1, INVERSE)
        return mix((self.sums[ends] - self.sums[starts]) * down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def blocks(texts: list[bytes], most: int = 1 << 19):
    """Consecutive ranges of `texts` of about `most` bytes each (a longer text is a range of its own)."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def word_bounds(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate([[False], inside, [False]]).view(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hash_words(texts: list[bytes], word_bytes: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of each word of all texts in order, offsets: words of text i are [offsets[i], offsets[i+1]))."""
    if not texts:
        return np.zeros(0, U), np.zeros(1, np.int64)
    to_space = bytes(i if word_bytes[i] else 0x20 for i in range(256))
    lists = pc.ascii_split_whitespace(pa.array([t.translate(to_space) for t in texts], pa.binary()).view(pa.string()))
    words = lists.flatten()
    full = pc.binary_length(words).to_numpy() > 0
    edges = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(), dtype=np.int64)])
    coded = words.filter(pa.array(full)).cast(pa.binary()).dictionary_encode()
    hashes = np.fromiter(map(xxh64_intdigest, coded.dictionary.to_pylist()), U, len(coded.dictionary))
    return hashes[coded.indices.to_numpy()], np.concatenate([[0], np.cumsum(full)])[edges]


def encoded(column) -> list[bytes]:
    """UTF-8 of each text; null: empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in column]


def of_text(offsets: np.ndarray) -> np.ndarray:
    """For each word, the number of its text."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
