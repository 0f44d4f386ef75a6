"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint of 64 bits is cut into two halves. Of two fingerprints that differ in at most three bits, one half
differs in at most one. Each half is therefore indexed under its 32 variants with one bit wiped out: halves that
differ in at most one bit have a variant in common. An equality shuffle on the variants brings candidates together
and the full distance is checked there. A bucket yields a spanning forest of its links, not all of its pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches
from .components import connected_components
from .textvec import give_back

U = np.uint64
HALF = U(0xFFFFFFFF)
#: Above this many members, a bucket tries the few thousand possible bit changes of each member instead of its pairs.
ENUMERATE_ABOVE = 1 << 16


def fingerprints_of(texts: list[bytes], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """The 64-bit SimHash of each text; zero for texts without words."""
    from xxhash import xxh64_intdigest as digest

    out = np.zeros(len(texts), U)
    values, counts, at = [], [], []

    def flush():
        if not values:
            return
        bits = np.unpackbits(np.array(values, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.cumsum([0, *counts[:-1]])
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        over = (2 * ones > np.array(counts)[:, None]).astype(np.uint8)
        out[at] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
        values.clear(), counts.clear(), at.clear()

    for i, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= shingle:
            values.append(digest(joined, seed))
            counts.append(1)
        else:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            values += [digest(joined[a:b], seed) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist())]
            counts.append(len(words) - shingle + 1)
        at.append(i)
        if len(values) > 100_000:
            flush()
    flush()
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of every document, from its whole text."""

    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints_of(texts).view(np.int64))], names=["doc_id", "fp"])
            give_back()

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _linked(diff: np.ndarray, wiped: U, first: bool, distance: int) -> np.ndarray:
    """Links that this variant answers for: pairs that differ in the wiped bit; equal halves go to variant 0."""
    near = np.bitwise_count(diff) <= distance
    return near if first else near & ((diff & wiped) != 0)


def _forest(fps: np.ndarray, wiped: U, first: bool, free: list[int], distance: int) -> np.ndarray:
    """For each of the sorted distinct members of one bucket, the number of the least member reachable by links."""
    n = len(fps)
    label = np.arange(n)

    def neighbours():
        if n <= ENUMERATE_ABOVE:
            step = max(1, (1 << 22) // n)
            for a in range(0, n, step):
                i, j = np.nonzero(_linked(fps[a : a + step, None] ^ fps[None, :], wiped, first, distance))
                yield i + a, j
        else:
            from itertools import combinations

            for k in range(1, distance + 1):
                for chosen in combinations(free, k):
                    mask = U(sum(1 << b for b in chosen))
                    if first or mask & wiped:
                        j = np.minimum(np.searchsorted(fps, fps ^ mask), n - 1)
                        i = np.flatnonzero(fps[j] == fps ^ mask)
                        yield i, j[i]

    while True:
        before = label.copy()
        for i, j in neighbours():
            np.minimum.at(label, i, label[j])
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            return label


def bucket_links(batches, distance: int):
    """Rows (key, fp) sorted by both -> edges (a, b) of a spanning forest of the links in each bucket."""
    held_k, held_f = np.zeros(0, np.int64), np.zeros(0, U)

    def links(keys, fps):
        starts = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
        lengths = np.diff(np.append(starts, len(keys)))
        two = starts[lengths == 2]
        half, bit = keys[two] >> 37, (keys[two] >> 32) & 31
        wiped = U(1) << (bit + 32 * half).astype(U)
        diff = fps[two] ^ fps[two + 1]
        ok = (np.bitwise_count(diff) <= distance) & ((bit == 0) | ((diff & wiped) != 0))
        out = [(fps[two[ok]], fps[two[ok] + 1])]
        for s, m in zip(starts[lengths > 2].tolist(), lengths[lengths > 2].tolist()):
            half, bit = int(keys[s]) >> 37, (int(keys[s]) >> 32) & 31
            own = fps[s : s + m]
            free = [*range(32 * (1 - half), 32 * (1 - half) + 32), 32 * half + bit]
            label = _forest(own, U(1 << (32 * half + bit)), bit == 0, free, distance)
            moved = np.flatnonzero(label != np.arange(m))
            out.append((own[label[moved]], own[moved]))
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*out))
        return pd.DataFrame({"a": a, "b": b})

    for pdf in batches:
        keys = np.concatenate([held_k, pdf["key"].to_numpy(np.int64)])
        fps = np.concatenate([held_f, pdf["fp"].to_numpy(np.int64).view(U)])
        last = np.searchsorted(keys, keys[-1]) if len(keys) else 0
        held_k, held_f = keys[last:], fps[last:]
        if last:
            yield links(keys[:last], fps[:last])
    if len(held_k):
        yield links(held_k, held_f)


def links(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """`distinct(fp)` -> edges `(a, b)` that connect all fingerprints within `distance` (3 at most) bits of each other."""
    if not 0 <= distance <= 3:
        raise ValueError("two halves answer for distances of 0 to 3 bits")
    wiped = F.expr("CASE WHEN v < 32 THEN fp & 4294967295 ELSE shiftrightunsigned(fp, 32) END & ~shiftleft(1L, v % 32)")
    keyed = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v")).select(
        (F.shiftleft(F.col("v").cast("long"), 32) + wiped).alias("key"), "fp"
    )
    # sorted as unsigned: members of a bucket are searched as unsigned numbers
    keyed = keyed.repartition("key").sortWithinPartitions("key", F.col("fp") < 0, "fp")
    return keyed.mapInPandas(lambda batches: bucket_links(batches, distance), "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs(doc_id, text)`.

    Null and empty texts have fingerprint zero and are linked like any other; repeated rows keep their own row each;
    rows whose doc_id is null take part in links, and component_id is null only where no reachable row has an id.
    Other columns are ignored; an empty table gives an empty result.
    """
    marked = cut(fingerprints(docs))
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    least = cut(least)
    found = cut(connected_components(links(least.select("fp"), distance)))
    named = least.join(found, least["fp"] == found["id"], "left").select(least["fp"], "least", F.coalesce("component", "fp").alias("component"))
    grouped = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(grouped, "component").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
