"""Near-duplicate vectors by Euclidean p-stable hashing.

Vectors are normalised, so that a cosine is a distance. In each of several tables a vector's bucket is given by some
random Gaussian projections, shifted and cut to a width; pairs that share a bucket are checked by their cosine in
double precision. The more vectors there are, the more projections a key takes, so that buckets stay small; the number
of tables follows from the recall. Equal vectors are one member with a count. A pair counts in the first table that brings it together;
buckets yield numbers of links and spanning edges, not pairs. Large buckets are cut into slices that are compared two by
two in different tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import connected_components
from .textvec import BASE, U, mix

COSINE = 0.9
WIDTH = 2.0
#: Enough tables to find a pair at just the threshold with this probability,
RECALL = 0.95
#: and nearer pairs, by how far the threshold's distance from 1 is gone, with these, whatever the number of projections.
NEARER = ((0.8, 0.985), (0.5, 0.9995), (0.2, 1 - 1e-9))
#: So many cosines of a bucket cost about as much as sending a vector to it.
COSINES_A_SEND = 500
MOST_PROJECTIONS = 64
SEED = 42
#: Components and projections are rounded to this fraction for the hashes.
STEPS = 1 << 20
#: A larger bucket is cut into slices of about so many vectors.
SLICE_ROWS = 2048
#: Near pairs that a task holds at once, about.
PAIRS_HELD = 1 << 20
#: So many large buckets may be broadcast (16 bytes each); more are joined.
BROADCAST_ROWS = 100_000


def collision(distance: float, width: float) -> float:
    """Probability that one shifted and cut Gaussian projection agrees for two points at a distance."""
    t = width / distance
    return 1 - math.erfc(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def table_count(projections: int, cosine: float = COSINE, recall: float = RECALL) -> int:
    """Tables that find pairs at the threshold with the recall, and nearer ones with those of NEARER."""

    def tables(c: float, r: float) -> int:
        p = collision(max(1e-9, math.sqrt(2 - 2 * c)), WIDTH) ** projections
        return max(1, math.ceil(math.log1p(-r) / math.log1p(-p))) if p < 1 else 1

    return max(tables(cosine, recall), *(tables(1 - far * (1 - cosine), max(r, recall)) for far, r in NEARER))


def hashing(vectors: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(tables, projections) of least cost for so many vectors, of which all but a few are at right angles."""
    far = collision(math.sqrt(2), WIDTH)
    cost = lambda k: table_count(k, cosine, recall) * (1 + vectors * far**k / COSINES_A_SEND)
    projections = min(range(1, MOST_PROJECTIONS + 1), key=cost)
    return table_count(projections, cosine, recall), projections


def bucket_keys(unit: np.ndarray, tables: int, projections: int) -> np.ndarray:
    """The key of each row's bucket in each table; keys of different tables and dimensions differ.

    Products are of whole numbers below 2**53, so a vector's keys are the same whichever rows stand beside it.
    """
    rng = np.random.default_rng([SEED, unit.shape[1]])
    gauss = np.rint(rng.standard_normal((unit.shape[1], tables * projections)) * STEPS)
    cells = np.floor(((np.rint(unit * STEPS) @ gauss) / STEPS**2 + rng.uniform(0, WIDTH, tables * projections)) / WIDTH)
    cells = cells.astype(np.int64).view(U).reshape(len(unit), tables, projections)
    key = np.broadcast_to(mix(np.arange(tables, dtype=U) + U(unit.shape[1] << 20)), (len(unit), tables))
    for i in range(projections):
        key = mix(key * U(BASE) + cells[:, :, i])
    return key.view(np.int64)


def units(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1; divided by their largest component first, so that no square overflows or vanishes."""
    x = x.astype(np.float64)
    most = np.abs(x).max(axis=1, keepdims=True)
    x = np.ldexp(x, -np.frexp(most)[1]) if len(x) else x  # exact
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keyed(batches, tables: int, projections: int, keys_only: bool):
    for pdf in batches:
        for _, own in pdf.groupby(pdf["embedding"].map(len)):
            keys = bucket_keys(units(np.stack(own["embedding"])), tables, projections)
            if keys_only:
                yield pd.DataFrame({"key": keys.ravel()})
                continue
            data = [np.asarray(v).tobytes() for v in own["embedding"]]
            for t in range(tables):
                yield pd.DataFrame({"key": keys[:, t], "table": t, "id": own["id"].to_numpy(), "n": own["n"].to_numpy(), "vector": data})


def _cell_starts(pdf: pd.DataFrame) -> np.ndarray:
    key, part = pdf["key"].to_numpy(np.int64), pdf["part"].to_numpy(np.int64)
    return np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))


def _near_pairs(unit: np.ndarray, starts: np.ndarray, ends: np.ndarray, cosine: float):
    """Pairs of rows (i < j) of one cell whose cosine reaches the threshold, some at a time."""
    two = starts[ends - starts == 2]
    near = two[np.einsum("ij,ij->i", unit[two], unit[two + 1]) >= cosine]
    held, size = [(near, near + 1)], len(near)
    large = ends - starts > 2
    for s, e in zip(starts[large].tolist(), ends[large].tolist()):
        step = max(1, (1 << 20) // (e - s))
        for a in range(s, e, step):
            i, j = np.nonzero(unit[a : min(a + step, e)] @ unit[s:e].T >= cosine)
            i, j = i + a, j + s
            held.append((i[i < j], j[i < j]))
            size += len(held[-1][0])
            if size > PAIRS_HELD:
                yield tuple(map(np.concatenate, zip(*held)))
                held, size = [], 0
    if size:
        yield tuple(map(np.concatenate, zip(*held)))


def _answered(pdf: pd.DataFrame, dtype: str, cosine: float, tables: int, projections: int):
    """(a, b, links) of whole cells of vectors of one length; pairs that an earlier table brings together are left to it."""
    starts = _cell_starts(pdf)
    unit = units(np.frombuffer(b"".join(pdf["vector"]), dtype).reshape(len(pdf), -1))
    ids, n, table, part, own = (pdf[c].to_numpy(np.int64) for c in ("id", "n", "table", "part", "slice"))
    within = part >> 32 == part & 0xFFFFFFFF
    for i, j in _near_pairs(unit, starts, np.append(starts[1:], len(pdf)), cosine):
        # a cell of two slices answers for the pairs across them
        ours = within[i] | (own[i] != own[j])
        i, j = i[ours], j[ours]
        rows = np.unique(np.concatenate([i, j]))
        keys = bucket_keys(unit[rows], tables, projections)
        x, y = np.searchsorted(rows, i), np.searchsorted(rows, j)
        new = np.zeros(len(i), bool)
        for c in range(0, len(i), 1 << 16):
            s = slice(c, c + (1 << 16))
            new[s] = ~((keys[x[s]] == keys[y[s]]) & (np.arange(tables) < table[i[s], None])).any(axis=1)
        x, y = x[new], y[new]
        ids_, n_ = ids[rows], n[rows]
        links = np.zeros(len(rows), np.int64)
        np.add.at(links, x, n_[y])
        np.add.at(links, y, n_[x])
        label = np.arange(len(rows))
        while (label[x] != label[y]).any():
            low = np.minimum(label[x], label[y])
            np.minimum.at(label, label[x], low)
            np.minimum.at(label, label[y], low)
            while (label[label] != label).any():
                label = label[label]
        some, moved = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(rows)))
        yield pd.DataFrame({
            "a": np.concatenate([ids_[some], ids_[moved]]),
            "b": pd.array(np.concatenate([np.zeros(len(some), np.int64), ids_[label[moved]]]), dtype="Int64").copy(),
            "links": np.concatenate([links[some], np.zeros(len(moved), np.int64)]),
        }).assign(b=lambda d: d["b"].mask(d["links"] > 0))


def _links(batches, dtype: str, cosine: float, tables: int, projections: int):
    """Rows sorted by cell -> (a, b, links): b null: `links` more of a; else an edge between a and b."""

    def closed(pdf):
        starts = _cell_starts(pdf)
        size = np.diff(np.append(starts, len(pdf)))
        pdf = pdf[np.repeat(size > 1, size)]
        for _, own in pdf.groupby(pdf["vector"].map(len)):
            yield from _answered(own, dtype, cosine, tables, projections)

    held = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        last = int(_cell_starts(pdf)[-1])
        held = pdf.iloc[last:]
        if last:
            yield from closed(pdf.iloc[:last])
    if held is not None and len(held):
        yield from closed(held)


def _cells(members: DataFrame, tables: int, projections: int, slice_rows: int) -> DataFrame:
    """(key, part, slice, table, id, n, vector): the members by bucket; a bucket of more than `slice_rows` is cut into
    slices, and each pair of slices is a cell of its own, so that no task holds more than two slices of one bucket."""
    keys = members.select("id", "n", "embedding").mapInPandas(lambda b: _keyed(b, tables, projections, True), "key long")
    large = cut(keys.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > slice_rows))
    keyed = members.select("id", "n", "embedding").mapInPandas(lambda b: _keyed(b, tables, projections, False), "key long, table int, id long, n long, vector binary")
    found = large.count()
    if not found:
        return keyed.withColumns({"part": F.lit(0).cast("long"), "slice": F.lit(0)})
    keyed = keyed.join(F.broadcast(large) if found <= BROADCAST_ROWS else large, "key", "left")
    slices = F.coalesce(F.ceil(F.col("m") / slice_rows), F.lit(1)).cast("int")
    keyed = keyed.withColumn("slice", F.pmod(F.xxhash64("id"), slices).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), slices - 1)))
    part = F.shiftleft(F.least("slice", "other").cast("long"), 32) + F.greatest("slice", "other")
    return keyed.select("key", part.alias("part"), "slice", "table", "id", "n", "vector")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `vectors(vec_id, embedding)`.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, nor do vectors of
    different lengths. Components may be of any finite size. Repeated rows are vectors of their own. A row with a null vec_id is counted as a link of others;
    its own component is the least id reachable, if any. Other columns are ignored; an empty table gives an empty result.
    Which pairs at or above `cosine` are found is up to the hashing: one at just the threshold with probability `recall`, nearer ones with those of
    NEARER, whatever the number of vectors, which only decides how many projections and tables that takes. Tests measure it at the settings for
    800 to 10**8 vectors of 64 components. No pair below `cosine` is linked.
    """
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    dtype, kind = ("<f4", "float") if kind == "float" else ("<f8", "double")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("embedding", F.when(fit, F.col("embedding")))
    members = rows.where("embedding IS NOT NULL").groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    members = cut(members.withColumn("id", F.monotonically_increasing_id()))
    tables, projections = hashing(members.count(), cosine, recall)
    cells = _cells(members, tables, projections, slice_rows).repartition("key", "part").sortWithinPartitions("key", "part", "id")
    found = cut(cells.mapInPandas(lambda b: _links(b, dtype, cosine, tables, projections), "a long, b long, links long"))
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    labels = connected_components(found.where("b IS NOT NULL").select("a", "b"))
    named = members.select("id", "least", "n", "embedding").join(counts, "id", "left").join(labels, "id", "left")
    named = cut(named.select("embedding", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "component").select("embedding", "n_links", "component_id")
    linked = rows.where("embedding IS NOT NULL").join(named, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where("embedding IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
