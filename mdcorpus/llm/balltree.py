"""Ranked lexical search: exact maximum inner products by sparse ball trees.

A document is a sparse vector over the terms that items ask for, in which a term weighs what it adds to a score; an item is the
set of its terms, so that a score is an inner product and every addend a whole number. Documents are put in ball trees of bounded
size, one row of a table each. A ball's centroid and radius bound the score of all in it from above, by Cauchy-Schwarz; bounds are
rounded up by more than the error of the arithmetic. For each item balls are opened from the highest bound down until none
can hold a document as good as those found; leaves are scored exactly in whole numbers.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches
from .exchange import freeze, ramp, thaw
from .textvec import ALNUM, encoded, give_back

#: A term is a run of ASCII letters, digits and characters beyond ASCII; A-Z are lower-cased, all else separates.
FOLD = bytes((b | 0x20 if 0x41 <= b <= 0x5A else b) if ALNUM[b] else 0x20 for b in range(256))
#: Items are asked in blocks of so many bytes of text at most (a longer item is a block of its own), whose terms tasks hold.
ITEM_BYTES = 4 << 20
#: Documents of a tree, and of a leaf.
TREE_DOCS, LEAF_DOCS = 4096, 32
#: Bytes of text that are cut into terms at a time.
PART_BYTES = 1 << 20
#: Bounds are raised by this share, far above the rounding errors of sums of double numbers.
SLACK = 1e-9
#: What tasks find for an item is first reduced in so many groups.
SALTS = 64
BEST = "item int, score long, known boolean, doc_id long"


def parts(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Folded texts in parts of bounded size, with the number of the text that each part is of; no term is cut."""
    owners, held, size = [], [], 0
    for i, text in enumerate(texts):
        text, at = text.translate(FOLD), 0
        while at < len(text):
            to = len(text)
            if to - at > PART_BYTES:
                to = text.rfind(b" ", at, at + PART_BYTES)
                to = to if to > at else text.find(b" ", at + PART_BYTES)
                to = to if to > at else len(text)
            owners.append(i)
            held.append(text[at:to])
            size += to - at
            at = to
            if size >= PART_BYTES:
                yield owners, held
                owners, held, size = [], [], 0
    if held:
        yield owners, held


def terms_of(texts: list[bytes]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(distinct terms, number of each term, its text) of some part of the texts after the other."""
    for owners, held in parts(texts):
        lists = pc.ascii_split_whitespace(pa.array(held, pa.binary()).view(pa.string()))
        words = lists.flatten()
        of = np.repeat(np.array(owners, np.int64), pc.list_value_length(lists).to_numpy())
        full = pc.binary_length(words).to_numpy() > 0
        coded = words.filter(pa.array(full)).cast(pa.binary()).dictionary_encode()
        yield coded.dictionary, coded.indices.to_numpy().astype(np.int64), of[full]


def counts(texts: list[bytes], vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each text with repeats, then for what it has of the vocabulary: text, term, occurrences), by text and term."""
    n, found, v = np.zeros(len(texts), np.int64), [np.zeros(0, np.int64)], len(vocabulary)
    for dictionary, codes, of in terms_of(texts):
        n += np.bincount(of, minlength=len(texts))
        known = pc.fill_null(pc.index_in(dictionary, value_set=vocabulary), -1).to_numpy().astype(np.int64)[codes]
        found.append(of[known >= 0] * v + known[known >= 0])
    key, tf = np.unique(np.concatenate(found), return_counts=True)
    return n, key // max(1, v), key % max(1, v), tf


def counted(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document, whole texts counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, of, term, tf = counts([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()], vocabulary)
            offsets = pa.array(np.searchsorted(of, np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *lists], names=["doc_id", "n", "terms", "tfs"])
            give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def addends(n: np.ndarray, of: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What each term of a document adds to its score, exactly."""
    m = np.array([50 + 50 * x * n_docs // n_terms for x in n.tolist()], np.int64)[of]
    return weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m))


class Tree:
    """Ball tree over documents with sparse vectors.

    Documents are ordered such that node i holds those from first[i] to last[i]; children follow their parent, -1: a leaf. Centroids are kept
    term by term: those of nodes at[edges[t]:edges[t + 1]] have the values `centre` there.
    """

    FIELDS = ("terms", "edges", "at", "centre", "radius", "first", "last", "low", "high", "rows", "cols", "values", "ids", "known")

    def __init__(self, held: list):
        self.__dict__.update(zip(self.FIELDS, held))

    @staticmethod
    def of(of: np.ndarray, term: np.ndarray, values: np.ndarray, ids: np.ndarray, known: np.ndarray, leaf: int = LEAF_DOCS) -> Tree:
        """`of`, `term`, `values`: the vectors' entries by document 0 .. len(ids) - 1, each with one at least."""
        n = len(ids)
        terms, cols = np.unique(term, return_inverse=True)
        rows = np.searchsorted(of, np.arange(n + 1))
        x = values.astype(float)
        square = np.add.reduceat(x * x, rows[:-1]) if n else np.zeros(0)
        order, width = np.arange(n), len(terms)
        nodes, entries = [], []  # [first, last, radius, low, high]; (node, terms, values)
        todo = [(0, n, -1, 0)] if n else []
        while todo:
            a, b, parent, side = todo.pop()
            if parent >= 0:
                nodes[parent][3 + side] = len(nodes)
            own = order[a:b]
            lengths = rows[own + 1] - rows[own]
            inner = ramp(rows[own], lengths)
            col, val, starts = cols[inner], x[inner], np.cumsum(lengths) - lengths
            # any point serves as a centre, so the mean may be rounded; the radius is that of the rounded one
            centre = (np.bincount(col, val, width) / (b - a)).astype(np.float32).astype(float)
            toward = lambda point: np.maximum(square[own] - 2 * np.add.reduceat(val * point[col], starts) + point @ point, 0)
            far = toward(centre)
            error = SLACK * (square[own].max() + centre @ centre)
            here = np.flatnonzero(centre)
            entries.append((len(nodes), here, centre[here]))
            nodes.append([a, b, math.sqrt(far.max() + error) * (1 + SLACK), -1, -1])
            if b - a <= leaf:
                continue
            pole = np.zeros((2, width))
            i = int(far.argmax())
            for k in range(2):
                inside = slice(starts[i], starts[i] + lengths[i])
                pole[k, col[inside]] = val[inside]
                if not k:
                    i = int(toward(pole[0]).argmax())
            lean = toward(pole[0]) - toward(pole[1])
            by = np.argsort(lean, kind="stable")
            cut = int((lean < 0).sum())
            if min(cut, b - a - cut) < (b - a) // 8 or not 0 < cut < b - a:
                cut = (b - a) // 2
            order[a:b] = own[by]
            todo += [(a + cut, b, len(nodes) - 1, 1), (a, a + cut, len(nodes) - 1, 0)]
        lengths = rows[order + 1] - rows[order]
        inner = ramp(rows[order], lengths)
        at = np.repeat([e[0] for e in entries], [len(e[1]) for e in entries]).astype(np.int64)
        term_of = np.concatenate([e[1] for e in entries]) if entries else np.zeros(0, np.int64)
        centre = np.concatenate([e[2] for e in entries]).astype(np.float32) if entries else np.zeros(0, np.float32)
        by = np.argsort(term_of, kind="stable")
        first, last, radius, low, high = (np.array([x[k] for x in nodes], float if k == 2 else np.int64) for k in range(5))
        return Tree([terms, np.searchsorted(term_of[by], np.arange(width + 1)), at[by], centre[by], radius, first, last, low, high, np.concatenate([[0], np.cumsum(lengths)]), cols[inner], values[inner], ids[order], known[order]])

    def packed(self) -> bytes:
        """Signed and fractional arrays as they are, whole ones packed."""
        held = (getattr(self, name) for name in self.FIELDS)
        return freeze(*[x.tobytes() if x.dtype.kind == "f" or name in ("ids", "low", "high") else x for name, x in zip(self.FIELDS, held)])

    @staticmethod
    def unpacked(body: bytes) -> Tree:
        kinds = {"centre": np.float32, "radius": np.float64, "ids": np.int64, "low": np.int64, "high": np.int64, "known": bool}
        return Tree([np.frombuffer(x, kinds[name]) if isinstance(x, bytes) else x.astype(kinds.get(name, np.int64)) for name, x in zip(Tree.FIELDS, thaw(body))])

    def bounds(self, local: np.ndarray) -> np.ndarray:
        """For every node a number that no document in it scores above, for an item of these of the tree's terms."""
        inner = ramp(self.edges[local], self.edges[local + 1] - self.edges[local])
        nodes, n = self.at[inner], len(self.radius)
        near = np.bincount(nodes, self.centre[inner].astype(float), n)
        # a term that no document of the node has is in no inner product there
        return np.floor((near + np.sqrt(np.bincount(nodes, minlength=n)) * self.radius) * (1 + SLACK)) + 1

    def search(self, local: np.ndarray, found: Found) -> int:
        """Put the best documents for an item of these of the tree's terms into `found`; returns how many leaves were scored."""
        bound, scored = self.bounds(local).tolist(), 0
        asked = np.zeros(len(self.terms), bool)
        asked[local] = True
        heap = [(-bound[0], 0)] if bound else []
        while heap and -heap[0][0] >= found.least:
            _, i = heapq.heappop(heap)
            if self.low[i] >= 0:
                for child in (int(self.low[i]), int(self.high[i])):
                    if bound[child] >= found.least:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            scored += 1
            a, b = int(self.first[i]), int(self.last[i])
            inside = slice(int(self.rows[a]), int(self.rows[b]))
            scores = np.add.reduceat(np.where(asked[self.cols[inside]], self.values[inside], 0), self.rows[a:b] - self.rows[a])
            found.add(scores, self.ids[a:b], self.known[a:b])
        return scored


class Found:
    """The `most` best documents of an item so far: highest scores above 0, then least ids, null ids last."""

    def __init__(self, most: int):
        self.most, self.least = most, 1
        self.scores, self.ids, self.known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        good = scores >= self.least
        if not good.any():
            return
        s, i, k = (np.concatenate(x) for x in ((self.scores, scores[good]), (self.ids, ids[good]), (self.known, known[good])))
        best = np.lexsort((i, ~k, -s))[: self.most]
        self.scores, self.ids, self.known = s[best], i[best], k[best]
        if len(best) == self.most:
            self.least = int(self.scores[-1])


def forest(table: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int, tree_docs: int = TREE_DOCS, leaf: int = LEAF_DOCS) -> DataFrame:
    """`counted` documents as trees of at most `tree_docs` of them, one row each. Those that score above 0 for no item are in none."""

    def made(batches: list[pa.RecordBatch]) -> bytes:
        t = pa.Table.from_batches(batches)
        lengths = pc.list_value_length(t.column("terms")).to_numpy().astype(np.int64)
        of, n = np.repeat(np.arange(len(t)), lengths), t.column("n").to_numpy()
        term, tf = (pc.list_flatten(t.column(c)).to_numpy().astype(np.int64) for c in ("terms", "tfs"))
        values = addends(n, of, term, tf, weights, n_docs, n_terms)
        of, term, values = of[values > 0], term[values > 0], values[values > 0]
        full, of = np.unique(of, return_inverse=True)
        ids, known = pc.fill_null(t.column("doc_id"), 0).to_numpy()[full], pc.is_valid(t.column("doc_id")).to_numpy()[full]
        return Tree.of(of, term, values, ids, known, leaf).packed()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, have = [], 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([have]), pa.array([made(held)], pa.binary())], names=["docs", "tree"])
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, tree_docs - have)
                held.append(part)
                have, at = have + part.num_rows, at + part.num_rows
                if have == tree_docs:
                    yield row()
                    held, have = [], 0
                    give_back()
        if have:
            yield row()

    return table.mapInArrow(run, "docs long, tree binary")


def best_of(trees: DataFrame, asked: list[np.ndarray], vocabulary: int, k: int) -> DataFrame:
    """(item, score, known, doc_id): the k best documents of each item, numbered as in `asked`, in each task's trees."""
    held = trees.sparkSession.sparkContext.broadcast(asked)  # numbers of the terms of one block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Found(k) for _ in held.value]
        sizes = np.array([len(a) for a in held.value])
        flat, starts = np.concatenate([*held.value, np.zeros(0, np.int64)]), np.cumsum(sizes) - sizes
        place = np.full(vocabulary, -1)
        for batch in batches:
            for body in batch.column("tree"):
                tree = Tree.unpacked(body.as_py())
                if not len(tree.radius):
                    continue
                place[tree.terms] = np.arange(len(tree.terms))
                # the root's bound rules out most items' visit to a tree at once
                root = np.zeros(vocabulary)
                top = tree.at == 0
                root[tree.terms[np.repeat(np.arange(len(tree.terms)), np.diff(tree.edges))[top]]] = tree.centre[top]
                near = np.add.reduceat(root[flat], starts)
                shared = np.add.reduceat((place[flat] >= 0).astype(np.int64), starts)
                bound = np.floor((near + np.sqrt(shared) * tree.radius[0]) * (1 + SLACK)) + 1
                for i in np.flatnonzero((shared > 0) & (bound >= [f.least for f in found])).tolist():
                    local = place[held.value[i]]
                    tree.search(local[local >= 0], found[i])
                place[tree.terms] = -1
            give_back()
        for i, f in enumerate(found):
            if len(f.ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f.ids), i), pa.int32()), pa.array(f.scores), pa.array(f.known), pa.array(f.ids)], names=["item", "score", "known", "doc_id"])

    return trees.mapInArrow(run, BEST)


def item_blocks(items: DataFrame, most: int = ITEM_BYTES) -> Iterator[list[tuple]]:
    """(item_id, text) of the items that have a text, in blocks of at most `most` bytes of text; those of one id stay together."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    size, n = F.sum(F.octet_length("text")), 1
    place = lambda: F.pmod(F.xxhash64("item_id"), F.lit(n))
    while n < 1 << 20 and rows.groupBy(place().alias("b")).agg(size.alias("size"), F.min("item_id").alias("a"), F.max("item_id").alias("z"), F.count_if(F.col("item_id").isNull()).alias("u")).where((F.col("size") > most) & ((F.col("a") < F.col("z")) | (F.col("u") > 0) & F.col("a").isNotNull())).limit(1).count():
        n *= 2
    for b in range(n):
        if block := [tuple(r) for r in rows.where(place() == b).collect()]:  # `most` bytes
            yield block


def asked_by(block: list[tuple]) -> tuple[list, list[np.ndarray], pa.Array]:
    """(ids, the distinct terms of each, by number, the vocabulary); texts of one id count together."""
    ids = list(dict.fromkeys(i for i, _ in block))
    place = {i: k for k, i in enumerate(ids)}
    pairs = {(place[block[o][0]], t) for dictionary, codes, of in terms_of(encoded(text for _, text in block)) for o, t in set(zip(of.tolist(), (dictionary[c].as_py() for c in codes.tolist())))}
    vocabulary = sorted({t for _, t in pairs})
    number = {t: v for v, t in enumerate(vocabulary)}
    asked = [[] for _ in ids]
    for i, t in pairs:
        asked[i].append(number[t])
    full = [i for i, a in enumerate(asked) if a]
    return [ids[i] for i in full], [np.array(sorted(asked[i]), np.int64) for i in full], pa.array(vocabulary, pa.binary())


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, item_bytes: int = ITEM_BYTES, tree_docs: int = TREE_DOCS, leaf: int = LEAF_DOCS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best of all rows of `docs(doc_id, text)` for each id of `items(item_id, text)`.

    Only scores above 0 count; equal ones go by ascending doc_id, null ids last. Null and empty texts have no terms, so they are never found
    and don't count as documents. Repeated rows, and rows of equal or null ids, are documents each. Texts of one item_id, null
    included, are one item. Very long texts are counted whole, in parts. Other columns are ignored; empty tables, and items without
    terms, give no rows. Documents are read once for each block of items (`item_bytes`).
    """
    spark = docs.sparkSession
    small_batches(spark)
    out, scratch = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long"), Scratch(spark, "balltree")
    for b, block in enumerate(item_blocks(items, item_bytes)):
        ids, asked, vocabulary = asked_by(block)
        if not ids:
            continue
        table = scratch.save(counted(docs, vocabulary), f"counted-{b}")
        n_docs, n_terms = table.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.zeros(len(vocabulary), np.int64)
        for term, df in table.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():  # a row for each of the items' terms
            weights[term] = weight(df, n_docs)
        trees = scratch.save(forest(table.where(F.size("terms") > 0), weights, n_docs, n_terms, tree_docs, leaf), f"trees-{b}")
        scratch.drop(f"counted-{b}")
        best = best_of(trees, asked, len(vocabulary), k)
        order = [F.col("score").desc(), F.col("known").desc(), "doc_id"]
        place = lambda *key: F.row_number().over(Window.partitionBy(*key).orderBy(*order))
        few = best.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS))).withColumn("rank", place("item", "salt")).where(F.col("rank") <= k)
        few = few.drop("salt").withColumn("rank", place("item")).where(F.col("rank") <= k)
        named = spark.createDataFrame(list(enumerate(ids)), "item int, item_id long")
        out = out.union(few.join(F.broadcast(named), "item").select("item_id", "rank", F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), "score"))
    return out
