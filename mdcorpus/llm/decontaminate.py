"""Benchmark decontamination: a BM25 index of test items, queried with every passage of every document.

An item's weights are divided by their sum, so a score says which share of the item a passage holds, and one threshold
serves all items. Items are indexed in shards of bounded size; a few shards are broadcast at a time and the documents pass them once.
In a task, block-max WAND runs over a batch of passages in step: each passage has a cursor for each of its terms on the term's
list of blocks of items; cursors are kept in the order of their blocks, the terms' maxima say at which cursor the threshold can
first be reached, the cursors before it skip to its block, and if the maxima of that block reach the threshold, its items are
scored in full. So every item above the threshold is returned. A retrieved item counts as leaked if the words around the passage
also hold enough of the word n-grams of its question and of its answer.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches
from .exchange import ramp
from .textvec import ALNUM, BASE, U, blocks, give_back, hash_words, mix

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.5
NGRAM = 5
#: A passage is two half passages; an item part of up to HALF words lies in one passage wherever it starts.
HALF = 64
BLOCK = 8
SHARD_BYTES, SHARDS_HELD = 4 << 20, 4
#: Texts searched together, in bytes.
BATCH = 1 << 19
#: Sums in another order may differ by so much.
SLACK = 1e-9


#: What separates words beyond ASCII, and characters that are words by themselves.
BETWEEN = regex.compile(r"[^\x00-\x7F\p{L}\p{N}\p{M}]+")
ALONE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")


def lowered(texts) -> list[bytes]:
    """Lower-cased UTF-8 in which only letters, digits and marks lie beyond ASCII, and ideographs stand apart; null: empty."""
    out = []
    for t in texts:
        t = t.lower() if isinstance(t, str) else ""
        if not t.isascii():
            t = ALONE.sub(r" \g<0> ", BETWEEN.sub(" ", t))
        out.append(t.encode("utf-8", "surrogatepass"))
    return out


def question_and_answer(words: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
    """The last sentence is the answer; of a single sentence, the last quarter of its words."""
    head = re.match(r"(?s)(.*[.!?])\s+\S", text.rstrip())
    n = len(hash_words(lowered([head[1]]), ALNUM)[0]) if head else 0
    if not 0 < n < len(words):
        n = len(words) - max(1, len(words) // 4) if len(words) > 1 else 0
    return words[:n], words[n:]


def ngrams(words: np.ndarray, n: int = NGRAM) -> np.ndarray:
    """Distinct hashes of the runs of n words (of all words, if fewer)."""
    n = min(n, len(words))
    if not n:
        return np.zeros(0, U)
    out = np.zeros(len(words) - n + 1, U)
    for i in range(n):
        out = mix(out * U(BASE) + words[i : i + len(out)])
    return np.unique(out)


def overlap(part: np.ndarray, words: np.ndarray) -> float:
    """Share of the part's n-grams that are among the words' (1 for an empty part)."""
    grams = ngrams(part)
    return float(np.isin(grams, ngrams(words, min(NGRAM, max(1, len(part))))).mean()) if len(grams) else 1.0


class Index:
    """Postings of one shard: for each term the item parts that hold it, their shares, and the maxima of blocks of parts."""

    def __init__(self, postings: pd.DataFrame, texts: pd.DataFrame):
        names = ["item_id", "text_id", "part"]
        part = postings.groupby(names, sort=True).ngroup().to_numpy()
        self.items = postings[names].drop_duplicates().sort_values(names)["item_id"].to_numpy()
        term, weight = postings["term"].to_numpy(np.int64).view(U), postings["weight"].to_numpy(np.float64)
        weight = weight / np.bincount(part, weight, len(self.items))[part]
        self.terms, inverse = np.unique(term, return_inverse=True)
        order = np.lexsort((part, inverse))
        inverse, self.part, self.share = inverse[order], part[order], weight[order]
        # an entry is a term's postings in one block: entries by term and block, their maxima and first postings
        self.n_blocks = (len(self.items) + BLOCK - 1) // BLOCK
        code = inverse * (self.n_blocks + 1) + self.part // BLOCK
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        self.entry, self.posting = code[starts], np.append(starts, len(code))
        self.block, self.most = self.part[starts] // BLOCK, np.maximum.reduceat(self.share, starts) if len(starts) else np.zeros(0)
        self.first = np.searchsorted(inverse[starts], np.arange(len(self.terms) + 1))
        self.bound = np.maximum.reduceat(self.most, self.first[:-1]) if len(starts) else np.zeros(0)
        self.texts: dict[int, list] = {}
        for item, text in texts[["item_id", "text"]].itertuples(index=False, name=None):
            words = hash_words(lowered([text]), ALNUM)[0]
            self.texts.setdefault(item, []).append((len(words), *question_and_answer(words, text)))

    def term_numbers(self, words: np.ndarray) -> np.ndarray:
        """The number of each word's term, or -1."""
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        return np.where(self.terms[at] == words, at, -1)

    def candidates(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, block) pairs whose block maxima reach the threshold, by WAND over lists of blocks.

        passage, term: the distinct terms of each passage, by passage.
        """
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        reach = np.bincount(passage, self.bound[term])[passage] >= THRESHOLD - SLACK
        passage, term = passage[reach], term[reach]
        at = self.first[term]
        while len(passage):
            block = self.block[at]
            order = np.argsort(passage * (self.n_blocks + 1) + block, kind="stable")
            passage, term, at, block = passage[order], term[order], at[order], block[order]
            new = np.concatenate([[True], passage[1:] != passage[:-1]])
            starts, own = np.flatnonzero(new), np.cumsum(new) - 1
            # the pivot: the first cursor at which the terms' bounds reach the threshold
            sums = np.cumsum(self.bound[term])
            pivot = np.searchsorted(sums, np.where(starts > 0, sums[starts - 1], 0.0) + THRESHOLD - SLACK)
            alive = pivot < np.append(starts[1:], len(passage))
            target = np.where(alive, block[np.minimum(pivot, len(block) - 1)], -1)
            # all cursors before the pivot are at its block: look at the block's maxima, and go on behind it
            here = np.flatnonzero((alive & (block[starts] == target))[own] & (block == target[own]))
            most = np.bincount(own[here], self.most[at[here]], len(starts))
            reach = np.flatnonzero(most >= THRESHOLD - SLACK)
            found.append((passage[starts[reach]], target[reach]))
            at[here] += 1
            # others skip to the pivot's block
            behind = np.flatnonzero(block < target[own])
            at[behind] = np.searchsorted(self.entry, term[behind] * (self.n_blocks + 1) + target[own[behind]])
            left = np.flatnonzero(alive[own] & (at < self.first[term + 1]))
            passage, term, at = passage[left], term[left], at[left]
        return tuple(map(np.concatenate, zip(*found)))

    def retrieve(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item part, score) of every part whose share held by a passage's distinct terms reaches the threshold."""
        which, block = self.candidates(passage, term)
        lo, hi = np.searchsorted(passage, which), np.searchsorted(passage, which, side="right")
        pair = np.repeat(np.arange(len(which)), hi - lo)
        code = term[ramp(lo, hi - lo)] * (self.n_blocks + 1) + block[pair]
        at = np.minimum(np.searchsorted(self.entry, code), len(self.entry) - 1)
        hit = self.entry[at] == code
        at, pair = at[hit], pair[hit]
        size = self.posting[at + 1] - self.posting[at]
        posting, pair = ramp(self.posting[at], size), np.repeat(pair, size)
        place, slot = np.unique(pair * len(self.items) + self.part[posting], return_inverse=True)
        score = np.bincount(slot, self.share[posting], len(place))
        found = np.flatnonzero(score >= THRESHOLD - SLACK)
        return which[place[found] // len(self.items)], place[found] % len(self.items), score[found]

    def leaks(self, doc_ids: list, texts: list[bytes]) -> list[tuple]:
        """(doc_id, item_id, first word of the passage, score, question overlap, answer overlap) of each leak."""
        rows = []
        for a, b in blocks(texts, BATCH) if len(self.terms) else ():
            words, offsets = hash_words(texts[a:b], ALNUM)
            term = self.term_numbers(words)
            halves = (np.diff(offsets) + HALF - 1) // HALF + 1  # and an empty one behind each document
            first_half = np.concatenate([[0], np.cumsum(halves)])
            doc = np.repeat(np.arange(b - a), np.diff(offsets))
            half = first_half[doc] + (np.arange(len(words)) - offsets[doc]) // HALF
            hit = np.flatnonzero(term >= 0)
            half, term = half[hit], term[hit]
            # passage i: halves i and i + 1; the half before a document's first is the empty one of the document before
            inner = half > first_half[doc[hit]]
            code = np.unique(np.concatenate([half, half[inner] - 1]) * len(self.terms) + np.concatenate([term, term[inner]]))
            found: dict[tuple, set] = {}
            for h, part, score in zip(*(x.tolist() for x in self.retrieve(code // len(self.terms), code % len(self.terms)))):
                d = int(np.searchsorted(first_half, h, side="right")) - 1
                found.setdefault((d, self.items[part]), set()).add((-score, (h - int(first_half[d])) * HALF))
            for (d, item), places in sorted(found.items()):
                for score, at, (size, question, answer) in ((*p, t) for p in sorted(places) for t in self.texts[item]):
                    own = words[offsets[d] + max(0, at - size) : min(offsets[d] + at + 2 * HALF + size, offsets[d + 1])]
                    q, r = overlap(question, own), overlap(answer, own)
                    if q >= OVERLAP and r >= OVERLAP:
                        rows.append((doc_ids[a + d], int(item), at, -score, q, r))
                        break
        return rows


def _terms(batches):
    """Items -> their texts' parts' terms: (item_id, text_id, part, term, tf, words in the part)."""
    for pdf in batches:
        rows = []
        for item, text_id, text in zip(pdf["item_id"], pdf["text_id"], pdf["text"]):
            words = hash_words(lowered([text]), ALNUM)[0]
            n = max(1, -(-len(words) // HALF))
            for p, own in enumerate(np.array_split(words, n)):
                terms, tf = np.unique(own, return_counts=True)
                rows += [(item, text_id, p, t, int(k), len(own)) for t, k in zip(terms.view(np.int64).tolist(), tf.tolist())]
        yield pd.DataFrame(rows, columns=["item_id", "text_id", "part", "term", "tf", "n"])


def _index(texts: pd.DataFrame, postings: pd.DataFrame) -> pd.DataFrame:
    """One shard's index, in parts that a row can hold."""
    rows = pickle.dumps(Index(postings, texts.sort_values(["item_id", "text"])))
    parts = [rows[i : i + PART_BYTES] for i in range(0, len(rows), PART_BYTES)]
    return pd.DataFrame({"shard": int(texts["shard"].iloc[0]) if len(texts) else -1, "part": range(len(parts)), "body": parts})


PART_BYTES = 16 << 20
TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]


def indexes_of(benchmark: DataFrame, shard_bytes: int = SHARD_BYTES):
    """The broadcast indexes of all items of `benchmark(item_id, text)`, SHARDS_HELD shards at a time, and whether there are more than these.

    Of several broadcasts one is held at a time: what is asked of it is to be written before the next is taken.
    """
    spark, scratch = benchmark.sparkSession, Scratch(benchmark.sparkSession, "decontamination")
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").dropDuplicates()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    items = items.withColumns({"text_id": F.xxhash64("text"), "shard": F.pmod(F.xxhash64("item_id"), F.lit(shards)).cast("int")})
    terms = items.select("item_id", "text_id", "text").mapInPandas(_terms, "item_id long, text_id long, part int, term long, tf int, n int")
    terms = scratch.save(terms.groupBy("item_id", "text_id", "part", "term").agg(F.sum("tf").alias("tf"), F.sum("n").alias("n")), "terms")
    all_parts = terms.groupBy("item_id", "text_id", "part").agg(F.max("n").alias("n")).agg(F.count("*").alias("parts"), F.avg("n").alias("mean")).first()
    if not all_parts["parts"]:
        return
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(all_parts["parts"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.lit(K1) * (1 - B + B * F.col("n") / F.lit(all_parts["mean"] or 1.0))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    postings = terms.join(df, "term").select("item_id", "text_id", "part", "term", weight.alias("weight"), F.pmod(F.xxhash64("item_id"), F.lit(shards)).cast("int").alias("shard"))
    indexes = items.groupBy("shard").cogroup(postings.groupBy("shard")).applyInPandas(lambda t, p: _index(t, p), "shard int, part int, body binary")
    indexes = scratch.save(indexes, "indexes")
    for first in range(0, shards, SHARDS_HELD):
        bodies: dict[int, list] = {}
        for r in indexes.where(F.col("shard").between(first, first + SHARDS_HELD - 1)).orderBy("shard", "part").collect():  # SHARDS_HELD shards of bounded text
            bodies.setdefault(r["shard"], []).append(bytes(r["body"]))
        held = spark.sparkContext.broadcast([pickle.loads(b"".join(b)) for b in bodies.values()])
        yield held, shards > SHARDS_HELD
        if shards > SHARDS_HELD:
            held.unpersist()
    scratch.drop("terms", "indexes")


def leak_free(docs: DataFrame, benchmark: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows of `docs` that leak no test item, with all their columns, whatever their ids; see `leaks`."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "leak-free")
    for i, (held, several) in enumerate(indexes_of(benchmark, shard_bytes)):

        def run(batches, held=held):
            for batch in batches:
                texts = lowered(batch.column("text").to_pylist())
                bad = {r[0] for index in held.value for r in index.leaks(list(range(len(texts))), texts)}
                yield batch.filter(pa.array([i not in bad for i in range(len(texts))], pa.bool_()))
                give_back()

        docs = docs.mapInArrow(run, docs.schema)
        if several:
            docs = scratch.save(docs, str(i))
            scratch.drop(str(i - 1))
    return docs


def leaks(docs: DataFrame, benchmark: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for each document and test item that it leaks: (doc_id, item_id, passage, score, question, answer).

    `docs(doc_id, text)` are queried whole, however long, `benchmark(item_id, text)` is indexed whole; documents are read once for each
    SHARDS_HELD shards of items. Words are runs of letters, digits and marks, lower-cased, so that quotes and dashes of any kind
    separate them; an ideograph or kana is a word. Question and answer are looked for in every passage retrieved and as many words on
    both sides as the item has. `passage` is the first word of the passage of the highest score where both are, of equal ones the first. Null and
    empty texts, and test items without words or with a null id, take part in nothing; repeated rows give rows of their own; an
    item id that is repeated counts once for each document, and each of its texts is searched for on its own; other columns are
    ignored. Without items or documents the result is empty.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, item_id long, passage int, score double, question double, answer double"
    names = [c.split()[0] for c in schema.split(", ")]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out, scratch = docs.sparkSession.createDataFrame([], schema), Scratch(docs.sparkSession, "leaks")
    for i, (held, several) in enumerate(indexes_of(benchmark, shard_bytes)):

        def run(batches, held=held):
            for batch in batches:
                ids, texts = batch.column("doc_id").to_pylist(), lowered(batch.column("text").to_pylist())
                rows = [r for index in held.value for r in index.leaks(ids, texts)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(TYPES), TYPES)], names=names)

        found = docs.mapInArrow(run, schema)
        out = out.union(scratch.save(found, str(i)) if several else found)
    return out
