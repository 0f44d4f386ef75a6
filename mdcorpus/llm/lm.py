"""Language-model scoring by deleted interpolation of bigram, unigram and uniform estimates.

Every chunk of documents sends its distinct words, then its distinct bigrams, with their counts in training documents to the
buckets that own them and gets the corpus counts back; words and pairs of words are told apart exactly. A bigram with a word
that no other chunk has is counted where it is. Mixture weights depend on how often the context was
seen; they are learned by expectation-maximisation on the tokens of a tenth of the documents, whose counts are taken away
from those of the corpus for that; the estimates that are mixed in the end are of all training documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_mod, release
from .exchange import CHUNK_BYTES, MESSAGE, answered, by_chunk, bytes_of, dealt, dealt_words, freeze, messages, numbered_words, received, rejoined, save, sizes, slices, words_of
from .textvec import BASE, U, mix

#: Of the documents by crc32 of their ids modulo PARTS: HELD_OUT is never learned from, TUNING serves to learn the weights.
PARTS, HELD_OUT, TUNING = 10, 0, 5
#: Contexts are told apart by the power of two of their count.
CONTEXTS = 40
#: For the weights, tokens whose estimates agree to a quarter of a power of two are taken together, with their mean estimates.
STEPS, LEVELS = 4, 161
EM_STEPS = 60
FLOOR = 1e-6
#: The name of what stands before a document; words' names are larger.
START = 0


def _begin(number: int, rows: pa.Table, buckets: int) -> list[tuple]:
    """The chunk's tokens; its distinct words, and the end of a text (the word of no bytes), with their counts."""
    words, inner, offsets = numbered_words(pc.ascii_lower(rows.column("text")))
    words = pa.concat_arrays([words, pa.array([b""], pa.binary())])
    n = np.diff(offsets) + 1
    offsets = np.concatenate([[0], np.cumsum(n)])
    token = np.full(int(offsets[-1]), len(words) - 1)
    inside = np.ones(len(token), bool)
    inside[offsets[1:] - 1] = False
    token[inside] = inner
    order, edges = dealt_words(words, buckets)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    token, words = place[token], words.take(pa.array(order))
    ids, part = rows.column("doc_id"), rows.column("part").to_numpy()
    count, tuning = (np.bincount(token, np.repeat(own, n), len(words)).astype(np.int64) for own in (part != HELD_OUT, part == TUNING))
    state = freeze(token, offsets, ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(), part)
    asks = [("ask", 0, number, b, s.stop - s.start, freeze(*bytes_of(words[s.start : s.stop]), count[s], tuning[s])) for b, s in slices(edges)]
    return [("state", 0, number, -1, 0, state), *asks]


def _totals(which: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    return [np.bincount(which, c).astype(np.int64) for c in counts]


def _answer_words(bucket: int, asked: list, buckets: int) -> list[tuple]:
    """The name and counts of each word, and whether no other chunk has it; and how many tokens, tuning tokens and distinct words of training documents there are."""
    coded = pa.concat_arrays([words_of(*parts[:2]) for *_, parts in asked]).dictionary_encode()
    own = coded.indices.to_numpy().astype(np.int64)
    count, tuning = _totals(own, *(np.concatenate([parts[k] for *_, parts in asked]) for k in (2, 3)))
    edges = np.cumsum([0] + [n for _, _, n, _ in asked])
    alone = np.bincount(own) == 1
    told = own * buckets + bucket + START + 1, count[own], tuning[own], alone[own]
    rows = [("answer", 0, c, bucket, n, freeze(*(x[s:e] for x in told))) for (c, _, n, _), s, e in zip(asked, edges[:-1], edges[1:])]
    return rows + [("stats", i, -1, bucket, int(x), None) for i, x in enumerate((count.sum(), tuning.sum(), (count > 0).sum()))]


class Chunk:
    """The tokens of one chunk's documents and their distinct bigrams."""

    def __init__(self, table: pa.Table):
        ((_, _, _, (self.token, self.offsets, self.ids, self.known, self.part)),) = received(table, "state")
        self.name, self.count, self.tuning, alone = (np.concatenate(x) for x in zip(*(parts for *_, parts in received(table, "answer", 0))))
        n = len(self.name)
        context = np.concatenate([[n], self.token[:-1]])[: len(self.token)]
        context[self.offsets[:-1]] = n
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.offsets))
        code, self.bigram = np.unique(context * (n + 1) + self.token, return_inverse=True)
        self.context, self.last = np.divmod(code, n + 1)
        #: the counts of bigrams with a word that no other chunk has, or no training document, are known here
        settled = np.append((alone > 0) | (self.count == 0), False)
        self.asks = np.flatnonzero(~settled[self.context] & ~settled[self.last])
        self.name = np.append(self.name, START)

    def local(self) -> tuple[np.ndarray, np.ndarray]:
        """How often each bigram is in the chunk's training and tuning documents."""
        part = self.part[self.doc]
        return tuple(np.bincount(self.bigram, own, len(self.last)).astype(np.int64) for own in (part != HELD_OUT, part == TUNING))

    def deal(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        x, y = self.name[self.context[self.asks]].astype(U), self.name[self.last[self.asks]].astype(U)
        return dealt((mix(mix(x) + y * U(BASE)) % U(buckets)).astype(np.int64), buckets)

    def ask(self, number: int, buckets: int) -> pa.Table:
        order, edges = self.deal(buckets)
        asks = self.asks[order]
        x, y, (count, tuning) = self.name[self.context[asks]], self.name[self.last[asks]], (c[asks] for c in self.local())
        return messages([("ask", 1, number, b, s.stop - s.start, freeze(x[s], y[s], count[s], tuning[s])) for b, s in slices(edges)])

    def counts(self, table: pa.Table, buckets: int, starts: tuple[int, int]):
        """Corpus counts, in all training and in tuning documents, of each bigram's last word, of the bigram and of its context."""
        told = [parts for *_, parts in received(table, "answer", 1)]
        out = []
        for k, (local, own) in enumerate(zip(self.local(), (self.count, self.tuning))):
            got = np.concatenate([parts[k] for parts in told]) if told else np.zeros(0, np.int64)
            if len(got) != len(self.asks):
                raise RuntimeError("a chunk's answers don't fit its keys")
            local[self.asks[self.deal(buckets)[0]]] = got
            out.append((own[self.last], local, np.append(own, starts[k])[self.context]))
        return out


def _answer_bigrams(bucket: int, asked: list) -> list[tuple]:
    x, y, count, tuning = (np.concatenate(v) for v in zip(*(parts for *_, parts in asked)))
    order = np.lexsort((y, x))
    which = np.empty(len(x), np.int64)
    which[order] = np.cumsum(np.concatenate([[True], (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)])) - 1
    count, tuning = (t[which] for t in _totals(which, count, tuning))
    edges = np.cumsum([0] + [n for _, _, n, _ in asked])
    return [("answer", 1, c, bucket, n, freeze(count[s:e], tuning[s:e])) for (c, _, n, _), s, e in zip(asked, edges[:-1], edges[1:])]


def context_bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(count.astype(float))[1], CONTEXTS - 1)


def estimates(one, two, context, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood estimates of bigrams and unigrams; 0 where the context, or anything, was not seen."""
    return two / np.maximum(context, 1), one / max(n, 1)


def _level(f: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(f > 0, np.clip(np.floor(-np.log2(f) * STEPS), 0, LEVELS - 2), LEVELS - 1).astype(np.int64)


CELLS = "cell long, tokens double, f2 double, f1 double"


def _cells(table: pa.Table, buckets: int, n: int, starts: tuple[int, int]) -> pa.Table:
    """The chunk's tuning tokens by context and level of their estimates without tuning documents: their number and sums of estimates."""
    c = Chunk(table)
    times = c.local()[1].astype(float)
    whole, tuning = c.counts(table, buckets, starts)
    one, two, context = (w - t for w, t in zip(whole, tuning))
    f2, f1 = estimates(one, two, context, n)
    cell, which = np.unique((context_bucket(context) * LEVELS + _level(f2)) * LEVELS + _level(f1), return_inverse=True)
    sums = [np.bincount(which, times * f, len(cell)) for f in (np.ones(len(f2)), f2, f1)]
    some = sums[0] > 0
    return pa.table({"cell": cell[some], "tokens": sums[0][some], "f2": sums[1][some], "f1": sums[2][some]})


def learn_weights(bucket: np.ndarray, tokens: np.ndarray, f2: np.ndarray, f1: np.ndarray, v: int) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each context bucket, by expectation-maximisation; of all where a bucket has no token."""
    f = np.column_stack([f2, f1, np.full(len(bucket), 1.0 / (v + 1))])

    def em(rows) -> np.ndarray:
        w = np.full(3, 1 / 3)
        for _ in range(EM_STEPS if tokens[rows].sum() else 0):
            share = f[rows] * w
            share *= (tokens[rows] / share.sum(axis=1))[:, None]
            w = np.maximum(share.sum(axis=0) / share.sum(), FLOOR)
            w /= w.sum()
        return w

    overall = em(np.ones(len(bucket), bool))
    return np.array([em(bucket == b) if tokens[bucket == b].sum() else overall for b in range(CONTEXTS)])


def _score(table: pa.Table, buckets: int, weights: np.ndarray, n: int, v: int, starts: tuple[int, int]) -> pa.Table:
    c = Chunk(table)
    (one, two, context), _ = c.counts(table, buckets, starts)
    f2, f1 = estimates(one, two, context, n)
    w = weights[context_bucket(context)]
    p = w[:, 0] * f2 + w[:, 1] * f1 + w[:, 2] / (v + 1)
    per = lambda x: np.bincount(c.doc, x[c.bigram], len(c.ids))
    base = np.log10((one + 0.1) / (n + 0.1 * (v + 1)))
    ids = pa.array(c.ids, pa.int64(), mask=c.known == 0)
    return pa.table({"doc_id": ids, "n_tokens": np.diff(c.offsets), "n_known": per(one > 0).astype(np.int64), "base_score": per(base), "score": per(np.log10(p))})


def lm_scores(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of `docs(doc_id, text)`.

    Documents whose crc32(doc_id) mod 10 is not 0 are learned from. Null and empty texts are a single end token; rows
    with null or repeated ids are rows of their own (a null id is hashed as empty text); words may be of any length; other
    columns are ignored; an empty table gives an empty result. With no training documents every token gets the uniform
    share of an equal mixture. A task holds a chunk of about `chunk_bytes` of text, or one longer text.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", crc_mod("doc_id", PARTS).cast("int").alias("part"))
    starts = docs.agg(F.count_if(F.col("part") != HELD_OUT), F.count_if(F.col("part") == TUNING)).first()
    starts = int(starts[0]), int(starts[1])
    buckets = sizes(docs)
    words = save(scratch, by_chunk(docs, lambda number, rows: _begin(number, rows, buckets), chunk_bytes), "words")
    told = save(scratch, answered(words, lambda b, asked: _answer_words(b, asked, buckets)), "answers0")
    scratch.drop("words/role=ask")
    release(docs.sparkSession)
    stats = {r["level"]: r["n"] for r in told.where("role = 'stats'").groupBy("level").agg(F.sum("n").alias("n")).collect()}
    n, tuning, v = (int(stats.get(i, 0)) for i in range(3))
    told = told.where("role = 'answer'")
    asked = rejoined([words, told], lambda number, table: Chunk(table).ask(number, buckets), MESSAGE)
    more = save(scratch, answered(asked, lambda b, got: _answer_bigrams(b, got), level=1), "answers1")
    release(docs.sparkSession)
    tables = [words, told, more]
    cells = rejoined(tables, lambda number, table: _cells(table, buckets, n - tuning, starts), CELLS)
    cells = cells.groupBy("cell").agg(*[F.sum(x).alias(x) for x in ("tokens", "f2", "f1")]).toPandas().sort_values("cell")  # CONTEXTS * LEVELS**2 rows at most
    release(docs.sparkSession)
    cells = cells.astype({"cell": "int64"})
    weights = learn_weights((cells["cell"] // LEVELS**2).to_numpy(), *(x.to_numpy(float) for x in (cells["tokens"], cells["f2"] / cells["tokens"], cells["f1"] / cells["tokens"])), v)
    scored = rejoined(tables, lambda number, table: _score(table, buckets, weights, n, v, starts), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    held_out = (crc_mod("doc_id", PARTS) == HELD_OUT).alias("held_out")
    return scored.select("doc_id", held_out, "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
