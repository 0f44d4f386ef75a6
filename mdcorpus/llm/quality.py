"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the whole text are cut into bins; each feature, and each chosen pair of features, has a table that gives a
bin's part of the logit. Boosting goes round the features and adds a shallow tree on one feature (or pair) at a time
to its table. Scoring adds up looked-up values for a whole batch at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import crc_mod, first_by_hash, small_batches
from .textvec import _SYMBOLS, SPACES, U, Spans, blocks, encoded, give_back, mix, word_bounds

#: The model is fitted on this many labelled rows at most, the first by a hash of their ids.
FIT_ROWS = 20_000
BINS = 64
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 200
PAIR_ROUNDS = 100
RATE = 0.1
LEAVES = 4
LEAST_ROWS = 10
RIDGE = 1.0

FEATURES = (
    "log_words", "word_length", "longest_word", "upper", "lower", "digits", "symbols", "bars", "bangs", "stops", "commas", "beyond_ascii",
    "lines_per_word", "distinct_words", "commonest_word", "repeated_lines", "letterless_words", "symbol_ended_words", "upper_words",
)


def _class(chars) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


UPPER, LOWER, DIGIT, BEYOND = _class(range(65, 91)), _class(range(97, 123)), _class(range(48, 58)), _class(range(128, 256))
STOP, COMMA, BAR, BANG, LINE = _class(b".?"), _class(b",;:'\"-"), _class(b"|"), _class(b"!"), _class(b"\n")
SYMBOL = ~(UPPER | LOWER | DIGIT | BEYOND | STOP | COMMA | BAR | BANG | _class(range(33)))
KIND = np.select([UPPER, LOWER, DIGIT, SYMBOL, BAR, BANG, STOP, COMMA, BEYOND, LINE], range(1, 11), 0).astype(np.int64)


def features(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES for each text; zeros for texts without words."""
    out = [np.zeros((0, len(FEATURES)))]
    for a, b in blocks(texts):
        part = texts[a:b]
        n = b - a
        buf = np.frombuffer(b"\n".join(part) + b"\n", np.uint8)
        lengths = np.array([len(t) for t in part])
        text_of = np.repeat(np.arange(n), lengths + 1)
        kinds = np.bincount(text_of * 11 + KIND[buf], minlength=n * 11).reshape(n, 11).astype(float)
        starts, ends = word_bounds(SPACES[buf])
        owner = text_of[starts]
        words = np.bincount(owner, minlength=n)
        size = ends - starts
        spans = Spans(_SYMBOLS[buf])
        codes = spans(starts, ends) + mix(owner.astype(U))
        kinds_of, first, counts = np.unique(codes, return_index=True, return_counts=True)
        commonest = np.zeros(n, np.int64)
        np.maximum.at(commonest, owner[first], counts)
        line_at, line_end = word_bounds(buf != 10)
        line_owner = text_of[line_at]
        line_codes = spans(line_at, line_end) + mix(line_owner.astype(U))
        _, line_first = np.unique(line_codes, return_index=True)
        lines = np.bincount(line_owner, minlength=n)
        letters = np.concatenate([[0], np.cumsum((UPPER | LOWER | BEYOND)[buf])])
        lows = np.concatenate([[0], np.cumsum((LOWER | BEYOND)[buf])])
        no_letter = letters[ends] == letters[starts]
        upper_word = ~no_letter & (lows[ends] == lows[starts]) & (size > 1)
        ended = (SYMBOL | BANG)[buf[ends - 1]]
        per = lambda mask: np.bincount(owner, mask, n)
        longest = np.zeros(n, np.int64)
        np.maximum.at(longest, owner, size)
        w, c = np.maximum(words, 1), np.maximum(lengths, 1)
        rows = np.column_stack([
            np.log1p(words), per(size) / w, np.log1p(longest), kinds[:, 1] / c, kinds[:, 2] / c, kinds[:, 3] / c, kinds[:, 4] / c, kinds[:, 5] / w, kinds[:, 6] / w, kinds[:, 7] / w, kinds[:, 8] / w, kinds[:, 9] / c,
            (kinds[:, 10] - 1) / w, np.bincount(owner[first], minlength=n) / w, commonest / w, 1 - np.bincount(line_owner[line_first], minlength=n) / np.maximum(lines, 1), per(no_letter) / w, per(ended) / w, per(upper_word) / w,
        ])
        out.append(np.where((words > 0)[:, None], rows, 0.0))
    return np.concatenate(out)


class Model:
    """intercept + one table for each feature + one for each chosen pair."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        if not len(y):
            x, y = np.zeros((1, len(FEATURES))), np.array([0.5])
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.intercept = float(np.log(mean / (1 - mean)))
        self.edges = [np.unique(np.quantile(col, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for col in x.T]
        self.coarse = [np.unique(np.quantile(col, np.linspace(0, 1, PAIR_BINS + 1)[1:-1], method="lower")) for col in x.T]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        bins = [np.searchsorted(e, col, side="right") for e, col in zip(self.edges, x.T)]
        logit = np.full(len(y), self.intercept)
        for _ in range(ROUNDS):
            for f, b in enumerate(bins):
                step = RATE * _leaves(b, *_slopes(y, logit), len(self.tables[f]))
                self.tables[f] += step
                logit += step[b]
        wide = [np.searchsorted(e, col, side="right") for e, col in zip(self.coarse, x.T)]
        gains = sorted(((-_pair_gain(wide[i], wide[j], *_slopes(y, logit)), i, j) for i in range(x.shape[1]) for j in range(i)), key=lambda g: g)
        self.pairs = [(i, j) for gain, i, j in gains[:PAIRS] if gain < 0]
        self.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for t, (i, j) in zip(self.pair_tables, self.pairs):
                step = RATE * _quadrants(wide[i], wide[j], *_slopes(y, logit))[0]
                t += step
                logit += step[wide[i], wide[j]]

    def scores(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.intercept)
        for e, t, col in zip(self.edges, self.tables, x.T):
            logit += t[np.searchsorted(e, col, side="right")]
        for t, (i, j) in zip(self.pair_tables, self.pairs):
            logit += t[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-logit))


def _slopes(y, logit):
    p = 1 / (1 + np.exp(-logit))
    return y - p, p * (1 - p)


def _value(g, h):
    return g / (h + RIDGE)


def _gain(g, h):
    return g * g / (h + RIDGE)


def _leaves(b, g, h, n) -> np.ndarray:
    """A tree of up to LEAVES leaves over the bins of one feature: the value of each bin's leaf."""
    G, H, N = (np.concatenate([[0], np.cumsum(np.bincount(b, w, n))]) for w in (g, h, np.ones(len(b))))
    cuts = [0, n]
    while len(cuts) <= LEAVES:
        best = (1e-9, None)
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            at = np.arange(lo + 1, hi)
            if not len(at):
                continue
            gain = _gain(G[at] - G[lo], H[at] - H[lo]) + _gain(G[hi] - G[at], H[hi] - H[at]) - _gain(G[hi] - G[lo], H[hi] - H[lo])
            gain[(N[at] - N[lo] < LEAST_ROWS) | (N[hi] - N[at] < LEAST_ROWS)] = 0
            k = int(gain.argmax())
            best = max(best, (float(gain[k]), int(at[k])), key=lambda x: x[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    cuts = np.array(cuts)
    return np.repeat(_value(np.diff(G[cuts]), np.diff(H[cuts])), np.diff(cuts))


def _quadrants(i, j, g, h) -> tuple[np.ndarray, float]:
    """The best tree of one cut on either feature of a pair: its values on the grid, and its gain."""
    code = i * PAIR_BINS + j
    G, H, N = (np.bincount(code, w, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS).cumsum(0).cumsum(1) for w in (g, h, np.ones(len(i))))
    best, out = 0.0, np.zeros((PAIR_BINS, PAIR_BINS))
    for a in range(PAIR_BINS - 1):
        for b in range(PAIR_BINS - 1):
            quarters = [np.array([M[a, b], M[a, -1] - M[a, b], M[-1, b] - M[a, b], M[-1, -1] - M[a, -1] - M[-1, b] + M[a, b]]) for M in (G, H, N)]
            if quarters[2].min() < LEAST_ROWS:
                continue
            gain = _gain(quarters[0], quarters[1]).sum() - _gain(G[-1, -1], H[-1, -1])
            if gain > best:
                v = _value(quarters[0], quarters[1])
                best, out = gain, np.block([[np.full((a + 1, b + 1), v[0]), np.full((a + 1, PAIR_BINS - b - 1), v[1])], [np.full((PAIR_BINS - a - 1, b + 1), v[2]), np.full((PAIR_BINS - a - 1, PAIR_BINS - b - 1), v[3])]])
    return out, float(best)


def _pair_gain(i, j, g, h) -> float:
    return _quadrants(i, j, g, h)[1]


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """The model of labels.quality, from at most `rows` labelled documents whose crc32(doc_id) mod 3 is not 1.

    A document labelled more than once has its labels' mean; a null label is none.
    """
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 3) != 1))
    chosen = chosen.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("y"))
    chosen = first_by_hash(chosen.withColumn("h", F.xxhash64("doc_id")), rows).drop("h")

    def run(batches):
        for pdf in batches:
            out = pd.DataFrame(features(encoded(pdf["text"])), columns=list(FEATURES))
            yield out.assign(doc_id=pdf["doc_id"], y=pdf["y"])
            give_back()

    # of a repeated document the first text by hash counts
    found = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")
    found = found.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    schema = ", ".join(f"{f} double" for f in FEATURES) + ", doc_id long, y double"
    sample = found.mapInPandas(run, schema).toPandas().sort_values("doc_id")  # `rows` rows at most
    return Model(sample[list(FEATURES)].to_numpy(), sample["y"].to_numpy())


def scored(docs: DataFrame, model: Model, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """`docs` with a column `score` (0 to 1) and one `predicted` (1 from 0.5 on); the text alone is looked at, whole."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            p = held.value.scores(features([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*batch.schema.names, score, predicted])
            give_back()

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(score, DoubleType()), StructField(predicted, IntegerType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs(doc_id, text)`; labels are `labels(doc_id, quality)`.

    Null and empty texts are scored as texts without words, very long ones whole. Without labels every score is 0.5. Rows with null or
    repeated ids are scored like any other; other columns are ignored; an empty table gives an empty result.
    """
    model = fit(docs, labels, rows)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    held_out = (crc_mod("doc_id", 3) == 1).alias("held_out")
    return scored(docs, model).select("doc_id", held_out, "score", "predicted")
