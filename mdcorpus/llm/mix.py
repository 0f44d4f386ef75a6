"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut

SHARE = 1.5
MOST_REPEATS = 2
WEIGHTS = (3, 1, 2)
SEED = 42
#: Words in a block, at most; fewer where the smallest target would hold less than LEAST_BLOCKS of them.
BLOCK_WORDS = 256
LEAST_BLOCKS = 128
#: A shard holds about this many words or documents, so that a task can hold it, however large its source is.
SHARD_WORDS, SHARD_DOCS = 1 << 20, 1 << 13
#: So many shards, or groups of shards, are dealt seats in one task; a source with more deals them to groups first.
DEALT_AT_ONCE = 4096
#: So many sources may be broadcast (some dozen bytes each); more are joined.
BROADCAST_SOURCES = 100_000


def capped_shares(sizes: np.ndarray, weights: np.ndarray, total: float, most: float) -> np.ndarray:
    """Shares of `total` in proportion to weights, none above most * size; what lies above is shared again."""
    limits = most * sizes.astype(float)
    out = np.zeros(len(sizes))
    open_ = limits > 0
    left = min(float(total), limits.sum())
    while open_.any():
        share = np.where(open_, left * weights / weights[open_].sum(), 0.0)
        full = open_ & (share >= limits)
        if not full.any():
            return np.where(open_, share, out)
        out[full] = limits[full]
        left -= limits[full].sum()
        open_ &= ~full
    return out


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray | None = None) -> np.ndarray:
    """Seats by the highest quotients votes / (2 k + 1), no more than `most` each; ties go to the earlier party.

    A divisor found by bisection gives all but the last few seats at once; a heap of quotients gives those.
    """
    votes = votes.astype(float)
    most = np.full(len(votes), seats, np.int64) if most is None else most.astype(np.int64)
    most = np.where(votes > 0, most, 0)
    seats = int(min(seats, most.sum()))
    if seats <= 0:
        return np.zeros(len(votes), np.int64)
    # seats whose quotient lies above q: votes / (2k + 1) > q
    above = lambda q: np.minimum(most, np.ceil(np.maximum(votes / q - 1, 0) / 2).astype(np.int64))
    low, high = votes[votes > 0].min() / (4.0 * seats + 4), votes.max() * 2
    while above(low).sum() < seats:
        low /= 2
    for _ in range(200):
        middle = (low * high) ** 0.5
        if above(middle).sum() > seats:
            low = middle
        else:
            high = middle
    got = above(high)
    heap = [(-votes[i] / (2 * got[i] + 1), i) for i in np.flatnonzero(got < most)]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def _plan(sources: pd.DataFrame) -> pd.DataFrame:
    """Targets and blocks of each source; sources by code point, the null one last."""
    sources = sources.sort_values("name", na_position="last", key=lambda s: s.map(lambda x: x.encode("utf-8", "surrogatepass"), na_action="ignore")).reset_index(drop=True)
    weights = np.array([WEIGHTS[i % len(WEIGHTS)] for i in range(len(sources))], float)
    sizes = sources["source_size"].to_numpy(np.int64)
    target = capped_shares(sizes, weights, SHARE * sizes.sum(), MOST_REPEATS)
    smallest = target[target > 0].min() if (target > 0).any() else 1.0
    block = BLOCK_WORDS
    while block > 1 and smallest / block < LEAST_BLOCKS:
        block //= 2
    return sources.assign(target=target, block=block, seats=sainte_lague(target, round(target.sum() / block)))


def _deal(pdf: pd.DataFrame) -> pd.DataFrame:
    """The units of one group, each with its words and the most blocks it can give -> the blocks that each gives."""
    pdf = pdf.sort_values("unit")
    return pdf.assign(seats=sainte_lague(pdf["words"].to_numpy(np.int64), int(pdf["seats"].iloc[0]), pdf["most"].to_numpy(np.int64)))[["number", "unit", "seats"]]


def _quotas(counted: DataFrame, plan: DataFrame, shards: int) -> DataFrame:
    """`counted(number, shard, words)`, `plan(number, block, seats)` -> (number, shard, block, quota), if no source has more than `shards` shards.

    Neighbouring shards make groups of DEALT_AT_ONCE, those make groups again until a source has no more than that, and
    each group shares out what it was dealt, so no task holds all shards of a large source.
    """
    counted = counted.join(plan.select("number", "block"), "number").withColumn("most", MOST_REPEATS * F.expr("(words + block - 1) div block"))
    deep = 1
    while shards > DEALT_AT_ONCE**deep:
        deep += 1
    counted = cut(counted) if deep > 1 else counted
    seats = plan.select("number", F.lit(0).cast("long").alias("group"), "seats")
    for level in reversed(range(deep)):
        units = counted.groupBy("number", F.expr(f"shard div {DEALT_AT_ONCE**level}").alias("unit")).agg(F.sum("words").alias("words"), F.sum("most").alias("most"))
        dealt = units.withColumn("group", F.expr(f"unit div {DEALT_AT_ONCE}")).join(seats, ["number", "group"]).groupBy("number", "group").applyInPandas(_deal, "number int, unit long, seats long")
        seats = dealt.withColumnRenamed("unit", "group")
    return dealt.join(plan.select("number", "block"), "number").select("number", F.col("unit").cast("int").alias("shard"), "block", F.col("seats").alias("quota"))


def _select(pdf: pd.DataFrame, quotas: pd.DataFrame) -> pd.DataFrame:
    """One shard's documents in seeded order, cut into blocks; the quota's blocks, drawn by seed, say what is taken."""
    columns = ["doc_id", "known", "row", "number", "size", "taken"]
    if not len(pdf):
        return pd.DataFrame([], columns=columns)
    pdf = pdf.sort_values(["place", "known", "doc_id", "size", "row"])
    size = pdf["size"].to_numpy(np.int64)
    ends = np.cumsum(size)
    total = int(ends[-1])
    block, quota = (int(quotas["block"].iloc[0]), int(quotas["quota"].iloc[0])) if len(quotas) else (1, 0)
    n = -(-total // block)
    times = np.zeros(n, np.int64)
    if n:
        drawn = np.random.default_rng([SEED, int(pdf["number"].iloc[0]), int(pdf["shard"].iloc[0])]).permutation(n)
        times += quota // n
        times[drawn[: quota % n]] += 1
    # words taken before each block's start; within a block in proportion
    before = np.concatenate([[0], np.cumsum(times * np.minimum(block, total - np.arange(n) * block))])
    times = np.append(times, 0)
    upto = lambda w: before[w // block] + times[w // block] * (w % block)
    return pdf.assign(taken=upto(ends) - upto(ends - size))[columns]


def mix_sources(docs: DataFrame, row: str | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of `docs(doc_id, text, source)`, and its column `row`, if named.

    Sizes are numbers of words `[^\\x20\\x09-\\x0D]+` (null texts: 0). Sources, by code point and the null one last, weigh
    3, 1, 2, repeating, and share 150 % of all words; none gets above twice its own size. Blocks are dealt to sources
    and to shards within them by highest quotients; a shard's documents in seeded order are cut into blocks and drawn
    by seed, so reruns agree; the shards of a source of more than DEALT_AT_ONCE are dealt to in groups of so many. No document gives more than twice its size. Rows with null or repeated ids count as rows
    of their own; equal rows are interchangeable; texts without words, and sources of such, take nothing; an empty table
    gives an empty result. The driver holds a row for each source.
    """
    spark = docs.sparkSession
    sized = docs.select(
        F.col("doc_id").cast("long"), (F.col(row) if row else F.lit(None)).cast("long").alias("row"), F.col("source").cast("string").alias("name"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(SEED), "doc_id", F.xxhash64("text"), *([F.col(row)] if row else [])).alias("place"),
    )
    # equal rows are told apart by a number, so that many of them don't come to one shard
    sized = sized.groupBy(*sized.columns).agg(F.count("*").alias("n")).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    sized = cut(sized.withColumn("place", F.when(F.col("i") > 1, F.xxhash64("place", "i")).otherwise(F.col("place"))).drop("n", "i"))
    sources = sized.groupBy("name").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("rows")).toPandas()  # a short row for each source
    plan = _plan(sources).reset_index(names="number")
    shards = np.maximum(1, np.maximum(-(-plan["source_size"] // SHARD_WORDS), -(-plan["rows"] // SHARD_DOCS)))
    plan, most_shards = plan.assign(shards=shards.astype("int64")), int(shards.max()) if len(shards) else 1
    rows = [tuple(None if x is None or x != x else x for x in r) for r in plan[["number", "name", "source_size", "target", "block", "seats", "shards"]].astype(object).itertuples(index=False, name=None)]
    few = len(rows) <= BROADCAST_SOURCES
    plan = spark.createDataFrame(rows, "number int, name string, source_size long, target double, block long, seats long, shards long")
    plan = F.broadcast(plan) if few else plan
    dealt = sized.join(plan.select("number", "name", "shards"), sized["name"].eqNullSafe(plan["name"])).select(
        F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), F.coalesce("row", F.lit(0)).alias("row"), "number", "size", "place", F.pmod(F.col("place"), F.col("shards")).cast("int").alias("shard")
    )
    # texts without words give nothing and belong to no shard
    empty = dealt.where("size = 0").select("doc_id", "known", "row", "number", "size", F.lit(0).cast("long").alias("taken"))
    dealt = dealt.where("size > 0")
    counted = dealt.groupBy("number", "shard").agg(F.sum("size").alias("words"))
    quotas = _quotas(counted, plan.select("number", "block", "seats"), most_shards)
    taken = (
        dealt.groupBy("number", "shard").cogroup(cut(quotas).groupBy("number", "shard"))
        .applyInPandas(_select, "doc_id long, known boolean, row long, number int, size long, taken long")
    )
    own = [F.col("row").alias(row)] if row else []
    return taken.union(empty).join(plan.select("number", "source_size", "target"), "number").select(F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), "size", "source_size", "target", "taken", *own)
