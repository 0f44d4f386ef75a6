"""Merkle manifest of a dataset, stored in van Emde Boas layout.

Every row is a leaf; the rows of a source, ascending by doc_id, make a tree in which runs of 16 nodes become one, and the
sources' roots make one more. A tree is cut into aligned subtrees, `blocks`, of HEIGHT levels above their lowest. A block is
one row of a table and holds its digests in one array, recursively split at half height: first the upper half's, then those
of each lower subtree. A node's place in it follows from arithmetic alone (`address`), for building as for fetching siblings.
The roots of blocks are the lowest nodes of the next round's blocks, so a round shrinks a tree 4096-fold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, cut, small_batches

FANOUT, HEIGHT = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: key: source, "" for none, else with an "s" before it; n: nodes of its tree in this round; digests: a block's, laid out.
BLOCK = "key string, n long, block long, digests binary, root binary, doc_ids array<long>, tampered array<binary>"
BLOCKS = pa.schema([("key", pa.string()), ("n", pa.int64()), ("block", pa.int64()), ("digests", pa.binary()), ("root", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("tampered", pa.list_(pa.binary()))])
PATH = "key string, pos long, path binary, subroot binary"
PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def size(n, height: int, fanout: int = FANOUT):
    """Nodes of a tree of n lowest nodes and `height` levels above them."""
    return sum(-(-n // fanout**level) for level in range(height + 1))


def address(n, height: int, level: int, i, fanout: int = FANOUT):
    """Where node i (from the left) of a level (lowest: 0) lies in the layout of a tree of n lowest nodes and `height` levels above.

    Only the last subtree of a level can be incomplete, so what lies before a node is a number of whole subtrees.
    """
    if height == 0:
        return i
    low = (height - 1) // 2  # the lower half's height; the upper half begins one level above
    high, tops = height - low - 1, -(-n // fanout ** (low + 1))
    if level > low:
        return address(tops, high, level - low - 1, i, fanout)
    width = fanout ** (low - level)
    tree = i // width
    own = np.minimum(fanout**low, n - tree * fanout**low)
    return size(tops, high, fanout) + tree * size(fanout**low, low, fanout) + address(own, low, level, i % width, fanout)


def digest(hex_text: str) -> bytes:
    return sha256(hex_text.encode()).digest()


def height_of(n: int, most: int) -> int:
    """Levels of a block in a tree of n nodes: `most`, or what brings all of few nodes to one."""
    height = 0
    while height < most and n > FANOUT**height:
        height += 1
    return height


def laid_out(lowest: list[bytes], height: int) -> bytes:
    """The digests of a block over its lowest nodes' ones, in the layout."""
    n, level = len(lowest), lowest
    out = np.zeros((size(n, height), 32), np.uint8)
    for k in range(height + 1):
        out[address(n, height, k, np.arange(len(level)))] = np.frombuffer(b"".join(level), np.uint8).reshape(-1, 32)
        level = [digest(b"".join(level[a : a + FANOUT]).hex()) for a in range(0, len(level), FANOUT)]
    return out.tobytes()


def levels(digests: bytes, n: int, height: int) -> list[bytes]:
    """Each level's digests from left to right, lowest level first."""
    held = np.frombuffer(digests, np.uint8).reshape(-1, 32)
    return [held[address(n, height, k, np.arange(-(-n // FANOUT**k)))].tobytes() for k in range(height + 1)]


def steps(held: list[bytes], i: int) -> bytes:
    """The way from lowest node i to the block's root: for each level its place in its run, the run's length, the siblings."""
    out = []
    for level in held[:-1]:
        run, place = divmod(i, FANOUT)
        nodes = level[run * FANOUT * 32 : (run + 1) * FANOUT * 32]
        out += [bytes((place, len(nodes) // 32)), nodes[: place * 32], nodes[place * 32 + 32 :]]
        i = run
    return b"".join(out)


def each_step(path: bytes) -> Iterator[tuple[str, str]]:
    """The siblings before and after, in hex, level by level."""
    at = 0
    while at < len(path):
        place, n = path[at], path[at + 1]
        nodes = path[at + 2 : at + 2 + (n - 1) * 32].hex()
        yield nodes[: place * 64], nodes[place * 64 :]
        at += 2 + (n - 1) * 32


def folded(start: bytes, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    own = start.hex()
    for before, after in path:
        own = sha256((before + own + after).encode()).hexdigest()
    return own


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _leaf(text: Column) -> Column:
    values = {c: F.col(c) for c in FIELDS} | {"text": text}
    return F.unhex(F.sha2(F.concat(*[_field(c) for c in values.values()]).cast("binary"), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(key, doc_id, digest, tampered): texts are looked at here alone; tampered is null where nothing is tampered with."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    key = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    return docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), _leaf(F.col("text")).alias("digest"), F.when(chosen, _leaf(lowered)).alias("tampered"))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` with pos, the place (from 0) among those of the same key in ascending `order`, and n, the number of those.

    Ranges are sorted, not keys, so that no task holds a source; equal rows are told apart by where they were.
    """
    rows = cut(rows.withColumn("was", F.monotonically_increasing_id()))
    by = ["key", *order, "was"]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("was")
    # numbers ascend within a partition, whose own number is in their upper bits
    ranged = cut(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.shiftright("at", 33)))
    pieces = ranged.groupBy("key", "range").agg(F.min("at").alias("start"), F.count("*").alias("own"))
    of_key = Window.partitionBy("key")
    before = F.sum("own").over(of_key.orderBy("range")) - F.col("own")
    pieces = pieces.select("key", "range", (before - F.col("start")).alias("shift"), F.sum("own").over(of_key).alias("n"))
    return ranged.join(pieces, ["key", "range"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "shift", "range")


def blocks_of(nodes: DataFrame, height: int) -> DataFrame:
    """`nodes(key, n, pos, digest, doc_id, tampered)` as blocks of at most 16**height of them."""
    wide = FANOUT**height

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        n = table.column("n")[0].as_py()
        out = laid_out(table.column("digest").to_pylist(), height_of(n, height))
        row = [[table.column("key")[0].as_py()], [n], [table.column("pos")[0].as_py() // wide], [out], [out[:32]], [table.column("doc_id").to_pylist()], [table.column("tampered").to_pylist()]]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(row, BLOCKS)], schema=BLOCKS)

    return nodes.groupBy("key", F.expr(f"pos div {wide}").alias("b")).applyInArrow(run, BLOCK)


def built(nodes: DataFrame, height: int, scratch: Scratch, name: str) -> list[DataFrame]:
    """The rounds of blocks over all trees of `nodes`, each stored as a table; a tree is done with its round of one block."""
    wide, rounds = FANOUT**height, []
    while True:
        rounds.append(scratch.save(blocks_of(nodes, height), f"{name}-{len(rounds)}"))
        open_ = rounds[-1].where(F.col("n") > wide)
        if open_.isEmpty():
            return rounds
        none = F.lit(None)
        nodes = open_.select("key", F.expr(f"(n + {wide - 1}) div {wide}").alias("n"), F.col("block").alias("pos"), F.col("root").alias("digest"), none.cast("long").alias("doc_id"), none.cast("binary").alias("tampered"))


def tops(rounds: list[DataFrame], height: int) -> DataFrame:
    """(key, round, root) of each tree's highest block."""
    own = [b.where(F.col("n") <= FANOUT**height).select("key", F.lit(i).alias("round"), "root") for i, b in enumerate(rounds)]
    return reduce(DataFrame.union, own)


def _ways(batches: Iterator[pa.RecordBatch], height: int) -> Iterator[pa.RecordBatch]:
    """Blocks with their own way up -> (key, pos, path, subroot) of each of their lowest nodes."""
    for batch in batches:
        for r in batch.to_pylist():
            wide = FANOUT**height
            own = min(wide, r["n"] - r["block"] * wide)
            held = levels(r["digests"], own, height_of(r["n"], height))
            rows = [(r["key"], r["block"] * wide + i, steps(held, i) + r["path"], r["subroot"]) for i in range(own)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary(), pa.binary()))], names=["key", "pos", "path", "subroot"])


def _proofs(batches: Iterator[pa.RecordBatch], height: int, root: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            own = len(r["doc_ids"])
            held = levels(r["digests"], own, height_of(r["n"], height))
            above, rows = list(each_step(r["path"])), []
            for i, (doc_id, tampered) in enumerate(zip(r["doc_ids"], r["tampered"])):
                leaf = held[0][i * 32 : i * 32 + 32]
                way = [*each_step(steps(held, i)), *above]
                proof = sha256("".join(before + after for before, after in way).encode()).hexdigest()
                to = folded(leaf if tampered is None else tampered, way)
                rows.append((doc_id, leaf.hex(), r["subroot"].hex(), root, proof, to, to == root))
            types = (pa.int64(), *[pa.string()] * 5, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=[c.split()[0] for c in PROOF.split(", ")])


class Manifest:
    """The stored trees: `rounds` of the sources' blocks, `top` of those over the sources, `sources(key, pos, root, round)`, and `root`, in hex.

    root is None for an empty table.
    """

    def __init__(self, docs: DataFrame, height: int = HEIGHT):
        spark = docs.sparkSession
        small_batches(spark)
        self.height, scratch = height, Scratch(spark, "manifest")
        self.rounds = built(placed(leaves(docs), "doc_id", "digest"), height, scratch, "source")
        subroots = tops(self.rounds, height).select(F.lit("").alias("key"), F.col("key").alias("source"), "round", F.col("root").alias("digest"))
        none = F.lit(None)
        self.sources = scratch.save(placed(subroots, "source"), "sources")
        self.top = built(self.sources.select("key", "n", "pos", "digest", none.cast("long").alias("doc_id"), none.cast("binary").alias("tampered")), height, scratch, "top")
        root = tops(self.top, height).select("root").first()
        self.root = bytes(root[0]).hex() if root else None

    def stored(self) -> DataFrame:
        """(key, place, round, block, n, digests): every block; place: its own in the layout of its tree's blocks."""
        wide = FANOUT**self.height
        tree = tops(self.rounds, self.height).select("key", F.col("round").alias("last"))
        every = reduce(DataFrame.union, [b.select("key", F.lit(i).alias("round"), "block", "n", "digests") for i, b in enumerate(self.rounds)])
        known = every.join(tree, "key").withColumn("first", F.col("n") * F.pow(F.lit(float(wide)), F.col("round")))

        def place(batches):
            for pdf in batches:
                # the blocks of round 0 are the lowest nodes of a tree of fan-out `wide`
                at = [int(address(-(-int(first) // wide), int(last), int(r), int(b), wide)) for first, last, r, b in zip(pdf["first"], pdf["last"], pdf["round"], pdf["block"])]
                yield pdf.assign(place=at)[["key", "place", "round", "block", "n", "digests"]]

        return known.mapInPandas(place, "key string, place long, round int, block long, n long, digests binary")

    def proofs(self) -> DataFrame:
        """A row of PROOF for each leaf. Siblings come from the blocks on its way, top down, joined once a block, not once a leaf."""
        height = self.height
        down = lambda blocks, paths: blocks.join(paths.withColumnRenamed("pos", "block"), ["key", "block"])
        ways = lambda joined: joined.select("key", "n", "block", "digests", "path", "subroot").mapInArrow(lambda b: _ways(b, height), PATH)
        start = lambda keys: keys.select("key", F.lit(0).cast("long").alias("pos"), F.lit(b"").alias("path"), F.lit(b"").alias("subroot"))
        paths = start(tops(self.top, height))
        for blocks in reversed(self.top):
            paths = ways(down(blocks, paths))
        of_source = paths.select("pos", "path").join(self.sources, "pos").select(F.col("source").alias("key"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "round")
        of_source = cut(of_source)
        paths = None
        for i, blocks in reversed(list(enumerate(self.rounds))):
            own = of_source.where(F.col("round") == i).drop("round")  # trees whose highest block is of this round
            paths = own if paths is None else paths.union(own)
            if i:
                paths = cut(ways(down(blocks, paths)))
        last = down(self.rounds[0], paths).select("key", "n", "digests", "path", "subroot", "doc_ids", "tampered")
        root = self.root
        return last.mapInArrow(lambda b: _proofs(b, height, root), PROOF)


def manifest_proofs(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of `docs` (FIELDS).

    Null values are part of a leaf as `-`; rows of no source are a tree of their own, the first. Rows of null ids come first in
    their source and are never tampered with; rows of equal ids are in the order of their leaves, and equal rows have a leaf and
    a row each. Texts of any length are hashed whole by Spark's own functions and not passed on. Other columns are ignored; an empty table gives an
    empty result.
    """
    return Manifest(docs, height).proofs()
