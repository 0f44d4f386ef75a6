"""Chunks of documents that ask all of the corpus about their keys.

Documents are read where they lie, in chunks of bounded size. A chunk sends its distinct keys once, packed, to the buckets
that own them; a bucket answers all chunks at once. What a chunk or bucket sends is one row (a `MESSAGE`) a receiver,
so hot keys and groups of copies cost a chunk one key at most, however many rows hold them.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches
from .textvec import _SYMBOLS, Spans, give_back

#: role: what the row is for; level: which round it belongs to; n: how many keys; body: packed arrays.
MESSAGE = "role string, level int, chunk long, bucket int, n long, body binary"
ARROW = pa.schema([("role", pa.string()), ("level", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("n", pa.int64()), ("body", pa.binary())])
CHUNK_BYTES, BUCKET_BYTES, LEAST_BUCKETS = 3 << 20, 16 << 20, 32
HASHED_BYTES = 1 << 19


def freeze(*parts) -> bytes:
    """Arrays of whole numbers, as planes of their low bytes, and anything else that pickles, compressed."""
    held = []
    for x in parts:
        if isinstance(x, np.ndarray) and x.dtype.kind in "iub":
            x = x.astype(np.int64, copy=False)
            width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) and x.min() >= 0 else 8
            held.append((width, np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()))
        else:
            held.append(x)
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(held))


def thaw(body: bytes) -> list:
    """What `freeze` packed; whole numbers come back as int64."""
    out = []
    for x in pickle.loads(zstandard.ZstdDecompressor().decompress(body)):
        if isinstance(x, tuple) and len(x) == 2 and isinstance(x[1], bytes):
            planes = np.frombuffer(x[1], np.uint8).reshape(x[0], -1)
            values = np.zeros((planes.shape[1], 8), np.uint8)
            for i, plane in enumerate(planes):
                values[:, i] = plane
            x = values.reshape(-1).view(np.int64)
        out.append(x)
    return out


def messages(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)] if rows else [pa.array([], f.type) for f in ARROW], schema=ARROW)


def received(table: pa.Table, role: str, level: int = 0) -> list[tuple[int, int, int, list]]:
    """(chunk, bucket, n, parts) of the messages of a role and level, by chunk and bucket."""
    rows = zip(*(table.column(c).to_pylist() for c in ("chunk", "bucket", "n", "role", "level")))
    body = table.column("body")
    found = sorted((c, b, n, i) for i, (c, b, n, r, k) in enumerate(rows) if (r, k) == (role, level))
    return [(c, b, n, thaw(body[i].as_py())) for c, b, n, i in found]


def sizes(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """How many buckets the documents' texts call for."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(LEAST_BUCKETS, -(-total // bucket_bytes))


def save(scratch: Scratch, messages: DataFrame, name: str) -> DataFrame:
    return scratch.save(messages, name, "role")


def chunked(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Consecutive rows with about `size` bytes of `text` together (a longer text is a chunk of its own)."""
    held, have = [], 0
    for batch in batches:
        ends = np.cumsum([n or 0 for n in pc.binary_length(batch.column("text")).to_pylist()])
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(int(np.searchsorted(ends, before + size - have, side="right")), at + (not held))
            if to > at:
                held.append(batch.slice(at, to - at))
                have += int(ends[to - 1]) - before
            if to < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, have = [], 0
            at = to
    if held:
        yield pa.Table.from_batches(held)


def by_chunk(docs: DataFrame, make: Callable[[int, pa.Table], list[tuple]], chunk_bytes: int) -> DataFrame:
    """The messages that `make(chunk number, rows)` gives for each chunk. Chunks are numbered by task: save the result."""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() << 32
        for i, rows in enumerate(chunked(batches, chunk_bytes)):
            yield from messages(make(task + i, rows)).to_batches()
            give_back()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, MESSAGE)


def answered(asked: DataFrame, answer: Callable[[list], list[tuple]], role: str = "ask", level: int = 0) -> DataFrame:
    """The messages that `answer(bucket, received messages)` gives for each bucket."""
    asked = asked.where((F.col("role") == role) & (F.col("level") == level))

    def run(t):
        out = messages(answer(t.column("bucket")[0].as_py(), received(t, role, level)))
        give_back()
        return out

    return asked.groupBy("bucket").applyInArrow(run, MESSAGE)


def rejoined(tables: list[DataFrame], make: Callable[[int, pa.Table], pa.Table], schema: str) -> DataFrame:
    """`make(chunk number, all messages to the chunk)` for each chunk; `tables` hold the chunks' states and their answers."""
    union = tables[0]
    for t in tables[1:]:
        union = union.unionByName(t)

    def run(t):
        out = make(t.column("chunk")[0].as_py(), t)
        give_back()
        return out

    return union.where("role <> 'ask'").groupBy("chunk").applyInArrow(run, schema)


def numbered_words(texts: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words `[^\\x20\\x09-\\x0D]+`, number of each word of all texts, offsets: words of text i are [offsets[i], offsets[i + 1])).

    Null texts have no words.
    """
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = lists.flatten()
    full = pc.binary_length(words).to_numpy() > 0
    edges = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(), dtype=np.int64)])
    offsets = np.concatenate([[0], np.cumsum(full)])[edges]
    coded = words.filter(pa.array(full)).cast(pa.binary()).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), offsets


def bytes_of(words: pa.Array) -> tuple[np.ndarray, bytes]:
    """Lengths and bytes, one word behind the other; `words_of` turns them back."""
    words = pa.concat_arrays([words])
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    return np.diff(offsets), bytes(memoryview(data)[offsets[0] : offsets[-1]]) if data else b""


def words_of(lengths: np.ndarray, data: bytes) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def dealt_words(words: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the words by bucket, place in that order where each bucket's words start, and their number)."""
    lengths, data = bytes_of(words)
    ends = np.cumsum(lengths)
    data, at, spread = np.frombuffer(data, np.uint8), 0, [np.zeros(0, np.uint64)]  # only says where a word is sent
    while at < len(ends):  # some words at a time
        start = int(ends[at] - lengths[at])
        to = max(at + 1, int(np.searchsorted(ends, start + HASHED_BYTES)))
        spread.append(Spans(_SYMBOLS[data[start : ends[to - 1]]])(ends[at:to] - lengths[at:to] - start, ends[at:to] - start))
        at = to
    return dealt((np.concatenate(spread) % np.uint64(buckets)).astype(np.int64), buckets)


def dealt(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def slices(edges: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(bucket, its slice) where there is one."""
    for b in np.flatnonzero(np.diff(edges)).tolist():
        yield b, slice(int(edges[b]), int(edges[b + 1]))


def ramp(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def in_documents(key: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n keys is in more than one of the ascending documents."""
    first, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
    first[key[::-1]] = doc[::-1]
    last[key] = doc
    return first != last
