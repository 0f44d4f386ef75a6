"""Byte-level BPE by traversal of a trie of words.

The last token of a prefix's encoding depends on the prefix alone: it is the one token that ends the prefix and may follow the
last token of what stands before it. Distinct words, sorted, are a trie in depth-first order: going from one word to the next
keeps the states of their common prefix and works out those below it, so a prefix shared by many words is encoded once.
Two tokens may stand side by side if the merges that make them leave no earlier merge across their border.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .exchange import ramp
from .textvec import give_back

# Fixed value: how byte-level tokenizers split text before merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Between a character that is no white space and one that is, text can be cut without changing how it splits.
CUT = regex.compile(r"\S(?=\s)")
#: Text is split so many characters at a time.
PIECE_CHARS = 1 << 19
#: Words, their tokens, and answers on pairs that a worker keeps; then it begins anew.
KEPT_WORDS, KEPT_TOKENS, KEPT_PAIRS, KEPT_BYTES = 1_000_000, 6 << 20, 1 << 19, 64 << 20
NEVER = 1 << 40


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the files: itself, if it prints, else the next free one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    """Encoder and decoder of a tokenizer file with byte-level BPE; `source` is its JSON."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("not a plain byte-level BPE tokenizer")
        letters = byte_letters()
        raw = lambda text: bytes(letters[c] for c in text)
        own = {raw(t): i for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("special tokens that take in what stands around them aren't supported")
        #: The bytes of each id.
        self.bytes: list[bytes | None] = [None] * (1 + max([*own.values(), *self.special.values()]))
        for t, i in chain(own.items(), ((c.encode(), i) for c, i in self.special.items())):
            self.bytes[i] = t
        #: (left, right) -> rank; for a token its rank and its two parts, -1 for bytes.
        self.merges: dict[tuple[int, int], int] = {}
        n = len(self.bytes)
        self.rank, self.left, self.right = [-1] * n, [-1] * n, [-1] * n
        made = []
        for rank, pair in enumerate(model["merges"]):
            a, b = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            to = own[a + b]
            if self.rank[to] >= 0:
                raise ValueError(f"{a + b!r} is made by two merges")
            self.merges[own[a], own[b]] = rank
            self.rank[to], self.left[to], self.right[to] = rank, own[a], own[b]
            made.append(to)
        # a token is ever made only if its parts are, and no earlier merge crosses them
        good = {i for t, i in own.items() if len(t) == 1}
        for to in made:
            a, b = self.left[to], self.right[to]
            if a in good and b in good and not self._crossed(a, b, self.rank[to]):
                good.add(to)
        #: Every end of a token -> its id, if it is a token itself, else -1.
        self.ends: dict[bytes, int] = {}
        for i in good:
            t = self.bytes[i]
            for a in range(1, len(t)):
                self.ends.setdefault(t[a:], -1)
            self.ends[t] = i
        self.pairs: dict[int, bool] = {}
        self.split = regex.compile(PATTERN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.sizes, self.flat, self.held = array("q"), array("q"), array("i"), 0

    def _crossed(self, a: int, b: int, outer: int = NEVER) -> bool:
        """Whether, while a and b are made side by side and before rank `outer`, a merge takes the end of one and the start of the other."""
        merges, rank = self.merges, self.rank
        until_a = outer
        while a >= 0:
            y, until_b = b, outer
            while y >= 0:
                m = merges.get((a, y))
                # of equal merges the one further left comes first: one inside a goes before, one inside b after
                if m is not None and m < until_a and (m < outer if y == b else m <= until_b):
                    return True
                until_b, y = rank[y], self.left[y]
            until_a, a = rank[a], self.right[a]
        return False

    def follows(self, a: int, b: int) -> bool:
        """Whether token b may stand behind token a (-1: at the start); answers are kept in `pairs`."""
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        found = self.pairs[a << 32 | b] = a < 0 or not self._crossed(a, b)
        return found

    def walk(self, words: Iterable[bytes]) -> Iterator[list[int]]:
        """The tokens of each of the sorted words. `last[d]` is the last token of the path's first d bytes."""
        ends, pairs, follows = self.ends, self.pairs, self.follows
        last, before = array("i", [-1]), b""
        for word in words:
            depth, most = 0, min(len(before), len(word))
            while depth < most and before[depth] == word[depth]:
                depth += 1
            del last[depth + 1 :]
            for d in range(depth + 1, len(word) + 1):
                at = d - 1
                while True:
                    t = ends[word[at:d]]
                    if t >= 0:
                        fits = pairs.get(last[at] << 32 | t)
                        if fits or fits is None and follows(last[at], t):
                            break
                    at -= 1
                last.append(t)
            tokens, d = [], len(word)
            while d:
                tokens.append(last[d])
                d -= len(self.bytes[last[d]])
            tokens.reverse()
            yield tokens
            before = word

    def _learn(self, words: set[str]) -> None:
        fresh = sorted((w.encode("utf-8", "surrogatepass"), w) for w in words)
        for (raw, word), tokens in zip(fresh, self.walk(raw for raw, _ in fresh)):
            self.known[word] = len(self.starts)
            self.starts.append(len(self.flat))
            self.sizes.append(len(tokens))
            self.flat.extend(tokens)
            self.held += len(raw)

    def _pieces(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > PIECE_CHARS:
            found = CUT.search(text, at + PIECE_CHARS - 1)
            if not found:
                break
            yield text[at : found.end()]
            at = found.end()
        yield text[at:]

    def _words(self, text: str) -> Iterator[tuple[list[str], int]]:
        """(words, special token behind them or -1), a bounded number of words at a time but for one that is longer."""
        parts = self.specials.split(text) if self.specials else [text]
        for i in range(0, len(parts), 2):
            for piece in self._pieces(parts[i]):
                yield self.split.findall(piece), -1
            if i + 1 < len(parts):
                yield [], self.special[parts[i + 1]]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all texts, offsets: those of text i are [offsets[i], offsets[i + 1])); null texts have none."""
        out, offsets, total = [np.zeros(0, np.int32)], [0], 0
        todo = ((i, *part) for i, t in enumerate(texts) for part in (self._words(t) if t else ()))
        counts = np.zeros(len(texts), np.int64)
        while True:
            block, size = [], 0
            for part in todo:
                block.append(part)
                size += sum(map(len, part[1]))
                if size >= PIECE_CHARS:
                    break
            if not block:
                break
            self._learn(set(chain.from_iterable(words for _, words, _ in block)).difference(self.known))
            starts, sizes, flat = np.frombuffer(self.starts, np.int64), np.frombuffer(self.sizes, np.int64), np.frombuffer(self.flat, np.int32)
            for i, words, special in block:
                if special >= 0:
                    tokens = np.array([special], np.int32)
                else:
                    codes = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
                    tokens = flat[ramp(starts[codes], sizes[codes])] if len(codes) else np.zeros(0, np.int32)
                out.append(tokens)
                counts[i] += len(tokens)
            del starts, sizes, flat
            if len(self.known) > KEPT_WORDS or len(self.flat) > KEPT_TOKENS or self.held > KEPT_BYTES:
                self._forget()
        return np.concatenate(out), np.concatenate([[0], np.cumsum(counts)])

    def decode(self, tokens: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The text of each run of tokens; bytes that are no UTF-8 become U+FFFD."""
        held = self.bytes
        edges = offsets.tolist()
        return [b"".join([held[i] for i in tokens[a:b].tolist()]).decode("utf-8", "replace") for a, b in zip(edges, islice(edges, 1, None))]


_made: dict[bytes, Bpe] = {}


def _coder(source: str) -> Bpe:
    """One for each worker and tokenizer, with what it has learned of earlier tasks' words."""
    key = sha256(source.encode()).digest()
    if key not in _made:
        _made.clear()
        _made[key] = Bpe(source)
    return _made[key]


def _mapped(rows: DataFrame, tokenizer: str, make, columns: str) -> DataFrame:
    """`make(coder, column of the batch)` for each batch beside the other columns; the file at `tokenizer` is read once, here."""
    small_batches(rows.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        source = f.read()
    Bpe(source)  # a file that isn't supported fails here
    held = rows.sparkSession.sparkContext.broadcast(source)  # a vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            coder = coder or _coder(held.value)
            yield from make(coder, batch)
            give_back()

    return rows.mapInArrow(run, columns)


def _lists(tokens: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tokens, pa.int32()))


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids): the tokens of each text of `docs(doc_id, text)`, as the file at `tokenizer` has them.

    Null and empty texts have none. Special tokens written out in a text are taken as such. Null and repeated ids and repeated rows are encoded row by
    row; other columns are ignored; an empty table gives an empty result. Long texts are split in pieces where white space begins; a
    single word of any length is walked with one number a byte.
    """

    def make(coder: Bpe, batch: pa.RecordBatch):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(*coder.encode(batch.column("text").to_pylist()))], names=["doc_id", "ids"])

    return _mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), tokenizer, make, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text) of `rows(doc_id, ids)`: special tokens included; null lists give empty texts, ids that the vocabulary lacks an error."""

    def make(coder: Bpe, batch: pa.RecordBatch):
        lists = batch.column("ids").fill_null([])
        lengths = np.array([len(x) for x in lists.to_pylist()], np.int64)
        texts = coder.decode(lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return _mapped(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")), tokenizer, make, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids, text): what `encoded` and then `decoded` give, in one pass over `docs(doc_id, text)`."""

    def make(coder: Bpe, batch: pa.RecordBatch):
        tokens, offsets = coder.encode(batch.column("text").to_pylist())
        texts = coder.decode(tokens, offsets)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(tokens, offsets), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return _mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), tokenizer, make, "doc_id long, ids array<int>, text string")


def digests(trips: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of `round_trip`'s rows."""
    return trips.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
