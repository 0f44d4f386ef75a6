"""Substring dedup by recompression.

Spark rounds give every distinct word a number, then every distinct run or pair of neighbouring symbols that the last round
left, so that equal stretches of words come to hold equal symbols whichever documents they stand in. Symbols are of a left
or a right class by their name, and a left one followed by a right one is a pair. A symbol carries the span of words that its
forming depends on: wherever those words occur, the symbol forms. A symbol found in one document only rules out all windows
that hold its span. Of those left, each window names the highest symbol with its span inside; stretches around a
shared symbol meet, by the words at one side of it, in a bucket where their windows are compared word by word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, release
from .exchange import CHUNK_BYTES, MESSAGE, answered, by_chunk, bytes_of, dealt, dealt_words, freeze, in_documents, messages, numbered_words, ramp, received, rejoined, save, sizes, slices, words_of
from .textvec import BASE, U, mix

WINDOW = 13
#: Symbols of so many rounds span up to eight words (runs more), and with what their forming depends on most of a window. A fourth
#: round rules out little more: each round's state is worked out again from the first one's.
ROUNDS = 3
#: Names of different rounds differ: a name is a number within its bucket, the bucket and the round.
LEVELS = 8
ALONE = -1


def _name(number: np.ndarray, bucket: int, buckets: int, level: int) -> np.ndarray:
    return (number * buckets + bucket) * LEVELS + level + 1


def _right(name: np.ndarray) -> np.ndarray:
    """Which names are of the right class."""
    return (mix(name.astype(U) * U(BASE)) >> U(63)).astype(bool)


class Open:
    """The stretches of a chunk that windows cover which may repeat, as far as the rounds have named them."""

    def __init__(self, table: pa.Table, window: int, upto: int):
        """`table`: the chunk's open stretches and the answers of the rounds before `upto`."""
        ((_, _, _, state),) = received(table, "state", 1)
        self._start(window, *state)
        for level in range(1, upto):
            self._form()
            self._take([parts[0] for *_, parts in received(table, "answer", level)])

    @classmethod
    def started(cls, window: int, *state) -> Open:
        self = cls.__new__(cls)
        self._start(window, *state)
        return self

    def _start(self, window: int, token, name, offsets, rows, ids, buckets: int) -> None:
        """token: number of each word; name: of each number; rows, ids: of each stretch's document."""
        self.window, self.token, self.name, self.offsets, self.rows, self.ids, self.buckets = window, token, name, offsets, rows, ids, buckets
        n = len(token)
        self.stretch = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))
        self.fits = np.arange(n) + window <= self.offsets[self.stretch + 1]
        self.shut = np.zeros(n + 1, np.int64)
        self.word = self.name[self.token]
        #: the symbols now: number, word they start at, first word needed, word past the last needed, whether they stay apart
        self.symbol, self.at, self.a = self.token, np.arange(n), np.arange(n)
        self.b, self.barrier = self.a + 1, np.zeros(n, bool)
        #: first word needed, word past the last needed and name of the shared symbols of each round
        self.shared = [(self.a, self.b, self.word)]

    def _rule_out(self, which: np.ndarray) -> None:
        """No window that holds the span of one of these symbols repeats."""
        a, n = self.a[which], len(self.shut)
        first = np.maximum(self.b[which] - self.window, self.offsets[self.stretch[a]])
        self.shut += np.bincount(first, minlength=n) - np.bincount(a + 1, minlength=n)

    def open_windows(self) -> np.ndarray:
        """Whether a window that may repeat starts at each word."""
        return (np.cumsum(self.shut)[:-1] == 0) & self.fits

    def _form(self) -> None:
        """The next round's pairs and runs: their places and spans, and the distinct ones that are asked about."""
        n = len(self.symbol)
        stretch = self.stretch[self.at]
        low, high = self.offsets[stretch], self.offsets[stretch + 1]
        follows = np.concatenate([stretch[1:] == stretch[:-1], [False]])[:n]
        leads = np.concatenate([[False], follows[:-1]])[:n]
        nxt, prv = np.minimum(np.arange(n) + 1, n - 1), np.maximum(np.arange(n) - 1, 0)
        right, free = _right(self.name[self.symbol]), ~self.barrier
        pair = free & ~right & follows & (free & right)[nxt]
        second = pair[prv] & leads
        # one left alone is so because of its neighbours (and theirs, where an equal neighbour is paired)
        alone, equal = free & ~pair & ~second, self.symbol[nxt] == self.symbol
        near = np.where(follows, self.b[np.where(equal & pair[nxt], nxt[nxt], nxt)], high + 1)
        b = np.where(alone, np.maximum(self.b, near), np.where(pair, self.b[nxt], self.b))
        near = np.where(leads, self.a[np.where(equal[prv] & second[prv], prv[prv], prv)], low - 1)
        a = np.where(alone, np.minimum(self.a, near), self.a)
        partner, keep = np.where(pair, self.symbol[nxt], ALONE), ~second
        # runs of equal symbols that are left over; where they end depends on what stands beside them
        again = alone & follows & alone[nxt] & equal
        starts = np.flatnonzero(again & ~(again[prv] & leads))
        ends = np.flatnonzero(~again)
        ends = ends[np.searchsorted(ends, starts)]
        run = np.zeros(n, np.int64)
        run[starts] = ends - starts + 1
        before = np.maximum(starts - 1 - second[prv[starts]], 0)
        run_a = np.where(leads[starts], a[before], low[starts] - 1)
        b[starts] = np.where(follows[ends], b[nxt[ends]], high[starts] + 1)
        a[starts] = run_a
        keep &= ~(again[prv] & leads)
        made = (pair | (run > 0))[keep]
        self.symbol, self.at, self.a, self.b, self.barrier = self.symbol[keep], self.at[keep], a[keep], b[keep], self.barrier[keep]
        partner, run, low, high = partner[keep], run[keep], low[keep], high[keep]
        # only symbols whose span lies in a window that may repeat are asked about; others stay apart from now on
        inside = np.concatenate([[0], np.cumsum(self.open_windows())])
        asks = made & (self.b - self.a <= self.window) & (self.a >= low) & (self.b <= high)
        asks[asks] = inside[self.a[asks] + 1] > inside[np.maximum(self.b[asks] - self.window, low[asks])]
        self.barrier |= made & ~asks
        self.asking = np.flatnonzero(asks)
        code = (self.symbol[asks] * (len(self.name) + 1) + partner[asks] + 1) * (int(run.max(initial=0)) + 1) + run[asks]
        _, one, self.which = np.unique(code, return_index=True, return_inverse=True)
        self.several = in_documents(self.which, self.rows[self.stretch[self.at[self.asking]]], len(one))
        one = self.asking[one]
        self.asked = self.name[self.symbol[one]], np.where(run[one] > 0, 0, self.name[partner[one]]), run[one]

    def deal(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        x, y, run = (v.astype(U) for v in self.asked)
        return dealt((mix(mix(mix(x) + y * U(BASE)) + run) % U(buckets)).astype(np.int64), buckets)

    def asks(self, level: int, number: int) -> list[tuple]:
        """The next round's messages."""
        self._form()
        order, edges = self.deal(self.buckets)
        return [("ask", level, number, b, s.stop - s.start, freeze(*(v[order[s]] for v in self.asked), self.several[order[s]])) for b, s in slices(edges)]

    def _take(self, answers: list[np.ndarray]) -> None:
        """Take the names (0: in one document only) of what the last round asked about."""
        told = np.concatenate(answers) if answers else np.zeros(0, np.int64)
        if len(told) != len(self.asked[0]):
            raise RuntimeError("a chunk's answers don't fit its keys")
        name = np.zeros(len(told), np.int64)
        name[self.deal(self.buckets)[0]] = told  # answers come by bucket
        of = name[self.which]
        lone, named = self.asking[of == 0], self.asking[of > 0]
        self._rule_out(lone)
        self.barrier[lone] = True
        self.symbol[named] = len(self.name) + self.which[of > 0]
        self.name = np.concatenate([self.name, name])
        self.shared.append((self.a[named], self.b[named], of[of > 0]))

    def stretches(self):
        """(key, first word, first word of the last window) of stretches around symbols, which hold all windows that may repeat.

        A window's key is of its symbol's name and the words at one side of it: the left side if the symbol stands in the window's
        right half, else the right. Equal windows have equal keys, and a symbol in very many contexts has as many keys.
        """
        starts = np.flatnonzero(self.open_windows())
        out = []
        for a, b, name in reversed(self.shared):
            low, high = np.searchsorted(a, starts), np.searchsorted(b, starts + self.window, side="right")
            has = high > low
            own, low, high = starts[has], low[has], high[has]
            starts = starts[~has]
            if not len(own):
                continue
            distinct, inverse = np.unique(name, return_inverse=True)
            rank = np.empty(len(distinct), np.int64)
            rank[np.lexsort((distinct, mix(distinct.astype(U))))] = np.arange(len(distinct))
            # the least of a window's symbols by a hash of the name, the first of equal ones
            least = [rank[inverse] * len(a) + np.arange(len(a))]
            while 2 ** len(least) <= (high - low).max():
                step = 2 ** (len(least) - 1)
                least.append(np.minimum(least[-1], np.append(least[-1][step:], least[-1][-step:])))
            k = np.frexp((high - low).astype(float))[1] - 1
            least = np.array(least)
            chosen = np.minimum(least[k, low], least[k, high - 2**k]) % len(a)
            # words beside the symbol's span in a window, and how many of them all windows have that have most at the left
            beside = self.window - (b - a)[chosen]
            left = a[chosen] - own > beside // 2
            piece = 2 * chosen + ~left
            order = np.argsort(piece, kind="stable")
            edge = np.flatnonzero(np.diff(piece[order], prepend=-1))
            first, chosen, beside, left = own[order][edge], chosen[order][edge], beside[order][edge], left[order][edge]
            start = np.where(left, a[chosen] - beside // 2 - 1, a[chosen])
            end = np.where(left, b[chosen], a[chosen] + self.window - beside // 2)
            key = mix(name[chosen].astype(U) * U(BASE) + left.astype(U))
            for i in range(int((end - start).max())):
                key = np.where(start + i < end, mix(key * U(BASE) + self.word[np.minimum(start + i, len(self.word) - 1)].astype(U)), key)
            out.append((key, first, own[order][np.append(edge[1:], len(order)) - 1]))
        if not out:
            return np.zeros(0, U), *(np.zeros(0, np.int64),) * 2
        return tuple(map(np.concatenate, zip(*out)))


def _begin(number: int, rows: pa.Table, buckets: int, carry: list[str]) -> list[tuple]:
    """The chunk's state, and its distinct words to the buckets that number them."""
    words, token, offsets = numbered_words(rows.column("text"))
    order, edges = dealt_words(words, buckets)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    token, words = place[token], words.take(pa.array(order))
    several = in_documents(token, np.repeat(np.arange(rows.num_rows), np.diff(offsets)), len(words))
    ids = rows.column("doc_id")
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.select(["doc_id", *carry]).schema) as w:
        w.write_table(rows.select(["doc_id", *carry]))
    state = freeze(token, offsets, ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy())
    # what only the last step needs does not go along before
    own = freeze(*bytes_of(words), sink.getvalue().to_pybytes())
    asks = [("ask", 0, number, b, s.stop - s.start, freeze(*bytes_of(words[s.start : s.stop]), several[s])) for b, s in slices(edges)]
    return [("state", 0, number, -1, 0, state), ("own", 0, number, -1, 0, own), *asks]


def _answer_words(bucket: int, asked: list, buckets: int) -> list[tuple]:
    """The number of each word, and whether it is in one document only."""
    coded = pa.concat_arrays([words_of(*parts[:2]) for *_, parts in asked]).dictionary_encode()
    own, several = coded.indices.to_numpy().astype(np.int64), np.concatenate([parts[2] for *_, parts in asked])
    name, lone = _name(own, bucket, buckets, 0), np.bincount(own, 1 + several)[own] < 2
    edges = np.cumsum([0] + [n for _, _, n, _ in asked])
    return [("answer", 0, c, bucket, n, freeze(name[s:e], lone[s:e])) for (c, _, n, _), s, e in zip(asked, edges[:-1], edges[1:])]


def _open(number: int, table: pa.Table, window: int, buckets: int) -> pa.Table:
    """The stretches covered by windows without a word of one document only, and their first runs and pairs."""
    ((_, _, _, (token, offsets, ids, known)),) = received(table, "state")
    told = [parts for *_, parts in received(table, "answer", 0)]
    name, lone = (np.concatenate(x) for x in zip(*told)) if told else (np.zeros(0, np.int64),) * 2
    n, doc = len(token), np.repeat(np.arange(len(ids)), np.diff(offsets))
    starts = np.flatnonzero(known[doc].astype(bool) & (np.arange(n) + window <= offsets[doc + 1]))
    lones = np.concatenate([[0], np.cumsum(lone[token])])
    starts = starts[lones[starts + window] == lones[starts]]
    cover = np.bincount(starts, minlength=n + 1) - np.bincount(starts + window, minlength=n + 1)
    at = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
    new = np.flatnonzero((np.diff(at, prepend=-2) > 1) | (np.diff(doc[at], prepend=-1) != 0))
    distinct, inverse = np.unique(token[at], return_inverse=True)
    rows = doc[at[new]]
    state = inverse, name[distinct], np.append(new, len(at)), rows, ids[rows], buckets
    return messages([("state", 1, number, -1, 0, freeze(*state)), ("place", 1, number, -1, 0, freeze(at[new])), *Open.started(window, *state).asks(1, number)])


def _answer_pairs(bucket: int, asked: list, buckets: int, level: int) -> list[tuple]:
    """The name of each run or pair, 0 for those in one document only."""
    x, y, run, several = (np.concatenate(v) for v in zip(*(parts for *_, parts in asked)))
    order = np.lexsort((run, y, x))
    new = np.concatenate([[True], (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0) | (np.diff(run[order]) != 0)])
    which = np.empty(len(x), np.int64)
    which[order] = np.cumsum(new) - 1
    name = np.where(np.bincount(which, 1 + several) < 2, 0, _name(np.arange(int(new.sum())), bucket, buckets, level))[which]
    edges = np.cumsum([0] + [n for _, _, n, _ in asked])
    return [("answer", level, c, bucket, n, freeze(name[s:e])) for (c, _, n, _), s, e in zip(asked, edges[:-1], edges[1:])]


def _ask_stretches(number: int, table: pa.Table, window: int, rounds: int, buckets: int) -> pa.Table:
    """The distinct stretches around shared symbols, with the least document that has each, and where they are."""
    c = Open(table, window, rounds + 1)
    key, first, last = c.stretches()
    size, owner, word = last - first + window, c.ids[c.stretch[first]], c.word
    # equal stretches are sent once; a hash proposes them, their words decide
    h = mix(key * U(BASE) + size.astype(U))
    for i in range(int(size.max(initial=0))):
        h = np.where(i < size, mix(h * U(BASE) + word[np.minimum(first + i, len(word) - 1)].astype(U)), h)
    order = np.lexsort((owner, h))
    equal = np.zeros(len(order), bool)
    p, q = order[1:], order[:-1]
    equal[1:] = (key[p] == key[q]) & (h[p] == h[q]) & (size[p] == size[q])
    check = np.flatnonzero(equal)
    p, q = order[check], order[check - 1]
    owners = np.repeat(np.arange(len(check)), size[p])
    differs = word[ramp(first[p], size[p])] != word[ramp(first[q], size[q])]
    equal[check[np.unique(owners[differs])]] = False
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(~equal) - 1
    one = order[~equal]
    bucket = (key[one] % U(buckets)).astype(np.int64)
    to, edges = dealt(bucket, buckets)
    place = np.empty(len(one), np.int64)
    place[to] = np.arange(len(one))
    one = one[to]
    ((_, _, _, (start,)),) = received(table, "place", 1)
    # places in the chunk's words
    here, first = first, first + (start - c.offsets[:-1])[c.stretch[first]]
    rows = [("state", 2, number, -1, 0, freeze(first, place[kind], size[one] - window + 1, owner[one]))]
    for b, s in slices(edges):
        own = one[s]
        rows.append(("ask", rounds + 1, number, b, len(own), freeze(size[own], word[ramp(here[own], size[own])], owner[own])))
    return messages(rows)


def same_windows(word: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """A number for each window start, equal for windows of equal words. Hashes sort them, words decide."""
    h = np.zeros(len(starts), U)
    for i in range(window):
        h = mix(h * U(BASE) + word[starts + i].astype(U))
    order = np.argsort(h, kind="stable")
    p, q = starts[order[1:]], starts[order[:-1]]
    new = np.ones(len(order), bool)
    differs = np.zeros(max(0, len(order) - 1), bool)
    for i in range(window):
        differs |= word[p + i] != word[q + i]
    new[1:] = differs
    if (new[1:] & (h[order[1:]] == h[order[:-1]])).any():  # hashes that clash: sort by the words themselves
        order = np.lexsort([word[starts + i] for i in reversed(range(window))])
        p, q = starts[order[1:]], starts[order[:-1]]
        new[1:] = np.any([word[p + i] != word[q + i] for i in range(window)], axis=0)
    out = np.empty(len(starts), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def _answer_stretches(bucket: int, asked: list, window: int, level: int) -> list[tuple]:
    """For each window of each stretch whether a document smaller than the stretch's own least has it."""
    size, word, owner = (np.concatenate(v) for v in zip(*(parts for *_, parts in asked)))
    windows = size - window + 1
    starts = ramp(np.cumsum(size) - size, windows)
    kind = same_windows(word, starts, window)
    owners = np.repeat(owner, windows)
    least = np.full(int(kind.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, kind, owners)
    smaller = least[kind] < owners
    edges = np.concatenate([[0], np.cumsum(windows)])[np.cumsum([0] + [n for _, _, n, _ in asked])]
    return [("answer", level, c, bucket, n, freeze(np.packbits(smaller[s:e]).tobytes(), int(e - s))) for (c, _, n, _), s, e in zip(asked, edges[:-1], edges[1:])]


def _clean(table: pa.Table, window: int, rounds: int, carry: list[str] | None) -> pa.Table:
    ((_, _, _, (token, offsets, ids, _)),), ((_, _, _, (lengths, data, own)),) = received(table, "state"), received(table, "own")
    ((_, _, _, (first, kind, windows, least)),) = received(table, "state", 2)
    told = [np.unpackbits(np.frombuffer(x, np.uint8), count=n) for *_, (x, n) in received(table, "answer", rounds + 1)]
    smaller = np.concatenate(told).astype(bool) if told else np.zeros(0, bool)
    if len(smaller) != windows.sum():
        raise RuntimeError("a chunk's answers don't fit its keys")
    doc = np.repeat(np.arange(len(ids)), np.diff(offsets))
    count = windows[kind]
    gone = ramp(first, count)
    gone = gone[smaller[ramp((np.cumsum(windows) - windows)[kind], count)] | np.repeat(ids[doc[first]] > least[kind], count)]
    cover = np.bincount(gone, minlength=len(token) + 1) - np.bincount(gone + window, minlength=len(token) + 1)
    kept = np.cumsum(cover)[:-1] == 0
    edges = np.concatenate([[0], np.cumsum(kept)])[offsets]
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), words_of(lengths, data).take(pa.array(token[kept]))), b" ")
    n_words = np.diff(offsets)
    own = pa.ipc.open_stream(own).read_all().combine_chunks()
    columns = {"doc_id": own.column("doc_id"), "n_words": pa.array(n_words), "n_removed": pa.array(n_words - np.diff(edges)), "kept_sha256": pa.array([hashlib.sha256(t.as_py()).hexdigest() for t in texts])}
    columns |= {"kept": texts.view(pa.string())} if carry is not None else {}
    columns |= {f"carried_{i}": own.column(f"carried_{i}") for i in range(len(carry or []))}
    return pa.table(columns)


def remove_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, chunk_bytes: int = CHUNK_BYTES, carry: list[str] | None = None) -> DataFrame:
    """Remove each word that lies in a window of words which also starts in a document with a smaller doc_id.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged and of any length. `docs(doc_id, text)` gives one row a row: (doc_id, n_words,
    n_removed, kept_sha256 of the kept words joined by one space). With a list `carry` there is also `kept`, that text, and
    behind it the columns named, as carried_0, carried_1 and so on. Windows are judged on the input. Null and empty texts
    have no words; texts shorter than a window keep all; rows with equal ids don't remove from each other; rows with a null
    id keep all words and remove nothing elsewhere; an empty table gives an empty result. Other columns are ignored. A
    task holds a chunk of about `chunk_bytes` of text, or one longer text.
    """
    scratch, names = Scratch(docs.sparkSession, "substring"), [f"carried_{i}" for i in range(len(carry or []))]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(f"`{c}`").alias(n) for c, n in zip(carry or [], names)])
    buckets = sizes(docs)
    state = save(scratch, by_chunk(docs, lambda number, rows: _begin(number, rows, buckets, names), chunk_bytes), "words")
    told = save(scratch, answered(state, lambda b, asked: _answer_words(b, asked, buckets)), "answers0")
    scratch.drop("words/role=ask")
    release(docs.sparkSession)
    opened = save(scratch, rejoined([state.where("role = 'state'"), told], lambda number, table: _open(number, table, window, buckets), MESSAGE), "open")
    scratch.drop("answers0")
    release(docs.sparkSession)
    tables = [opened]
    for level in range(1, rounds + 1):

        def ask(number, table, level=level):
            return messages(Open(table, window, level).asks(level, number))

        def answer(bucket, asked, level=level):
            return _answer_pairs(bucket, asked, buckets, level)

        tables.append(save(scratch, answered(rejoined(tables, ask, MESSAGE) if level > 1 else opened, answer, level=level), f"answers{level}"))
        scratch.drop("open/role=ask")
        release(docs.sparkSession)
    stretches = save(scratch, rejoined(tables, lambda number, table: _ask_stretches(number, table, window, rounds, buckets), MESSAGE), "stretches")
    scratch.drop("open", *[f"answers{i}" for i in range(1, rounds + 1)])
    release(docs.sparkSession)
    last = save(scratch, answered(stretches, lambda b, got: _answer_stretches(b, got, window, rounds + 1), level=rounds + 1), "last")
    scratch.drop("stretches/role=ask")
    release(docs.sparkSession)
    types = [f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names]
    schema = ", ".join(["doc_id long", "n_words long", "n_removed long", "kept_sha256 string", *["kept string"] * (carry is not None), *types])
    return rejoined([state, stretches, last], lambda number, table: _clean(table, window, rounds, carry), schema)
