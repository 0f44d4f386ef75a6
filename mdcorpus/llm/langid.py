"""Language identification, words first: a known word scores by its log frequency in each language; an unseen word
falls back to its character n-grams, from five characters down to one, at the first length that is known.

Every count of the training documents is used and no task holds the model. Chunks of documents send their distinct words,
with their counts by language, to the buckets that own them; the buckets send the n-grams of their distinct words, counted
as often as the words are, to the buckets that own those, and ask for the n-grams of unseen words. So a word's
score in each language is worked out once for the whole corpus, and goes back to the chunks that have the word.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_mod, release
from .exchange import CHUNK_BYTES, MESSAGE, answered, by_chunk, bytes_of, dealt, dealt_words, freeze, messages, numbered_words, ramp, received, rejoined, save, sizes, slices, words_of
from .textvec import BASE, U, mix

LONGEST = 5
KINDS = LONGEST + 1
SMOOTH = 0.5
PARTS, HELD_OUT = 4, 2


@functools.cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def letter_words(texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """As `numbered_words`, for runs of letters, lower-cased."""
    lowered = [(t or "").lower() for t in texts]
    chars = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), "<u4").copy()
    chars[~letters()[chars]] = 0x20
    chars[np.cumsum([len(t) + 1 for t in lowered], dtype=np.int64) - 1] = 0x0A
    return numbered_words(pa.array(chars.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace").split(b"\n")[:-1], pa.binary()).view(pa.string()))


def _begin(number: int, rows: pa.Table, buckets: int, languages: int) -> list[tuple]:
    """The words of the chunk's documents; and its distinct words with how often each language's training documents have them."""
    words, token, offsets = letter_words(rows.column("text").to_pylist())
    order, edges = dealt_words(words, buckets)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    token, words = place[token], words.take(pa.array(order))
    language = np.repeat(rows.column("number").to_numpy(), np.diff(offsets)).astype(np.int64)
    train = language >= 0
    pair, count = np.unique(token[train] * languages + language[train], return_counts=True)
    tells, starts = np.bincount(pair // languages, minlength=len(words)), np.searchsorted(pair, edges * languages)
    ids = rows.column("doc_id")
    asks = []
    for b, s in slices(edges):
        own = slice(starts[b], starts[b + 1])
        asks.append(("ask", 0, number, b, s.stop - s.start, freeze(*bytes_of(words[s.start : s.stop]), tells[s], pair[own] % languages, count[own])))
    # each document's distinct words, and how often it has them
    doc = np.repeat(np.arange(len(ids)), np.diff(offsets))
    code, times = np.unique(doc * max(1, len(words)) + token, return_counts=True)
    return [("state", 0, number, -1, 0, freeze(np.diff(code, prepend=0), times, max(1, len(words)), ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy())), *asks]


def ngrams(words: pa.Array):
    """(n, word, key) of the n-grams of each length, longest last: the number of the word that each is in, and a hash of its characters."""
    lengths = pc.utf8_length(words.view(pa.string())).to_numpy().astype(np.int64)
    chars = np.frombuffer(bytes_of(words)[1].decode("utf-8").encode("utf-32-le"), "<u4").astype(U)
    word = np.repeat(np.arange(len(lengths)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(chars))  # characters from here to the word's end
    key, at = np.zeros(len(chars), U), np.arange(len(chars))
    for n in range(1, LONGEST + 1):
        fits = left[at] >= n
        at, key = at[fits], key[fits]
        key = mix(key * U(BASE) + chars[at + n - 1] + U(n << 32))
        yield n, word[at], key


def _summed(key: np.ndarray, code: np.ndarray, count: np.ndarray, codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, code), by both, and the sum of each one's counts."""
    distinct, inverse = np.unique(key, return_inverse=True)
    pair, which = np.unique(inverse * codes + code, return_inverse=True)
    return distinct[pair // codes], pair % codes, np.bincount(which, count, len(pair)).astype(np.int64)


def _wanted(words: pa.Array, unseen: np.ndarray, buckets: int):
    """(distinct keys of the unseen words' n-grams by bucket, edges of the buckets, [(n, unseen word, place of the key)])."""
    own = [(n, word, key) for n, word, key in ngrams(words.take(pa.array(unseen)))]
    keys, which = np.unique(np.concatenate([key for *_, key in own]), return_inverse=True)
    order, edges = dealt((keys % U(buckets)).astype(np.int64), buckets)
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    ends = np.cumsum([len(word) for _, word, _ in own])
    return keys[order], edges, [(n, word, place[which[e - len(word) : e]]) for (n, word, _), e in zip(own, ends)]


def _count_words(bucket: int, asked: list, buckets: int, languages: int) -> list[tuple]:
    """The bucket's words with their counts by language, who asks for them, and its messages about n-grams."""
    coded = pa.concat_arrays([words_of(*parts[:2]) for *_, parts in asked]).dictionary_encode()
    own, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    tells, language, count = (np.concatenate([parts[k] for *_, parts in asked]) for k in (2, 3, 4))
    word, language, count = _summed(np.repeat(own, tells), language, count, languages)
    edges = np.cumsum([0] + [n for _, _, n, _ in asked])
    rows = [("words", 0, bucket, -1, len(words), freeze(*bytes_of(words), word, language, count))]
    rows += [("map", 0, bucket, -1, c, freeze(own[s:e])) for (c, *_), s, e in zip(asked, edges[:-1], edges[1:])]
    rows += [("stats", i, -1, bucket, int(n), None) for i, n in enumerate(np.bincount(language, count, languages))]
    rows += [("stats", KINDS * languages, -1, bucket, len(np.unique(word)), None)]
    told = [(np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    first, size = np.searchsorted(word, np.arange(len(words))), np.bincount(word, minlength=len(words))
    for n, of, key in ngrams(words):
        # an n-gram counts as often as its word does
        at = ramp(first[of], size[of])
        key, code, many = _summed(np.repeat(key, size[of]), language[at], count[at], languages)
        told.append((key, code + n * languages, many))
    key, code, many = (np.concatenate(x) for x in zip(*told))
    order, edges = dealt((key % U(buckets)).astype(np.int64), buckets)
    wanted, borders, _ = _wanted(words, np.flatnonzero(size == 0), buckets)
    for b in range(buckets):
        s, w = order[edges[b] : edges[b + 1]], wanted[borders[b] : borders[b + 1]]
        if len(s) or len(w):
            rows.append(("ask", 1, bucket, b, len(w), freeze(key[s], code[s], many[s], w)))
    return rows


def _count_ngrams(bucket: int, asked: list, languages: int) -> list[tuple]:
    """For each wanted n-gram its counts by language; and how often each language has n-grams of each length, and how many are distinct."""
    key, code, many = (np.concatenate([parts[k] for *_, parts in asked]) for k in (0, 1, 2))
    key, code, many = _summed(key.view(U), code, many, KINDS * languages)
    rows = [("stats", i, -1, bucket, int(n), None) for i, n in enumerate(np.bincount(code, many, KINDS * languages)) if n]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    distinct, first = key[new], np.append(new, len(key))
    rows += [("stats", KINDS * languages + k, -1, bucket, int(n), None) for k, n in enumerate(np.bincount(code[new] // languages, minlength=KINDS)) if n]
    for c, _, n, parts in asked:
        want = parts[3].view(U)
        at = np.minimum(np.searchsorted(distinct, want), max(0, len(distinct) - 1))
        known = distinct[at] == want if len(distinct) else np.zeros(len(want), bool)
        tells = np.where(known, np.diff(first)[at], 0) if len(distinct) else np.zeros(len(want), np.int64)
        own = ramp(first[at[known]], tells[known])
        rows.append(("answer", 1, c, bucket, n, freeze(tells, code[own] % languages, many[own])))
    return rows


def _logs(n: np.ndarray, totals: np.ndarray, found: float) -> np.ndarray:
    return np.log((n + SMOOTH) / (totals + SMOOTH * (found + 1)))


def _value(number: int, table: pa.Table, buckets: int, languages: int, totals: np.ndarray, found: np.ndarray) -> pa.Table:
    """The log score in each language of each of a bucket's words, to the chunks that have it. totals (kind, language), found (kind)."""
    ((_, _, many, (lengths, data, word, language, count)),) = received(table, "words")
    words, n = words_of(lengths, data), np.zeros((many, languages))
    n[word, language] = count
    value = _logs(n, totals[0], found[0])
    unseen = np.flatnonzero(np.bincount(word, minlength=many) == 0)
    _, _, own = _wanted(words, unseen, buckets)
    told = [parts for *_, parts in received(table, "answer", 1)]
    if told:
        tells, language, count = (np.concatenate(x) for x in zip(*told))
        n = np.zeros((len(tells), languages))
        n[np.repeat(np.arange(len(tells)), tells), language] = count
        left, stand = np.ones(len(unseen), bool), np.zeros((len(unseen), languages))
        for k, of, at in reversed(own):
            use = left[of] & (tells[at] > 0)
            of, at = of[use], at[use]
            hits = np.bincount(of, minlength=len(unseen))
            logs = _logs(n[at], totals[k], found[k])
            for i in range(languages):
                stand[:, i] += np.bincount(of, logs[:, i], len(unseen)) / np.maximum(hits, 1)
            left[of] = False
        value[unseen] = stand
    value = value.astype(np.float32)
    rows = []
    for _, _, chunk, (asks,) in received(table, "map"):
        rows.append(("answer", 0, chunk, number, len(asks), freeze(np.ascontiguousarray(value[asks].T).view(np.uint32).ravel())))
    return messages(rows)


def _score(table: pa.Table, languages: list[str], live: np.ndarray) -> pa.Table:
    ((_, _, _, (steps, times, many, ids, known)),) = received(table, "state")
    told = [parts[0].astype(np.uint32).view(np.float32).reshape(len(languages), n) for _, _, n, parts in received(table, "answer")]
    value = np.concatenate(told, axis=1).astype(np.float64) if told else np.zeros((len(languages), 0))
    doc, word = np.divmod(np.cumsum(steps), many)
    some = np.bincount(doc, minlength=len(ids)) > 0
    names, score = np.full(len(ids), "und", object), np.zeros(len(ids))
    if len(live):
        sums = np.column_stack([np.bincount(doc, value[i][word] * times, len(ids)) for i in live])
        names = np.where(some, np.array(languages, object)[live[sums.argmax(axis=1)]], "und")
        score = np.where(some, 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1), 0.0)
    return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=known == 0), "lang_pred": pa.array(names.tolist(), pa.string()), "score": score})


def identify(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of `docs(doc_id, text, lang)`, from whole texts.

    Learned from rows with a language whose crc32(doc_id) mod 4 is not 2. Texts that are null or without a letter, and
    all texts where nothing could be learned, are `und` with score 0. Ties go to the language first by code point.
    Rows with null or repeated ids are rows of their own; other columns are ignored; an empty table gives an empty result.
    A task holds a chunk of about `chunk_bytes` of text, or one longer text, and a number for each of its distinct words
    and each language.
    """
    scratch = Scratch(docs.sparkSession, "langid")
    train = F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", PARTS) != HELD_OUT)
    languages = sorted((r["lang"] for r in docs.where(train).select("lang").distinct().collect()), key=lambda x: x.encode("utf-8", "surrogatepass"))
    held_out = (crc_mod("doc_id", PARTS) == HELD_OUT).alias("held_out")
    number = F.coalesce(F.when(train, F.array_position(F.array(*map(F.lit, languages)), F.col("lang")) - 1), F.lit(-1)) if languages else F.lit(-1)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", number.cast("int").alias("number"))
    if not languages:
        return docs.select("doc_id", held_out, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    buckets, many = sizes(docs), len(languages)
    words = save(scratch, by_chunk(docs, lambda number, rows: _begin(number, rows, buckets, many), chunk_bytes), "words")
    counted = save(scratch, answered(words, lambda b, asked: _count_words(b, asked, buckets, many)), "counted")
    scratch.drop("words/role=ask")
    release(docs.sparkSession)
    grams = save(scratch, answered(counted, lambda b, asked: _count_ngrams(b, asked, many), level=1), "grams")
    scratch.drop("counted/role=ask")
    release(docs.sparkSession)
    stats = np.zeros(KINDS * many + KINDS)
    for r in counted.unionByName(grams).where("role = 'stats'").groupBy("level").agg(F.sum("n").alias("n")).collect():
        stats[r["level"]] = r["n"]
    totals, found = stats[: KINDS * many].reshape(KINDS, many), stats[KINDS * many :]
    own = [counted.where("role IN ('words', 'map')"), grams.where("role = 'answer'")]
    values = save(scratch, rejoined(own, lambda number, table: _value(number, table, buckets, many, totals, found), MESSAGE), "values")
    scratch.drop("counted", "grams")
    release(docs.sparkSession)
    live = np.flatnonzero(totals[0] > 0)
    scored = rejoined([words, values], lambda number, table: _score(table, languages, live), "doc_id long, lang_pred string, score double")
    return scored.select("doc_id", held_out, "lang_pred", "score")
