"""The operators against brute force on small tables, with nulls, empty and repeated rows and clashing column names."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, chunk string, kind string"


@pytest.fixture(scope="module")
def docs(spark):
    own = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(120).collect()]
    odd = [(9001, None, None, None), (9002, "", "en", "b"), (9003, "  \t\n ", "en", None), (None, own[0][1], "fr", "a"), (9004, "word", "en", "a"), (9004, "word", "en", "a"), (9005, "x " * 3000, "de", "c"), (9006, "123 456 !!", "en", "c"), (9007, own[3][1] + " tail words", "en", "a")]
    return spark.createDataFrame([(*r, 1, "s", "c", "k") for r in own + odd], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def thue_morse(n):
    """Two different words of n letters that polynomial hashes modulo 2**64 don't tell apart."""
    return ["".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n)) for flip in (0, 1)]


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_components(spark):
    from mdcorpus.llm.components import connected_components

    edges = [(i, i + 1) for i in range(1, 40)] + [(50, 52), (52, 51), (60, 60), (None, 3), (50, 52)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 51: 50, 52: 50}


def without_repeats(rows, window=13):
    """(doc_id, words, words removed, digest of the words kept), by looking at every window."""
    first, want = {}, []
    for d, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1) if d is not None else ():
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, d), d)
    for d, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1) if d is not None else ():
            if first[tuple(w[k : k + window])] < d:
                gone[k : k + window] = [True] * window
        want.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(want, key=repr)


def test_substring(docs, empty):
    from mdcorpus.llm.substring import remove_repeats

    want = without_repeats(rows_of(docs))
    assert sorted(map(tuple, remove_repeats(docs).collect()), key=repr) == want and sum(r[2] for r in want) > 0
    assert remove_repeats(empty).count() == 0


def test_substring_long_words_and_few_words(spark):
    """Words that weak hashes take for one another, a word of 1 MB, and texts of so few different words that runs and pairs abound."""
    from mdcorpus.llm.substring import remove_repeats

    rng = np.random.default_rng(5)
    twelve = " ".join(f"w{i}" for i in range(12))
    rows = [(i, f"{twelve} {w}") for i, w in enumerate(x for n in (1024, 2048) for x in thue_morse(n))]
    rows += [(10 + i, f"{twelve} {'q' * 1_000_000}{c}") for i, c in enumerate("aab")]
    rows += [(100 + i, " ".join(rng.choice(list("abc"), int(rng.integers(1, 120)), p=[0.7, 0.2, 0.1]))) for i in range(150)]
    rows += [(300 + i, "x " * int(rng.integers(1, 60)) + "y " * int(rng.integers(0, 40))) for i in range(30)] + [(-5, "x " * 40), (None, "x " * 50), (301, "x " * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = without_repeats(rows)
    assert [r[2] for r in want if r[0] in (0, 1, 2, 3, 10, 11, 12)].count(0) == 6
    for size in (4 << 20, 2000):
        assert sorted(map(tuple, remove_repeats(df, chunk_bytes=size).collect()), key=repr) == want


def test_windows_are_told_apart_by_their_words(monkeypatch):
    """Where all hashes clash, windows are still equal only if their words are."""
    from mdcorpus.llm import substring as S

    monkeypatch.setattr(S, "mix", lambda x: x * np.uint64(0))
    word = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3, 9, 1, 2])
    got = S.same_windows(word, np.arange(11), 2)
    pairs = [tuple(word[i : i + 2]) for i in range(11)]
    assert all((got[i] == got[j]) == (pairs[i] == pairs[j]) for i in range(11) for j in range(11))


def test_freeze():
    from mdcorpus.llm.exchange import freeze, thaw

    parts = np.array([0, 5, 300, 2**40]), np.array([-1, 2]), b"x y", np.zeros(0, np.int64), 7, np.array([True, False]), None
    for a, b in zip(thaw(freeze(*parts)), parts):
        assert a == b if not isinstance(b, np.ndarray) else (a == b).all() and len(a) == len(b)


def test_simhash(docs, empty):
    from xxhash import xxh64_intdigest

    from mdcorpus.llm.simhash import near_duplicates

    rows, fps = rows_of(docs), []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxh64_intdigest(s, 42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    label = list(range(len(rows)))
    for _ in rows:
        new = [min(label[j] for j in range(len(rows)) if bin(fps[i] ^ fps[j]).count("1") <= 3) for i in range(len(rows))]
        if new == label:
            break
        label = new
    least = {}
    for (d, _), x in zip(rows, label):
        if d is not None:
            least[x] = min(least.get(x, d), d)
    want = [(d, f"{f:016x}", least.get(x)) for (d, _), f, x in zip(rows, fps, label)]
    assert sorted(map(tuple, near_duplicates(docs).collect()), key=repr) == sorted(want, key=repr)
    assert near_duplicates(empty).count() == 0


def test_simhash_links_up_to_three_bits(spark, monkeypatch):
    from mdcorpus.llm import simhash

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(i) for i in rng.choice(64, k, replace=False))) for b in base for k in (1, 2, 3, 4)]
    fps = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    close = {(a, b) for a in range(len(fps)) for b in range(a) if bin(int(fps[a]) ^ int(fps[b])).count("1") <= 3}
    got = simhash.links(df).collect()
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    pairs = {(max(at[r.a], at[r.b]), min(at[r.a], at[r.b])) for r in got}
    assert close and pairs
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for edges in (pairs, close):
        for a, b in edges:
            x, y = find(a), find(b)
            assert edges is pairs or x == y
            parent[max(x, y)] = min(x, y)
    # the way for large buckets gives the same forest
    own = np.sort(np.unique(np.concatenate([base[:1] ^ np.uint64(i) for i in range(9)])))
    small = simhash._forest(own, np.uint64(1), True, list(range(33)), 3)
    monkeypatch.setattr(simhash, "ENUMERATE_ABOVE", 1)
    assert (small == simhash._forest(own, np.uint64(1), True, list(range(33)), 3)).all()


def test_vectors(spark):
    from mdcorpus.llm.vectors import near_vectors

    rng = np.random.default_rng(0)
    base = rng.standard_normal((40, 16))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([base, base + 0.05 * rng.standard_normal((40, 16)), base[:5]]))]
    rows += [(900, None), (901, [0.0] * 16), (902, [None] * 16), (903, [float("nan")] * 16), (904, [1.0]), (905, []), (None, rows[0][1])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    good = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: [j for b, (j, y) in enumerate(good) if a != b and x @ y >= 0.9] for a, (i, x) in enumerate(good) if i is not None}
    assert {i: got[i][0] for i in links} == {i: len(x) for i, x in links.items()}
    assert all(got[40 + i][1] == i and not got[40 + i][2] for i in range(40))
    assert all(got[i] == (0, i, True) for i in (900, 901, 902, 903, 904, 905))
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    # more vectors take more projections, at the same recall
    from mdcorpus.llm import vectors

    assert [vectors.hashing(n)[1] for n in (0, 10**4, 10**8)] == sorted({vectors.hashing(n)[1] for n in (0, 10**4, 10**8)})
    for n in (10, 10**6, 10**9):
        tables, projections = vectors.hashing(n)
        for cosine, recall in ((0.9, 0.95), (0.92, 0.985), (0.95, 0.9995), (0.98, 1 - 1e-8)):
            assert 1 - (1 - vectors.collision(np.sqrt(2 - 2 * cosine), vectors.WIDTH) ** projections) ** tables >= recall
    # large buckets in slices give the same
    tight = [(i, [float(x) for x in base[0] + 0.1 * rng.standard_normal(16)]) for i in range(1000, 1060)]
    more = spark.createDataFrame(rows + tight, "vec_id long, embedding array<double>")
    whole, cut_up = (sorted(map(tuple, near_vectors(more, slice_rows=n).collect()), key=repr) for n in (10_000, 7))
    assert whole == cut_up and max(r[1] for r in whole) > 50


def found_leaks(rows, items):
    """(doc_id, item_id, passage, score, question, answer), by BM25 of every passage against every item, in plain Python."""
    import re
    from collections import Counter
    from math import log

    split = lambda t: re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").lower().encode())
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    def question_and_answer(text):
        w, head = split(text), re.match(r"(?s)(.*[.!?])\s+\S", text.rstrip())
        n = len(split(head[1])) if head else 0
        n = n if 0 < n < len(w) else len(w) - max(1, len(w) // 4) if len(w) > 1 else 0
        return w[:n], w[n:]

    def overlap(part, words):
        own = grams(part, min(5, len(part))) if part else set()
        return sum(g in grams(words, min(5, len(part))) for g in own) / len(own) if own else 1.0

    parts = []
    for item, text in sorted({(i, t) for i, t in items if i is not None and t is not None}):
        w = split(text)
        k = max(1, -(-len(w) // 64))
        sizes = [len(w) // k + (i < len(w) % k) for i in range(k)]
        at = 0
        for n in sizes:
            if n:
                parts.append((item, text, Counter(w[at : at + n]), n))
            at += n
    df, mean = Counter(t for *_, c, _ in parts for t in c), sum(n for *_, n in parts) / max(1, len(parts))
    weigh = lambda c, n: {t: log(1 + (len(parts) - df[t] + 0.5) / (df[t] + 0.5)) * k * 2.2 / (k + 1.2 * (0.25 + 0.75 * n / mean)) for t, k in c.items()}
    weighed = [(item, weigh(c, n)) for item, _, c, n in parts]
    out = []
    for d, t in rows:
        w, best = split(t), {}
        for at in range(0, len(w), 64):
            own = set(w[at : at + 128])
            for item, c in weighed:
                score = sum(x for term, x in c.items() if term in own) / sum(c.values())
                if score >= 0.6 - 1e-9:
                    best.setdefault(item, set()).add((-round(score, 9), at))
        for item, places in best.items():
            for score, at, text in ((*p, x) for p in sorted(places) for x in sorted(x for i, x in items if i == item and x is not None)):
                n = len(split(text))
                near = w[max(0, at - n) : at + 128 + n]
                q, r = (overlap(p, near) for p in question_and_answer(text))
                if q >= 0.5 and r >= 0.5:
                    out.append((d, item, at, round(-score, 6), round(q, 6), round(r, 6)))
                    break
    return sorted(out, key=repr)


def test_vectors_of_any_size_and_clashing_columns(spark):
    from mdcorpus.llm.vectors import near_vectors

    v = [1.0, 2.0, -3.0, 0.5]
    rows = [(i, [x * f for x in v], 1, "t") for i, f in enumerate((1.0, 1e200, 1e-200, 1e300, 5e-300, -1.0))]
    got = {r.vec_id: r.n_links for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n long, id string")).collect()}
    assert got == {0: 4, 1: 4, 2: 4, 3: 4, 4: 4, 5: 0}


@pytest.mark.parametrize("cosine, least", [(0.905, 0.9), (0.92, 0.95), (0.95, 0.99), (0.99, 1.0)])
def test_vector_recall(spark, cosine, least):
    """Pairs planted at a cosine among vectors at about right angles, at the settings for that many."""
    from mdcorpus.llm.vectors import near_vectors

    rng = np.random.default_rng(8)
    a, b = (rng.standard_normal((400, 64)) for _ in range(2))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = cosine * a + np.sqrt(1 - cosine**2) * b
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, near]))]
    got = {r.vec_id: r.component_id for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert np.mean([got[400 + i] == i for i in range(400)]) >= least


def test_decontamination(spark, docs, empty):
    from mdcorpus.llm import decontaminate as D

    bench = [(b.item_id, b.text) for b in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    rng = np.random.default_rng(2)
    leaked = [(7000 + i, "Some words before it. " * 20 + t.upper() + " and some after.") for i, (_, t) in enumerate(bench[:6])]
    for i, (_, t) in enumerate(bench[6:30]):  # some of the words gone, others moved
        w = t.split()
        leaked.append((7100 + i, " ".join(["begin"] * int(rng.integers(0, 90)) + [x for x in w if rng.random() > i / 40] + ["end"] * 30)))
    leaked += [(None, leaked[0][1]), (7000, leaked[0][1]), (7200, " ".join(t for _, t in bench[:40]))]
    items = [*bench, (None, "x"), (5000, None), (5001, ""), (5002, "?!"), (bench[0][0], bench[1][1]), bench[2], (5003, " ".join(t for _, t in bench[50:60]))]
    rows = [r for r in rows_of(docs) if len(r[1] or "") < 3000][:60] + leaked
    want = found_leaks(rows, items)
    assert len(want) > 50 and any(r[0] is None for r in want)
    whole = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "doc_id long, text string, score double, item_id int").repartition(3)
    for size in (4 << 20, 3000):
        got = [(r.doc_id, r.item_id, r.passage, round(r.score, 6), round(r.question, 6), round(r.answer, 6)) for r in D.leaks(df, whole, shard_bytes=size).collect()]
        assert sorted(got, key=repr) == want
    assert D.leaks(empty, whole).count() == 0 and D.leaks(docs, whole.limit(0)).count() == 0 and D.leaks(docs, whole.where("item_id > 5000 AND item_id < 5003")).count() == 0


def test_wand_finds_what_scoring_everything_finds():
    import pandas as pd

    from mdcorpus.llm import decontaminate as D

    rng = np.random.default_rng(0)
    rows = [(i, 0, 0, int(t), float(rng.random() ** 3 + 0.01)) for i in range(300) for t in np.unique(rng.integers(0, 60, int(rng.integers(1, 25))) ** 2)]
    index = D.Index(pd.DataFrame(rows, columns=["item_id", "text_id", "part", "term", "weight"]), pd.DataFrame({"item_id": [], "text": []}))
    passage, term = np.divmod(np.unique(rng.integers(0, 200, 1600) * len(index.terms) + rng.integers(0, len(index.terms), 1600)), len(index.terms))
    dense = np.zeros((len(index.terms), 300))
    owner = np.repeat(np.arange(len(index.terms)), np.diff(index.posting[index.first]))
    dense[owner, index.part] = index.share
    want = {(p, i) for p in range(200) for i in np.flatnonzero(dense[term[passage == p]].sum(axis=0) >= D.THRESHOLD)}
    which, part, _ = index.retrieve(passage, term)
    looked_at = len(index.candidates(passage, term)[0])
    assert want and set(zip(which.tolist(), part.tolist())) == want and looked_at < 0.7 * 200 * index.n_blocks


def test_mixing(spark, docs, empty):
    from mdcorpus.llm.mix import mix_sources, sainte_lague

    votes, k = np.array([5.3, 2.1, 9.7, 0.0, 1.1]), np.zeros(5, int)
    for _ in range(57):
        i = int(np.argmax(votes / (2 * k + 1)))
        k[i] += 1
    assert (sainte_lague(votes, 57) == k).all()
    got = mix_sources(docs).collect()
    assert len(got) == docs.count() and sorted(map(tuple, got), key=repr) == sorted(map(tuple, mix_sources(docs.repartition(7)).collect()), key=repr)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    source = {(r.source, r.text): 0 for r in docs.collect()}
    assert source
    total = sum(r.size for r in got)
    by = {}
    for r in got:
        by.setdefault((r.source_size, r.target), 0)
        by[(r.source_size, r.target)] += r.taken
    assert sum(t for _, t in by) <= 1.5 * total + 1e-6
    for (size, target), taken in by.items():
        assert target <= 2 * size + 1e-9 and abs(taken - target) <= max(4, 0.03 * target)
    assert mix_sources(empty).count() == 0


def mixed(rows):
    """(doc_id, size, source_size, target, taken) of rows (doc_id, source, words, place), one shard a source, in plain Python."""
    from fractions import Fraction

    sizes = {}
    for _, source, n, _ in rows:
        sizes[source] = sizes.get(source, 0) + n
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight, left, target = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, Fraction(3, 2) * sum(sizes.values()), {}
    open_ = [s for s in names if sizes[s]]
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total >= 2 * sizes[s]]
        for s in full or open_:
            target[s] = Fraction(2 * sizes[s]) if full else left * weight[s] / total
        if not full:
            break
        left -= sum(target[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    block = 256
    while block > 1 and min(target.values()) / block < 128:
        block //= 2
    seats = dict.fromkeys(names, 0)
    for _ in range(round(float(sum(target.values())) / block)):
        seats[max(target, key=lambda s: (target[s] / (2 * seats[s] + 1), -names.index(s)))] += 1
    out = []
    for number, s in enumerate(names):
        own = sorted((place, d, n) for d, source, n, place in rows if source == s and n)
        words = [(d, i) for i, (_, d, n) in enumerate(own) for _ in range(n)]
        blocks = -(-len(words) // block)
        times = [min(seats[s], 2 * blocks) // blocks] * blocks if blocks else []
        for b in np.random.default_rng([42, number, 0]).permutation(blocks)[: min(seats[s], 2 * blocks) % blocks if blocks else 0]:
            times[b] += 1
        taken = [0] * len(own)
        for k, (_, i) in enumerate(words):
            taken[i] += times[k // block]
        out += [(d, n, sizes[s], round(float(target[s]), 6), t) for (_, d, n), t in zip(own, taken)]
        out += [(d, 0, sizes[s], round(float(target.get(s, 0)), 6), 0) for d, source, n, _ in rows if source == s and not n]
    return sorted(out, key=repr)


def test_mixing_equals_plain_python(spark):
    from mdcorpus.llm.mix import mix_sources

    rng = np.random.default_rng(11)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 400))), [None, "a", "b", "é", "tiny", "zz"][int(rng.integers(0, 6))]) for i in range(150)]
    rows = [(i, t if s != "tiny" else "one two", s) for i, t, s in rows] + [(500, None, "none"), (501, "  ", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    places = {r.doc_id: r.place for r in df.select("doc_id", F.xxhash64(F.lit(42), "doc_id", F.xxhash64("text")).alias("place")).collect()}
    want = mixed([(i, s, len((t or "").split()), places[i]) for i, t, s in rows])
    assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mix_sources(df.repartition(4)).collect()), key=repr) == want


def test_mixing_of_equal_rows(spark):
    from mdcorpus.llm.mix import mix_sources

    rows = [(None, "same words here", "a")] * 300 + [(None, None, None)] * 50 + [(i, "other words", "b") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [sorted(map(tuple, mix_sources(df.repartition(n)).collect()), key=repr) for n in (1, 5)]
    assert got[0] == got[1] and len(got[0]) == len(rows) and all(r[4] <= 2 * r[1] for r in got[0])


def test_lm(docs, empty):
    from mdcorpus.llm.lm import lm_scores

    rows = rows_of(docs)
    tokens = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    train = [zlib.crc32(str(d).encode() if d is not None else b"") % 10 != 0 for d, _ in rows]
    c = {}
    for ts, ok in zip(tokens, train):
        for t in ts if ok else ():
            c[t] = c.get(t, 0) + 1
    n, v = sum(c.values()), len(c)
    want = sorted((d, not ok, len(ts), sum(t in c for t in ts), n, round(sum(np.log10((c.get(t, 0) + 0.1) / (n + 0.1 * (v + 1))) for t in ts), 4)) for (d, _), ts, ok in zip(rows, tokens, train) if d is not None)
    scored = lm_scores(docs).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in scored if r.doc_id is not None) == want
    assert all(r.score < 0 for r in scored) and len(scored) == len(rows)
    held = [r for r in scored if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm_scores(empty).count() == 0


def test_mixture_weights():
    from mdcorpus.llm.lm import CONTEXTS, learn_weights

    # bigrams that tell everything in bucket 3, nothing in bucket 0
    w = learn_weights(np.array([3, 0]), np.array([1000.0, 1000.0]), np.array([0.5, 0.0]), np.array([0.001, 0.02]), 1000)
    assert w.shape == (CONTEXTS, 3) and w[3, 0] > 0.95 and w[0, 1] > 0.95 and np.allclose(w.sum(axis=1), 1)


def test_lm_scores_equal_counts_in_plain_python(spark, docs):
    """Every score against bigram counts, estimates and weights of the held-out counts, worked out token by token."""
    from math import frexp, log10

    from mdcorpus.llm import lm

    rows = [(d, t) for d, t in rows_of(docs)] + [(20_000 + i, w) for i, w in enumerate(thue_morse(2048))] + [(30_000, "x" * 1_000_000 + " y")]
    part = [zlib.crc32(str(d).encode() if d is not None else b"") % 10 for d, _ in rows]
    tokens = [[*(t or "").encode().lower().split(), b""] for _, t in rows]

    def count(use):
        one, two, context = {}, {}, {}
        for ts, p in zip(tokens, part):
            for x, y in zip([None, *ts], ts) if use(p) else ():
                one[y], two[x, y], context[x] = one.get(y, 0) + 1, two.get((x, y), 0) + 1, context.get(x, 0) + 1
        return one, two, context

    whole, kept = count(lambda p: p != 0), count(lambda p: p not in (0, 5))
    v = len(whole[0])

    def parts(model, x, y):
        one, two, context = model
        n = context.get(x, 0)
        return frexp(n)[1], two.get((x, y), 0) / max(n, 1), one.get(y, 0) / sum(one.values())

    held = [parts(kept, x, y) for ts, p in zip(tokens, part) if p == 5 for x, y in zip([None, *ts], ts)]
    bucket, f2, f1 = (np.array(x) for x in zip(*held))
    weights = lm.learn_weights(bucket, np.ones(len(held)), f2, f1, v)
    want = {}
    for (d, _), ts in zip(rows, tokens):
        total = 0.0
        for x, y in zip([None, *ts], ts):
            b, g2, g1 = parts(whole, x, y)
            total += log10(weights[b] @ [g2, g1, 1 / (v + 1)])
        want.setdefault(d, []).append(total)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for size in (4 << 20, 30_000):
        got = {}
        for r in lm.lm_scores(df, size).collect():
            got.setdefault(r.doc_id, []).append(r.score)
        assert set(got) == set(want)
        # cells share a mean estimate, which moves the weights a little
        bad = [(d, a, b) for d in want for a, b in zip(sorted(got[d]), sorted(want[d])) if abs(a - b) > 0.001 * abs(b)]
        assert not bad, bad[:5]


def test_language(spark, docs, empty):
    from mdcorpus.llm.langid import identify

    whole = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r for r in identify(whole).collect()}
    lang = {r.doc_id: r.lang for r in whole.collect()}
    held = [d for d, r in got.items() if r.held_out]
    assert held and np.mean([got[d].lang_pred == lang[d] for d in held]) > 0.95
    odd = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs).collect()}
    assert all(odd[d] == ("und", 0.0) for d in (9001, 9002, 9003, 9006)) and all(0 <= s <= 1 for _, s in odd.values())
    assert identify(empty).count() == 0 and {r.lang_pred for r in identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_counts_are_whole(spark):
    from collections import Counter
    from math import exp, log

    from mdcorpus.llm.langid import identify

    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2]
    seen = [i for i in range(100) if i not in held]
    # a word seen once among a quarter of a million
    rows = [(seen[0], "lorem " * 250_000, "aa"), (seen[1], "ipsum " * 250_000 + "qwxyz", "bb"), (held[0], "qwxyz", None), (held[1], "qwxyzj", None)]
    got = {r.doc_id: r.lang_pred for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[held[0]] == got[held[1]] == "bb"
    # every score against counts in plain Python
    rows = [(r.doc_id, r.text[:2000], r.lang) for r in spark.read.parquet(f"{DATA}/documents.parquet").where("lang IS NOT NULL AND text IS NOT NULL").orderBy("doc_id").limit(150).collect()]
    rows += [(held[2], "xqv zzyzx 1 \u4e00", None), (held[3], "...", "en")]
    words = lambda t: "".join(c if c.isalpha() else " " for c in t.lower()).split()
    grams = lambda w, k: [w] if k == 0 else [w[i : i + k] for i in range(len(w) - k + 1)]
    langs = sorted({x for i, _, x in rows if x and zlib.crc32(str(i).encode()) % 4 != 2})
    n = [{x: Counter() for x in langs} for _ in range(6)]
    for i, t, x in rows:
        if x and zlib.crc32(str(i).encode()) % 4 != 2:
            for k in range(6):
                n[k][x].update(g for w in words(t) for g in grams(w, k))
    found = [set().union(*k.values()) for k in n]
    total = [{x: sum(c.values()) for x, c in k.items()} for k in n]

    def value(w, x):
        for k in (0, 5, 4, 3, 2, 1):
            hits = [g for g in grams(w, k) if g in found[k]]
            if hits:
                return sum(log((n[k][x][g] + 0.5) / (total[k][x] + 0.5 * (len(found[k]) + 1))) for g in hits) / len(hits)
        return 0.0

    want = []
    for i, t, _ in rows:
        sums = [sum(value(w, x) for w in words(t)) for x in langs]
        want.append((i, langs[sums.index(max(sums))] if words(t) else "und", 1 / sum(exp(s - max(sums)) for s in sums) if words(t) else 0.0))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for size in (16 << 20, 400):
        got = sorted((r.doc_id, r.lang_pred, r.score) for r in identify(df.repartition(3), size).collect())
        assert [g[:2] for g in got] == [w[:2] for w in sorted(want)] and np.allclose([g[2] for g in got], [w[2] for w in sorted(want)], atol=1e-6)


def test_quality(spark, docs, empty):
    from mdcorpus.llm.quality import quality_scores

    data = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{data}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = quality_scores(spark.read.parquet(f"{data}/documents.parquet"), labels).collect()
    held = [r for r in got if r.held_out and truth.get(r.doc_id) is not None]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    scored = quality_scores(docs, labels).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)
    assert {r.score for r in quality_scores(docs, labels.limit(0)).collect()} == {0.5} and quality_scores(empty, labels).count() == 0


def test_quality_scores_are_sums_of_table_entries(spark):
    """A model's score against its tables, looked up by hand."""
    from bisect import bisect_right
    from math import exp

    from mdcorpus.llm import quality as Q

    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = Q.fit(docs, spark.read.parquet(f"{data}/labels.parquet"))
    assert model.pairs and all(np.isfinite(t).all() for t in [*model.tables, *model.pair_tables])
    texts = [(r.text or "").encode() for r in docs.orderBy("doc_id").limit(50).collect()] + [b"", b"x", "é ü | !!! 123".encode()]
    for row, score in zip(Q.features(texts), model.scores(Q.features(texts))):
        total = model.intercept + sum(t[bisect_right(e.tolist(), v)] for e, t, v in zip(model.edges, model.tables, row))
        for t, (i, j) in zip(model.pair_tables, model.pairs):
            total += t[bisect_right(model.coarse[i].tolist(), row[i]), bisect_right(model.coarse[j].tolist(), row[j])]
        assert abs(score - 1 / (1 + exp(-total))) < 1e-12
    # repeated documents don't change what is learned
    again = Q.fit(docs.union(docs.limit(300)).repartition(5), spark.read.parquet(f"{data}/labels.parquet"))
    assert all((a == b).all() for a, b in zip(model.tables, again.tables))


def test_first_by_hash(spark):
    from mdcorpus.llm.common import first_by_hash

    df = spark.range(20_000).select("id", F.xxhash64("id").alias("h"))
    want = [r.id for r in df.orderBy("h").limit(100).collect()]
    assert sorted(r.id for r in first_by_hash(df.union(df), 100).collect()) == sorted(want)
    assert first_by_hash(df.limit(30), 100).count() == 30 and first_by_hash(df.limit(0), 100).count() == 0


def test_warc(spark, tmp_path):
    from mdcorpus.llm.warc import MAGIC, RECORD_END, read_archives, round_trip

    long = "x" * 1200
    fake = f"a{MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3{RECORD_END}abc{RECORD_END}b"
    pages = [(1, long), (2, long), (3, "short"), (4, "short"), (5, None), (6, fake), (7, f"{MAGIC}{MAGIC}"), (8, "é\r\n\r\n"), (9, long + "y"), (None, long)]
    got = {r.page_id: tuple(r)[1:] for r in round_trip(spark.createDataFrame([(i, h, "u") for i, h in pages], "page_id long, html string, digest string").repartition(2)).collect()}
    for i, h in pages:
        data = (h or "").encode()
        kind, to = ("revisit", 2) if h == long and i != 2 else ("response", None)
        assert got[i] == (len(data), hashlib.sha1(data).hexdigest(), kind, to)
    assert len(got) == len(pages)
    assert round_trip(spark.createDataFrame([], "page_id long, html string")).count() == 0
    folder = tmp_path / "w"
    folder.mkdir()
    (folder / "a.txt").write_text(f"{MAGIC}Content-Length: 5{RECORD_END}hello{RECORD_END}{MAGIC}Content-Length: 99{RECORD_END}cut off", newline="")
    assert [bytes(r.payload) for r in read_archives(spark, str(folder)).orderBy("offset").collect()][:1] == [b"hello"]


def test_decontamination_of_items_with_two_texts(spark):
    from mdcorpus.llm.decontaminate import leaks

    one = "Which river runs through the old town of Basel. It is the upper Rhine."
    two = "Seven copper kettles hung above some quiet kitchen stove yesterday. Nobody ever polished them afterwards."
    other = [(i, f"Filler{i} item{i} about thing{i} number{i}. Answer{i} given{i}.") for i in range(2, 12)]
    items = spark.createDataFrame([(1, one), (1, two), *other], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"aa bb {one} cc"), (2, f"aa bb {two} cc"), (3, "aa bb cc")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in leaks(docs, items).collect()) == [(1, 1), (2, 1)]


def test_warc_long_header(spark, tmp_path):
    from mdcorpus.llm.warc import MAGIC, RECORD_END, read_archives

    record = lambda uri, text: f"{MAGIC}WARC-Target-URI: {uri}\r\nContent-Length: {len(text)}{RECORD_END}{text}{RECORD_END}"
    folder = tmp_path / "w"
    folder.mkdir()
    (folder / "a.txt").write_text(record("a", "one") + record("u" * 9000, "two") + record("c", "three"), newline="")
    assert [bytes(r.payload) for r in read_archives(spark, str(folder)).orderBy("offset").collect()] == [b"one", b"two", b"three"]


def test_sibling_statistics_of_many_children():
    from mdcorpus.llm.dom import FEATURES, features, parse

    page = "<main><h2>a</h2>" + "<p>text</p>" * 99 + '<div class="ad">x</div></main>'
    nodes, x = features(parse(page), {})
    column = {f: x[:, i] for i, f in enumerate(FEATURES)}
    at = {n.tag: i for i, n in enumerate(nodes)}  # the last of each tag
    assert column["place"][at["div"]] == 1.0 and column["like_siblings"][at["div"]] == 1 / 101
    first = next(i for i, n in enumerate(nodes) if n.tag == "p")
    assert column["after_heading"][first] == 1 and column["after_heading"][at["p"]] == 0 and column["like_siblings"][at["p"]] == 99 / 101


@pytest.mark.parametrize(
    "page, texts",
    [
        ("<html><head><title>x</title><article><p>text</p></article>", ["text"]),
        ("<html><head><meta charset=u><title>x</title><body><article><p>a</p><header>b</header><p>c</p></article>", ["a", "b", "c"]),
        ("<head><title>x</title><style>s</style>\n</head><body><p>text</p>", ["text"]),
        ("<head><script>s</script>words<p>text</p>", ["words", "text"]),
        ("<article><p>a</p><button>b<section><p>c</p></section></article>", ["a", "b", "c"]),
        *((f"<article><p>a</p><{name}><p>c</p></article>", ["a", "c"]) for name in ("svg", "select", "noscript", "button", "template")),
        ("<p>a <svg><text>s</text></svg> <button>b</button> c</p><noscript>d</noscript><template>e</template>", ["a s b c", "d"]),
        ("<article><p>Let <math><mi>x</mi></math> be</p><object><p>d</p></object><math><p>e</p>", ["Let x be", "d", "e"]),
        ("<p>a</p><script>x </scripts> y</script><p>b</p><style>c", ["a", "b"]),
    ],
)
def test_unclosed_elements(page, texts):
    from mdcorpus.llm.dom import features, parse

    assert [n.text for n in features(parse(page), {})[0] if n.text] == texts


@pytest.mark.parametrize(
    "page, words",
    [
        ("<div>" * 5000 + "<p>deep</p>" + "</div>" * 5000 + "<p>end</p>", ["deep", "end"]),
        ("<div>" * 20_000 + "</x>" * 20_000 + "end", ["end"]),
        ("<ul><li>" * 20_000 + "<li>" * 20_000 + "end", ["end"]),
        ("<div><li>" * 20_000 + "</li>" * 20_000 + "end", ["end"]),
        ("<a " * 350_000, None), ("<a '" * 250_000 + ">", None), ('<a b="' * 200_000 + "<p>end", None), ("<!" * 500_000, None), ("<template>" * 100_000 + "<body>end", ["end"]), ("<p>a" + "<" * 1_000_000, None),
        ("<p>" + "word " * 400_000, None),
    ],
)
def test_broken_pages_take_time_in_proportion(page, words):
    import time

    from mdcorpus.llm.dom import features, parse
    from mdcorpus.llm.extract import _teach

    start = time.time()
    root = parse(page)
    nodes, x = features(root, {})
    assert len(_teach(root)) == len(nodes) + 1 and len(x) == len(nodes)
    assert words is None or [n.text for n in nodes if n.text] == words
    assert time.time() - start < 15


def test_extraction(spark):
    from mdcorpus.llm import extract

    data = "/root/testdata/sf0.01/pages.parquet"
    pages = spark.read.parquet(data)
    trees = extract.fit(pages)
    made = '<html><body><div id="header"><a href="/">Home</a></div><div class="menu"><ul><li><a>One</a></li></ul></div><div class="post-content"><h2>Title &amp; all</h2><p>First  paragraph\n of the story, with words.</p><p>Second one goes on and on.</p></div><div id="comments"><p>Great post, thanks!</p></div><div class="footer">Copyright</div></body></html>'
    assert extract.main_text(made, trees) == "Title & all\nFirst paragraph of the story, with words.\nSecond one goes on and on."
    assert extract.main_text("", trees) == "" and extract.main_text(None, trees) == "" and isinstance(extract.main_text("<p><<>>&#xZ;</div>", trees), str)
    rows = pages.select("page_id", "url", "html", F.lit(1).alias("text")).limit(40).union(spark.createDataFrame([(None, None, None, 1)], "page_id long, url string, html string, text int"))
    for r in extract.extracted(rows).collect():
        assert r.n_chars == len(r.text) and "©" not in r.text and "track(" not in r.text
    none = spark.createDataFrame([(1, "u", "<nav>a</nav><p>b</p>")], "page_id long, url string, html string")
    assert extract.extracted(none).first().text == "b" and extract.extracted(none.limit(0)).count() == 0


def test_mixing_deals_many_shards_in_groups(spark, monkeypatch):
    """A source of more shards than one task deals to: groups first, then the groups within them, then shards."""
    from mdcorpus.llm import mix as M

    monkeypatch.setattr(M, "DEALT_AT_ONCE", 4)
    rng = np.random.default_rng(3)
    counted = [(0, s, int(rng.integers(1, 500))) for s in range(23)] + [(1, s, int(rng.integers(1, 9))) for s in range(3)] + [(2, 5, 7)]
    plan = [(0, 8, 900), (1, 2, 5), (2, 1, 100)]
    got = M._quotas(spark.createDataFrame(counted, "number int, shard int, words long").repartition(3), spark.createDataFrame(plan, "number int, block long, seats long"), 23)

    def quotients(votes, seats, most):
        k = [0] * len(votes)
        for _ in range(min(seats, sum(most))):
            k[max((i for i in range(len(votes)) if k[i] < most[i]), key=lambda i: (votes[i] / (2 * k[i] + 1), -i))] += 1
        return k

    def dealt(shards, seats, block, level):
        groups = {}
        for s, w in shards:
            groups.setdefault(s // 4**level, []).append((s, w))
        keys = sorted(groups)
        most = [sum(2 * -(-w // block) for _, w in groups[k]) for k in keys]
        k = quotients([sum(w for _, w in groups[g]) for g in keys], seats, most)
        if not level:
            return dict(zip(keys, k))
        return {s: q for g, n in zip(keys, k) for s, q in dealt(groups[g], n, block, level - 1).items()}

    want = {(n, s): (b, q) for n, b, seats in plan for s, q in dealt([(s, w) for m, s, w in counted if m == n], seats, b, 2).items()}
    assert {(r.number, r.shard): (r.block, r.quota) for r in got.collect()} == want
    # the whole mix, in many small shards
    monkeypatch.setattr(M, "SHARD_WORDS", 300)
    docs = spark.createDataFrame([(i, " ".join(["w"] * int(rng.integers(0, 90))), "ab"[i % 5 == 0]) for i in range(300)], "doc_id long, text string, source string")
    first, again = ([tuple(r) for r in sorted(M.mix_sources(docs.repartition(n)).collect(), key=repr)] for n in (2, 5))
    assert first == again and len(first) == 300 and all(r.taken <= 2 * r.size for r in M.mix_sources(docs).collect())
    for size in {r[2] for r in first}:
        own = [r for r in first if r[2] == size]
        assert abs(sum(r[4] for r in own) - own[0][3]) <= 0.05 * own[0][3]


def test_scratch_goes_with_the_application(spark, tmp_path):
    """What lazy results may still read is marked to be deleted when the application ends."""
    import subprocess
    import sys

    program = f"""
from pyspark.sql import SparkSession
from mdcorpus.llm.common import Scratch
spark = SparkSession.builder.master("local[1]").config("spark.checkpoint.dir", "{tmp_path}").config("spark.ui.enabled", "false").getOrCreate()
scratch = Scratch(spark, "kept")
assert scratch.save(spark.range(3), "rows").count() == 3
print("TOP", scratch.top)
spark.stop()
"""
    out = subprocess.run([sys.executable, "-c", program], capture_output=True, text=True, timeout=120)
    top = next(line.split()[1] for line in out.stdout.splitlines() if line.startswith("TOP"))
    import os
    import time

    for _ in range(50):  # the JVM may end a little after Python does
        if not os.path.exists(top.removeprefix("file:")):
            break
        time.sleep(0.2)
    assert top.startswith(f"file:{tmp_path}") and not os.path.exists(top.removeprefix("file:"))
