"""BPE by trie against the tokenizers library, against merging pair by pair, and on made-up vocabularies."""

import hashlib
import json
import random

import numpy as np
import pytest

DATA = "/root/testdata/sf0.001"
ODD = ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "don't I'LL we're '''s", "  two   blanks \n\n\t tab\r\n", "日本語 العربية 👩‍👩‍👧 é   x\u0085", "1234567 ٣٤٥ ²", "x" * 5000, "ab" * 3000, " " * 700 + "z", "\x00\x01\x7f", "=" * 300 + "!" * 40, "ÃÂÃÂ" * 90]


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def coder(path):
    from mdcorpus.llm.bpe import Bpe

    return Bpe(open(path, encoding="utf-8").read())


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def lists(coder, texts):
    tokens, offsets = coder.encode(texts)
    return [tokens[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]


def test_encoding_equals_the_library(coder, library):
    r = random.Random(3)
    letters = "etaoin srhl ETA 'sd.,!?-0129\n\té漢я "
    texts = ODD + ["".join(r.choice(letters) for _ in range(r.randrange(1, 400))) for _ in range(600)] + [bytes(r.randrange(1, 256) for _ in range(200)).decode("latin-1") for _ in range(100)]
    got = lists(coder, texts)
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    tokens, offsets = coder.encode(texts)
    assert coder.decode(tokens, offsets) == [library.decode(x, skip_special_tokens=False) for x in got] == texts


def test_every_character_is_split_as_the_library_does(coder, library):
    texts = [f"a{c}b 1{c}2 .{c}! {c}{c} x" for c in map(chr, range(0, 0x30000)) if not 0xD800 <= ord(c) < 0xE000]
    for a in range(0, len(texts), 20000):
        part = texts[a : a + 20000]
        assert lists(coder, part) == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]


def test_decoding_of_any_tokens(coder, library):
    r = np.random.default_rng(5)
    runs = [r.integers(0, 50257, n).tolist() for n in (0, 1, 3, 50, 400)]
    offsets = np.cumsum([0, *map(len, runs)])
    assert coder.decode(np.array(sum(runs, []), np.int32), offsets) == [library.decode(x, skip_special_tokens=False) for x in runs]


def test_pieces_and_forgetting_change_nothing(coder, library, monkeypatch):
    from mdcorpus.llm import bpe

    for name, value in (("PIECE_CHARS", 7), ("KEPT_WORDS", 3), ("KEPT_PAIRS", 5)):
        monkeypatch.setattr(bpe, name, value)
    texts = ODD + ["some words   and \n\n more, it's 12 of them " * 5]
    assert lists(coder, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def merged(spec, word):
    """The plain way: the lowest merge, leftmost first, until there is none."""
    rank = {tuple(m): i for i, m in enumerate(spec["model"]["merges"])}
    parts = list(word)
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (rank.get((parts[i], parts[i + 1]), 1 << 30), i))
        if (parts[best], parts[best + 1]) not in rank:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [spec["model"]["vocab"][p] for p in parts]


@pytest.mark.parametrize("seed", range(12))
def test_random_vocabularies(seed):
    """Merges in an order that no training gives, some of them never used."""
    from mdcorpus.llm.bpe import Bpe, byte_letters

    r = random.Random(seed)
    vocab = {c: i for i, c in enumerate(byte_letters())}
    merges, names = [], list("abc")
    for _ in range(60):
        a, b = r.choice(names), r.choice(names)
        if a + b not in vocab and len(a + b) < 9:
            vocab[a + b] = len(vocab)
            merges.append([a, b])
            names.append(a + b)
    spec = {"added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "model": {"type": "BPE", "vocab": vocab, "merges": merges}}
    words = ["".join(r.choice("abc") for _ in range(r.randrange(1, 30))) for _ in range(400)]
    assert lists(Bpe(json.dumps(spec)), words) == [merged(spec, w) for w in words]


def test_query_and_odd_rows(spark, path, library):
    from mdcorpus.llm.bpe import decoded, digests, encoded, round_trip

    schema = "doc_id long, text string, ids string, n_tokens string"
    own = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (5000, None), (5001, "twice"), (5001, "twice"), (5002, "long text " * 100_000)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in own], schema).repartition(3)
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in own:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), h(",".join(map(str, ids))), h(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, digests(round_trip(docs, path)).collect()), key=repr) == sorted(want, key=repr)
    assert sorted(((r.doc_id, h(r.text)) for r in decoded(encoded(docs, path), path).collect()), key=repr) == sorted(((w[0], w[3]) for w in want), key=repr)
    assert digests(round_trip(spark.createDataFrame([], schema), path)).collect() == []
    assert decoded(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), path).collect()[0].text == ""


def test_unfit_files_are_refused():
    from mdcorpus.llm.bpe import Bpe

    with pytest.raises(ValueError):
        Bpe(json.dumps({"model": {"type": "WordPiece", "vocab": {}}}))
