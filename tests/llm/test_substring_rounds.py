"""More rounds of recompression: the same result, and less left to compare where much is alike and little repeats."""

import random

import pytest

from mdcorpus.llm import substring as S
from mdcorpus.llm.exchange import thaw


def corpus():
    """One phrase of four words in every document, among few words in any order; ten documents share a passage."""
    r = random.Random(11)
    words = [f"w{i}" for i in range(40)]
    passage = " ".join(r.choices(words, k=30))
    rows = []
    for i in range(400):
        text = r.choices(words, k=60)
        for _ in range(3):
            at = r.randrange(len(text))
            text[at:at] = ["the", "same", "four", "words"]
        rows.append((i, " ".join(text) + (f" {passage} " + " ".join(r.choices(words, k=5)) if i % 40 == 0 else "")))
    return rows


def removed(rows, window=13):
    first, out = {}, {}
    for d, t in rows:
        w = t.split()
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), d)
    for d, t in rows:
        w = t.split()
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < d:
                gone |= set(range(k, k + window))
        out[d] = len(gone)
    return out


@pytest.fixture(scope="module")
def measured(spark):
    """By number of rounds: what is removed, and the words sent to be compared, in all and by bucket."""
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(4).cache()
    out, save = {}, S.save
    for rounds in (1, 2, 3, 4, 5):
        sent = []

        def watched(scratch, df, name, sent=sent):
            saved = save(scratch, df, name)
            if name == "stretches":
                words = {}
                for r in saved.where("role = 'ask'").select("bucket", "body").collect():
                    words[r.bucket] = words.get(r.bucket, 0) + len(thaw(bytes(r.body))[1])
                sent += words.values()
            return saved

        S.save = watched
        try:
            got = {r.doc_id: r.n_removed for r in S.remove_repeats(docs, rounds=rounds, chunk_bytes=20_000).collect()}
        finally:
            S.save = save
        out[rounds] = got, sent
    return out


def test_rounds_change_nothing(measured):
    want = removed(corpus())
    assert sum(want.values()) >= 9 * 30
    for got, _ in measured.values():
        assert got == want


def test_more_rounds_leave_less_to_compare(measured):
    """What a phrase that every document has brings together is ruled out by the longer symbols around it."""
    total = {k: sum(sent) for k, (_, sent) in measured.items()}
    assert total[1] > total[2] > total[3] > total[4] and S.ROUNDS >= 3
    assert max(measured[S.ROUNDS][1]) < 12_900 / 2  # two rounds sent 12,900 words to one bucket when a symbol had one only


def test_no_bucket_gets_much_more_than_others(measured):
    """The phrase that every document has stands in many contexts, which are dealt to many buckets after any number of rounds."""
    for _, sent in measured.values():
        assert max(sent) < 2 * sorted(sent)[len(sent) // 2]
