"""The pipeline's stages one after another, each against its operator's own report, and each on rows of every odd kind."""

import pytest

import corpus_pipeline as P

DATA = "/root/testdata/sf0.001"
#: Columns with the names that stages use for themselves.
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, chunk long, kept string, n_words long, n_removed long, row long, target double, taken long, carried_0 long"


def widened(rows):
    return [(*r, "s", "p", i, "k", i, i, 2**60 + i, 0.5, i, i) for i, r in enumerate(rows)]


@pytest.fixture(scope="module")
def odd(spark):
    own = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 3000").limit(25).collect()]
    rows = [*own, (None, None, None, None, None), (None, None, None, None, None), (9001, "", "en", "b", 0), (9002, " \t\n", None, None, 4), (None, own[0][1], "fr", "a", None), (own[1][0], "Another text of the same id, about nothing much.", "en", "a", 3), own[2], own[2], (9003, "x " * 5000 + "é" * 5000, "de", "c", 2**60 + 1)]
    return spark.createDataFrame(widened(rows), CLASHING).repartition(3).cache()


def test_stages(spark):
    from mdcorpus.llm.common import table
    from mdcorpus.llm.decontaminate import leaks
    from mdcorpus.llm.mix import mix_sources
    from mdcorpus.llm.simhash import near_duplicates
    from mdcorpus.llm.substring import remove_repeats

    docs = table(spark, DATA, "documents")
    kept = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, DATA).cache()
        kept[name] = (docs, out)
        docs = out
    for name, (_, out) in list(kept.items())[:-1]:
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = kept["near_dedup"]
    assert ids(after) == {r.doc_id for r in near_duplicates(before).collect() if r.doc_id == r.component_id}
    before, after = kept["substring_dedup"]
    assert {(r.doc_id, len(r.text.split())) for r in after.collect()} == {(r.doc_id, r.n_words - r.n_removed) for r in remove_repeats(before).collect() if r.n_words == 0 or r.n_removed < r.n_words}
    before, after = kept["decontamination"]
    assert ids(after) == ids(before) - ids(leaks(before, table(spark, DATA, "benchmark")))
    before, after = kept["mixing"]
    sizes = {r.doc_id: (r.size, r.target) for r in mix_sources(before).collect()}
    assert all(0 < r.taken <= 2 * sizes[r.doc_id][0] and r.target == sizes[r.doc_id][1] for r in after.collect())
    assert 0 < len(ids(P.run(spark, DATA)))


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_stages_take_odd_rows(spark, odd, name, stage):
    got = stage(spark, odd, DATA)
    more = ["target_", "taken_"] if name == "mixing" else []
    assert got.columns == [*odd.columns, *more]
    same = [c for c in odd.columns if name != "substring_dedup" or c not in ("text", "n_chars")]
    whole = {tuple(r) for r in odd.select(*same).collect()}
    rows = got.collect()
    assert rows and {tuple(r[c] for c in same) for r in rows} <= whole
    assert stage(spark, odd.limit(0), DATA).count() == 0


def test_near_dedup_goes_by_row(spark):
    text = "some words that make a text long enough for several shingles of three words each"
    rows = [(None, text, 0), (None, text, 1), (7, text + " x", 2), (3, text, 3), (3, text, 4), (3, "quite another text with the same id as the one before it", 5), (None, None, 6), (8, "", 7), (2, " ", 8)]
    kept = P.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, k int"), DATA).collect()
    from mdcorpus.llm.simhash import near_duplicates

    groups = {}
    for r in near_duplicates(spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(rows)], "doc_id long, text string")).collect():
        groups.setdefault(r.component_id, []).append(rows[r.doc_id])
    want = {min(g, key=lambda r: (r[0] is None, r[0] or 0))[:2] for g in groups.values()}
    assert len(kept) == len(groups) and {(r.doc_id, r.text) for r in kept} == want


def test_mixing_keeps_rows_with_null_and_repeated_ids(spark):
    rows = [(1, "a b c d", "en", "x", 7), (None, "e f g", "en", "y", 5), (1, "h i j k l", "en", "x", 9), (None, "e f g", "en", "y", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = P.mixing(spark, docs, DATA).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted((r[0] or 0, r[1]) for r in rows)
    assert all(0 < r.taken <= 2 * len(r.text.split()) for r in got)


def test_decontamination_goes_by_row(spark):
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").where("item_id IS NOT NULL AND length(text) > 80").orderBy("item_id").first().text
    rows = [(None, f"aa {item} bb"), (1, f"aa {item} bb"), (1, "a clean text with the same id"), (None, "a clean text without an id")]
    kept = P.decontamination(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA).collect()
    assert sorted(r.text for r in kept) == ["a clean text with the same id", "a clean text without an id"]
