"""Words of all scripts in decontamination, and items in many shards."""

import pytest

from mdcorpus.llm import decontaminate as D

ITEM = "“Hello — Mars”, said the pilot’s copy of the log… “who goes there at this hour?” Nobody answered – the radio stayed quiet."
PLAIN = '"Hello - Mars", said the pilot\'s copy of the log... "who goes there at this hour?" Nobody answered - the radio stayed quiet.'
CHINESE = "请问长江上游的哪一座城市以火锅和山城夜景闻名于世界各地的游客。答案是重庆这座直辖市。"
KANA = "このきかんしゃはいつえきにつきますか。あしたのあさろくじです。"
OTHER = [(i, f"Filler{i} item{i} about thing{i} number{i} and more{i}. Answer{i} given{i} here{i}.") for i in range(20, 60)]


@pytest.mark.parametrize(
    "text, words",
    [
        ("“Hello” — Mars", ["hello", "mars"]), ("it’s l’été", ["it", "s", "l", "été"]), ("a_b-c", ["a", "b", "c"]), ("长江x2 カナ", ["长", "江", "x2", "カ", "ナ"]), ("ét हिन्दी", ["ét", "हिन्दी"]), ("İ٣", ["i̇٣"]), (None, []), ("… —", []),
    ],
)
def test_words(text, words):
    assert D.lowered([text])[0].decode().replace("_", " ").replace("-", " ").split() == words


def test_items_are_found_over_quotes_dashes_and_without_blanks(spark):
    items = spark.createDataFrame([(1, ITEM), (2, CHINESE), (3, KANA), *OTHER], "item_id long, text string")
    pad = "Words that stand before and behind. " * 10
    rows = [(1, pad + PLAIN + pad), (2, pad + ITEM + pad), (3, f"他说：{CHINESE}然后离开了。"), (4, f"{pad}{CHINESE.replace('。', ' ')}"), (5, KANA + pad), (6, pad + "“ — ” … " * 40), (7, "长江是一条河。重庆是一座城市。"), (8, pad)]
    got = sorted((r.doc_id, r.item_id) for r in D.leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect())
    assert got == [(1, 1), (2, 1), (3, 2), (4, 2), (5, 3)]


@pytest.mark.parametrize("held", [1, 2, 4])
def test_shards_change_nothing(spark, monkeypatch, held):
    """Items of many shards, held some at a time: what is found is written before the next are."""
    monkeypatch.setattr(D, "SHARDS_HELD", held)
    items = spark.createDataFrame([(1, ITEM), (2, CHINESE), *OTHER], "item_id long, text string")
    rows = [(i, f"Before it. {t} And behind it." if i % 3 else f"Nothing {i}") for i, t in OTHER] + [(None, PLAIN), (7, "long words " * 50_000 + CHINESE)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string").repartition(3)
    want = sorted([(i, i) for i, _ in OTHER if i % 3] + [(-1, 1), (7, 2)])
    for size in (4 << 20, 900):
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.item_id) for r in D.leaks(docs, items, shard_bytes=size).collect()) == want
        kept = D.leak_free(docs, items, shard_bytes=size)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, _ in OTHER if not i % 3]
