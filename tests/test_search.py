"""Retrieval by an index of runs of letters, and joins on keys of very different weight."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mdcorpus.operators import search
from mdcorpus.operators.skew import degree_join

DOC = "root string, path string, title string, description string, type string, tags array<string>"
QUERY = "query_id long, root string, topic string, tags array<string>, match string"


@pytest.mark.parametrize("heavy", [3, 1_000_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_index_finds_what_looking_everywhere_finds(spark, heavy, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcé𝒳1") for _ in range(r.choice([1, 2, 3, 4, 9, 40])))
    some = lambda n: " ".join(word() for _ in range(r.randrange(n)))
    docs = spark.createDataFrame([(f"r{r.randrange(2)}", f"{i}.md", some(6), some(9), "t", r.choice([None, [word(), word()]])) for i in range(120)], DOC)
    asked = spark.createDataFrame([(i, f"r{r.randrange(3)}", " ".join(word()[: r.randrange(1, 6)] for _ in range(3)), None, r.choice(["and", "or", None, "nor"])) for i in range(60)], QUERY)
    direct = sorted(map(tuple, search.score(docs, asked).where("score > 0").collect()))
    assert len(direct) > 500 and direct == sorted(map(tuple, search.vocabulary_score(docs, asked, heavy).collect()))


def test_long_words_and_long_tokens(spark):
    r = random.Random(5)
    long = "".join(r.choice("abcdefgh") for _ in range(10_000))
    docs = spark.createDataFrame([("r", "1.md", long, "", "t", None), ("r", "2.md", "x" + long[1:], "", "t", [long[:5000]]), ("r", "3.md", "abc", long[::-1], "t", None)], DOC)
    topics = [long, long[3000:9999], long[1:], long[:4999] + "z", "y" * 10_000, "q", "ab", long[4990:5010], long[::-1][:7]]
    asked = spark.createDataFrame([(i, "r", t, None, None) for i, t in enumerate(topics)], QUERY)
    got = sorted(map(tuple, search.vocabulary_score(docs, asked).collect()))
    assert got == sorted(map(tuple, search.score(docs, asked).where("score > 0").collect())) and len({g[0] for g in got}) == 6


def test_words_are_met_by_their_rarest_run(spark):
    """The index holds only runs that tokens ask for, and no run of short ones without a short token."""
    words = spark.createDataFrame([("r", w) for w in ("abcde", "abcxx", "zzz", "bcd")], "root string, word string")
    found = lambda *t: sorted((x.word, x.token) for x in search.words_with(words, spark.createDataFrame([("r", y) for y in t], "root string, token string")).collect())
    assert found("bcd", "abc") == [("abcde", "abc"), ("abcde", "bcd"), ("abcxx", "abc"), ("bcd", "bcd")]
    assert found("z", "bc", "abcdx") == [("abcde", "bc"), ("abcxx", "bc"), ("bcd", "bc"), ("zzz", "z")]
    assert found("nothing") == [] and search.words_with(words, words.select("root", F.col("word").alias("token")).where("false")).collect() == []


@pytest.fixture
def plain(spark):
    """No broadcasts of small sides and no plan changes at run time."""
    own = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield spark
    for k in own:
        spark.conf.unset(k)


def test_a_one_letter_topic_loads_all_tasks_alike(plain):
    """All 6000 documents hold the letter, most by way of the same word."""
    docs = plain.range(6000).select(F.lit("r").alias("root"), F.concat("id", F.lit(".md")).alias("path"), F.when(F.col("id") % 10 == 0, F.concat(F.lit("oe"), "id")).otherwise("oe").alias("title"), F.lit("").alias("description"), F.lit("t").alias("type"), F.lit(None).cast("array<string>").alias("tags"))
    asked = plain.createDataFrame([(1, "r", "e", None, None)], QUERY)
    assert search.vocabulary_score(docs, asked, 40).agg(F.count("*"), F.min("score"), F.max("score")).first()[:] == (6000, 3.0, 3.0)
    hits = docs.select("root", "path", F.lit("e").alias("token"))
    joined = degree_join(hits, asked.select("query_id", "root", F.lit("e").alias("token")), ["root", "token"], 40)
    loads = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect())
    assert sum(loads) == 6000 and len(loads) == 8 and loads[-1] <= 2 * loads[len(loads) // 2]


@pytest.mark.parametrize("heavy", [1, 7, 10_000])
def test_degree_join_is_a_join(plain, heavy):
    r = random.Random(heavy)
    many = [(r.choice([1, 1, 1, 1, 2, 3, None]), i % 50) for i in range(900)]
    few = [(k, x) for k in (1, 1, 2, 4, None) for x in "ab"]
    got = degree_join(plain.createDataFrame(many, "k long, v long"), plain.createDataFrame(few, "k long, x string"), ["k"], heavy)
    assert Counter(map(tuple, got.select("k", "v", "x").collect())) == Counter((k, v, x) for k, v in many for j, x in few if k is not None and j == k)
    assert degree_join(plain.createDataFrame([], "k long, v long"), plain.createDataFrame(few, "k long, x string"), ["k"], heavy).collect() == []
