"""Ranked retrieval: a table of queries against the documents of their roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frontmatter import split_frontmatter
from ..functions.text import quoted, tokenise
from ..sources.shared import cut
from .skew import HEAVY, degree_join

#: Letters of a run in the index of words.
GRAM = 3
TITLE, TAG, DESCRIPTION = 3.0, 2.0, 1.0


def _fields(docs: DataFrame) -> DataFrame:
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    return docs.select("root", "path", F.lower("title").alias("title_lc"), F.lower("description").alias("description_lc"), F.transform(tags, F.lower).alias("tags_lc"))


def _asked(queries: DataFrame) -> DataFrame:
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    return queries.select("query_id", "root", tokenise(F.col("topic")).alias("tokens"), F.transform(tags, F.lower).alias("asked"), mode().alias("match"))


def mode():
    """A query's match mode; none, and an empty one, mean `and`."""
    return F.coalesce(F.nullif(F.col("match"), F.lit("")), F.lit("and"))


def passes():
    """Whether a document's tags pass a query's filter; no mode but and / or passes, not even without a filter."""
    every = F.size(F.array_except("asked", "tags_lc")) == 0
    some = F.arrays_overlap("asked", "tags_lc")
    return F.when(~F.col("match").isin("and", "or"), False).when(F.size("asked") == 0, True).when(F.col("match") == "and", every).otherwise(some)


def tag_filter(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, root, path) of documents that pass the filter. Spark broadcasts the queries if their size allows."""
    return _fields(docs).join(_asked(queries), "root").where(passes()).select("query_id", "root", "path")


def score(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, root, path, score): -1 if filtered out, else the sum over the topic's distinct tokens."""
    hit = lambda c, w: F.when(c, F.lit(w)).otherwise(F.lit(0.0))
    total = F.aggregate(
        "tokens", F.lit(0.0),
        lambda s, t: s + hit(F.contains("title_lc", t), TITLE) + hit(F.exists("tags_lc", lambda g: F.contains(g, t)), TAG) + hit(F.contains("description_lc", t), DESCRIPTION),
    )
    pairs = _fields(docs).join(_asked(queries), "root")
    return pairs.select("query_id", "root", "path", F.when(passes(), total).otherwise(F.lit(-1.0)).alias("score"))


def grams(text: Column, n: int) -> Column:
    """All runs of n characters in a text; none of a shorter one."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), 1)


def words_with(words: DataFrame, tokens: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(root, word, token) for the `words(root, word)` that hold one of the `tokens(root, token)`, both distinct.

    An index leads from runs of GRAM letters to words. A token meets the words of its rarest run and is looked for in them; a
    shorter one is a run by itself. The index has the runs that some token asks for, and shorter ones only if there are such tokens.
    """
    own = F.when(F.length("token") < GRAM, F.array("token")).otherwise(grams(F.col("token"), GRAM))
    asked = cut(tokens.select("root", "token", F.explode(F.array_distinct(own)).alias("gram")))
    sizes = [r[0] for r in asked.select(F.length("gram")).distinct().collect()]  # GRAM numbers
    if not sizes:
        return words.join(tokens, "root").where("false").select("root", "word", "token")
    of_word = F.array_distinct(F.concat(*[grams(F.col("word"), n) for n in sorted(sizes)]))
    index = words.select("root", F.explode(of_word).alias("gram"), "word")
    index = cut(index.join(asked.select("root", "gram").distinct(), ["root", "gram"], "left_semi"))
    postings = index.groupBy("root", "gram").agg(F.count("*").alias("n"))
    # a token with a run that no word has is in none
    least = asked.join(postings, ["root", "gram"], "left").groupBy("root", "token").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g"))
    rarest = least.where("g.n > 0").select("root", "g.gram", "token")
    return degree_join(index, rarest, ["root", "gram"], heavy).where(F.contains("word", F.col("token"))).select("root", "word", "token")


def vocabulary_score(docs: DataFrame, queries: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Scores above 0 as score() has them, for many queries: through the distinct words of documents and of topics.

    A token lies within a field just if it lies within one of the field's words. Tokens find their words by an index, words
    lead on to documents, tokens to queries. Words and tokens with more than `heavy` rows are dealt over tasks.
    """
    fields, asked = _fields(docs), _asked(queries)
    tokens = asked.select("root", F.explode("tokens").alias("token")).distinct()
    weighed = F.array(
        F.struct(F.lit(TITLE).alias("w"), F.array("title_lc").alias("texts")), F.struct(F.lit(TAG).alias("w"), F.col("tags_lc").alias("texts")), F.struct(F.lit(DESCRIPTION).alias("w"), F.array("description_lc").alias("texts"))
    )
    words = fields.select("root", "path", F.explode(weighed).alias("f")).select("root", "path", "f.w", F.explode(F.array_distinct(F.flatten(F.transform("f.texts", tokenise)))).alias("word"))
    words = cut(words)
    found = words_with(words.select("root", "word").distinct(), tokens, heavy)
    hits = cut(degree_join(words, found, ["root", "word"], heavy).select("root", "path", "w", "token").distinct())
    asking = asked.select("query_id", "root", "asked", "match", F.explode("tokens").alias("token"))
    sums = degree_join(hits, asking, ["root", "token"], heavy).groupBy("query_id", "root", "path").agg(F.sum("w").alias("score"), F.first("asked").alias("asked"), F.first("match").alias("match"))
    return sums.join(fields.select("root", "path", "tags_lc"), ["root", "path"]).where(passes()).select("query_id", "root", "path", "score")


def find_best(docs: DataFrame, queries: DataFrame, strategy: str = "direct") -> DataFrame:
    """(query_id, root, path, score) of each query's best document: the highest score above 0, then the smaller path."""
    if strategy not in ("direct", "vocab"):
        raise ValueError("strategy is 'direct' or 'vocab'")
    scored = (score if strategy == "direct" else vocabulary_score)(docs, queries).where("score > 0")
    best = scored.groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("low"), "path", "root")).alias("b"))
    return best.select("query_id", "b.root", "b.path", (-F.col("b.low")).alias("score"))


def outcomes(docs: DataFrame, queries: DataFrame, best: DataFrame) -> DataFrame:
    """(query_id, status, message) for every query, the first of: empty_topic, invalid_match, ok, empty_index, no_match."""
    asked = queries.select("query_id", "root", "topic", mode().alias("match"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    roots = docs.select("root").distinct().withColumn("has_docs", F.lit(True))
    rows = asked.join(best.select("query_id", "path"), "query_id", "left").join(roots, "root", "left")
    status = (
        F.when(F.coalesce("topic", F.lit("")) == "", "empty_topic").when(~F.col("match").isin("and", "or"), "invalid_match")
        .when(F.col("path").isNotNull(), "ok").when(F.col("has_docs").isNull(), "empty_index").otherwise("no_match")
    )
    message = (
        F.when(status == "empty_topic", "topic is required")
        .when(status == "invalid_match", F.concat(F.lit("invalid match value "), quoted(F.col("match")), F.lit(': must be "and" or "or"')))
        .when(status == "empty_index", "index is empty: no markdown documents found in cwd")
        .when(status == "no_match", F.concat(F.lit("no document matched topic "), quoted(F.col("topic")), F.lit(" with tags ["), F.array_join("tags", " "), F.lit("]")))
        .otherwise("")
    )
    return rows.select("query_id", status.alias("status"), message.alias("message"))


def _answered(docs: DataFrame, queries: DataFrame, best: DataFrame, bodies: DataFrame) -> DataFrame:
    """Each query's outcome, with the winners' columns; `bodies(root, path, body)` hold the winners' at least."""
    won = best.join(docs, ["root", "path"]).join(bodies, ["root", "path"])
    won = won.select("query_id", F.col("body").alias("content"), F.col("path").alias("file_path"), "tags", "title", "description", "bundle")
    return outcomes(docs, queries, best).join(won, "query_id", "left")


def get_doc(files: DataFrame, docs: DataFrame, queries: DataFrame, strategy: str = "direct") -> DataFrame:
    """For every query its outcome and, if there is one, the best document with its body; `docs` have bundles.

    Bodies are cut from `files(root, path, content)` last, of the winners alone.
    """
    best = cut(find_best(docs, queries.where("coalesce(topic, '') <> ''"), strategy))
    won = split_frontmatter(files.select("root", "path", "content").join(best.select("root", "path").distinct(), ["root", "path"])).select("root", "path", "body")
    return _answered(docs, queries, best, won)


def get_stored_doc(docs: DataFrame, bodies: DataFrame, queries: DataFrame, strategy: str = "direct") -> DataFrame:
    """get_doc, from bodies that are there already: `bodies(root, path, body)`."""
    best = cut(find_best(docs, queries.where("coalesce(topic, '') <> ''"), strategy))
    return _answered(docs, queries, best, bodies)
