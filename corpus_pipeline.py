"""From `documents` to a training mix: each stage applies one operator to all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns the documents that it keeps, in the columns of `documents`; the last
adds what the mix takes of each. Every stage looks at doc_id, text and (mixing) source alone, takes null and empty texts, null and
repeated ids and repeated rows as said below, hands other columns on as they are, whatever their names, and gives an
empty table for an empty one. Where rows are matched again, it is by a number of their own, not by doc_id.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdcorpus.llm.common import Scratch, fresh, numbered, table
from mdcorpus.llm.decontaminate import leak_free
from mdcorpus.llm.mix import mix_sources
from mdcorpus.llm.quality import fit, scored
from mdcorpus.llm.simhash import near_duplicates
from mdcorpus.llm.substring import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null and empty texts are scored as texts without words."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    predicted = fresh(docs.columns, "predicted")
    return scored(docs, model, fresh(docs.columns, "score"), predicted).where(F.col(predicted) == 1).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group one row stays: that of the smallest id (null ids last), of equal ids the first in the input.

    Texts without words are one group.
    """
    rows, row = numbered(docs)
    found = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("r"), F.col("component_id").alias("c"))
    of = rows.select(F.col(row).alias("r"), F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("r")).alias("place"))
    # rows of a group of one are no row's copy, so only the others are gone through
    several = found.groupBy("c").agg(F.count("*").alias("n")).where("n > 1").select("c")
    members = found.join(several, "c").join(of, "r")
    first = members.groupBy("c").agg(F.min("place").alias("first"))
    gone = members.join(first, "c").where("r <> first.r").select(F.col("r").alias(row))
    return rows.join(gone, row, "left_anti").select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that a document with a smaller id has go, as in the operator; a document that loses all its words goes.

    Texts become their kept words, joined by one space, and n_chars, where there is such a column, their length; null texts become empty.
    """
    carry = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    kept = remove_repeats(docs, carry=carry).where("n_words = 0 OR n_removed < n_words")
    own = {c: F.col(f"carried_{i}") for i, c in enumerate(carry)} | {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return kept.select(*[own[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go, whatever their ids; null and empty texts hold none."""
    return leak_free(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with the columns `target` (their source's) and `taken` (words, repeats counted).

    Columns of `docs` that have those names keep them, and the new ones get a longer name. Texts without words are not taken.
    """
    rows, row = numbered(docs)
    target, taken = fresh(docs.columns, "target"), fresh(docs.columns, "taken")
    mix = mix_sources(rows.select("doc_id", "text", "source", F.col(row).alias("row")), row="row").where("taken > 0")
    return rows.join(mix.select(F.col("row").alias(row), F.col("target").alias(target), F.col("taken").alias(taken)), row).select(*docs.columns, target, taken)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("mixing", mixing)]
#: Two of the stages fit models or draw by seed, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to `documents`; what a stage keeps is written to the shared folder before the next reads it."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, f"pipeline-{uuid4().hex}")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.save(docs, name)
            if i:
                scratch.drop(STAGES[i - 1][0])
    return docs
