"""Reading documentation trees: from a table of files, or from directories."""

from __future__ import annotations

import os
import re
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frontmatter import split_frontmatter
from ..schemas import FILES
from .shared import cut


def read_corpus(spark: SparkSession, table_or_path: str) -> DataFrame:
    """(root, path, content) from a Parquet path or a table; a table that lacks a column is an error."""
    df = spark.read.parquet(table_or_path) if "/" in table_or_path else spark.read.table(table_or_path)
    missing = {"root", "path", "content"} - set(df.columns)
    if missing:
        raise ValueError(f"not a table of files: it has no {', '.join(sorted(missing))}")
    return df.select("root", "path", "content")


VERSION_CONTROL = (".git", ".hg", ".svn")
#: A task reads about so many bytes of files, counting some for each file.
TASK_BYTES, FILE_BYTES = 32 << 20, 4096
LISTED = "root string, top string, path string, directory boolean, size long"


def _list(batches, hidden: bool):
    """What lies directly in each of the directories."""
    for pdf in batches:
        rows = []
        for root, top, path in pdf[["root", "top", "path"]].itertuples(index=False, name=None):
            for e in os.scandir(os.path.join(top, path)):
                below = f"{path}/{e.name}" if path else e.name
                if e.is_dir(follow_symlinks=False):
                    if e.name not in VERSION_CONTROL and (hidden or not e.name.startswith(".")):
                        rows.append((root, top, below, True, 0))
                elif not e.is_dir():  # links to directories are not followed
                    rows.append((root, top, below, False, e.stat().st_size if os.path.exists(e.path) else 0))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in LISTED.split(", ")])


def _read(batches):
    for pdf in batches:
        contents = []
        for top, path in pdf[["top", "path"]].itertuples(index=False, name=None):
            content = None
            if path.endswith(".md"):
                try:
                    with open(os.path.join(top, path), "rb") as f:
                        content = f.read().decode("utf-8", "replace")
                except OSError:
                    pass
            contents.append(content)
        yield pd.DataFrame({"root": pdf["root"], "path": pdf["path"], "content": contents})


def read_tree(spark: SparkSession, roots: dict[str, str], include_hidden: bool = False) -> DataFrame:
    """Every file below the directories of `{root: directory}`, empty, dot- and underscore-files included.

    Version-control directories, and hidden ones unless asked for, are not entered; linked directories neither. Files
    other than .md have no content read; one that can't be read has null content. Directories must be visible to all
    executors.
    """
    level = spark.createDataFrame([(r, top, "") for r, top in roots.items()], "root string, top string, path string")
    found = []
    while True:  # a round lists one level of all trees, in tasks
        listed = cut(level.repartition(spark.sparkContext.defaultParallelism, "root", "path").mapInPandas(lambda b: _list(b, include_hidden), LISTED))
        found.append(listed.where("NOT directory"))
        level = listed.where("directory").select("root", "top", "path")
        if level.isEmpty():
            break
    files = reduce(DataFrame.union, found)
    total = files.agg(F.sum(F.col("size") + FILE_BYTES)).first()[0] or 0
    return files.select("root", "top", "path").repartition(max(1, -(-total // TASK_BYTES)), F.xxhash64("root", "path")).mapInPandas(_read, FILES)


def read_log_blocks(spark: SparkSession, root: str, top: str, block_bytes: int = 1 << 20) -> DataFrame:
    """(root, source, block, text) of every log.md below the directory `top`, read by splits, so that a log may be larger than a task.

    Blocks are runs of whole lines of about `block_bytes`; their numbers ascend within a log. Front matter that ends within the
    first block is left out.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "log.md").option("lineSep", "\n").text(top)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))

    def blocks(batches):
        held, size, at, n = [], 0, None, 0
        row = lambda: pd.DataFrame({"file": [at[0]], "block": [at[1] + n], "text": ["\n".join(held)]})
        for pdf in batches:
            for file, start, line in pdf.itertuples(index=False, name=None):
                if at is not None and (at != (file, start) or size >= block_bytes):
                    yield row()
                    n = n + 1 if at == (file, start) else 0
                    held, size = [], 0
                at = (file, start)
                held.append(line)
                size += len(line) + 1
        if at is not None:
            yield row()

    # a block has a byte at least, so a split's blocks, numbered from where it starts, end before the next one's
    found = lines.mapInPandas(blocks, "file string, block long, text string")
    above = re.sub(r"^[a-z]+:/+|^/+|/+$", "", top)
    # the path comes as a URI, in which a plus is one
    source = F.substring_index(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))), f"/{above}/", -1)
    found = found.select(F.lit(root).alias("root"), source.alias("source"), "block", F.when(F.col("block") == 0, F.concat("text", F.lit("\n"))).otherwise(F.col("text")).alias("content"))
    return split_frontmatter(found).select("root", "source", "block", F.when(F.col("block") == 0, F.regexp_replace("body", r"\n\z", "")).otherwise(F.col("body")).alias("text"))
