"""The catalog: documents and reserved files with their bundles, tags and types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, dirname, prefixes, segments


def reserved_files(parsed: DataFrame) -> DataFrame:
    """(root, path, has_frontmatter, type): type is '' if absent or undecodable."""
    return parsed.where("kind = 'reserved'").select("root", "path", "has_frontmatter", F.when(F.col("yaml_error").isNull(), F.coalesce("type", F.lit(""))).otherwise("").alias("type"))


def resolve_bundles(files: DataFrame, reserved: DataFrame) -> DataFrame:
    """`files` with bundle: the nearest directory at or above a file's own that holds an index.md, else its own.

    Directories, not files, are joined: each distinct one with all those above it, on equality.
    """
    index_dirs = reserved.where(basename(F.col("path")) == "index.md").select("root", dirname(F.col("path")).alias("up")).distinct()
    own = files.withColumn("dir", dirname(F.col("path")))
    ups = own.select("root", "dir").distinct().select("root", "dir", F.posexplode(prefixes(F.concat("dir", F.lit("/x")))).alias("far", "up"))
    ups = ups.where("NOT (dir = '.' AND far > 0)")
    nearest = ups.join(index_dirs, ["root", "up"]).groupBy("root", "dir").agg(F.min_by("up", "far").alias("bundle"))
    return own.join(nearest, ["root", "dir"], "left").withColumn("bundle", F.coalesce("bundle", "dir")).drop("dir")


def list_docs(docs: DataFrame) -> DataFrame:
    """What a listing shows of each document, in the order of a walk of its tree; `docs` have bundles."""
    rows = docs.select("root", "title", "description", "tags", F.col("path").alias("file_path"), "bundle")
    return rows.orderBy("root", segments(F.col("file_path")))


def list_tags(docs: DataFrame, per_root: bool = True) -> DataFrame:
    keys = ["root", "tag"] if per_root else ["tag"]
    return docs.select("root", F.explode("tags").alias("tag")).select(*keys).distinct().orderBy(*keys)


def type_vocabulary(docs: DataFrame) -> DataFrame:
    return docs.where("type <> ''").select("root", "type").distinct()
