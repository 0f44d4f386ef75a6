"""Which files are documents, reserved or skipped; parsing what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frontmatter import decode_frontmatter, split_frontmatter
from ..functions.text import basename, segments
from ..sources.shared import cut

RESERVED = ("index.md", "log.md")
VERSION_CONTROL = (".git", ".hg", ".svn")


def classify(files: DataFrame, include_hidden: bool = False) -> DataFrame:
    """`files(root, path, content)` with kind (doc, reserved, skipped) and skip_reason (vcs, hidden, extension)."""
    parts = segments(F.col("path"))
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    base = basename(F.col("path"))
    vcs = F.arrays_overlap(dirs, F.array(*map(F.lit, VERSION_CONTROL)))
    hidden = F.lit(False) if include_hidden else F.exists(dirs, lambda s: s.startswith("."))
    reason = F.when(vcs, "vcs").when(hidden, "hidden").when(~base.isin(*RESERVED) & ~base.endswith(".md"), "extension")
    return files.withColumn("skip_reason", reason).withColumn("kind", F.when(reason.isNotNull(), "skipped").when(base.isin(*RESERVED), "reserved").otherwise("doc"))


def parse(files: DataFrame, include_hidden: bool = False) -> DataFrame:
    """Classified files that are not skipped, split and decoded; `readable` is false where content is null."""
    kept = classify(files, include_hidden).where("kind <> 'skipped'").select("root", "path", "content", "kind")
    return decode_frontmatter(split_frontmatter(kept)).withColumn("readable", F.col("content").isNotNull()).drop("content")


def parse_once(files: DataFrame, include_hidden: bool = False) -> DataFrame:
    """`parse`, worked out once and written to the shared folder for all that reads it, without the bodies of documents."""
    body = F.when(F.col("kind") == "reserved", F.col("body"))
    return cut(parse(files, include_hidden).withColumn("body", body).drop("yaml_block"))


def is_conformant(parsed: DataFrame):
    return (F.col("kind") == "doc") & F.col("readable") & F.col("has_frontmatter") & F.col("yaml_error").isNull() & (F.col("type") != "")


def skip_report(parsed: DataFrame) -> DataFrame:
    """Documents that don't make the catalog, and why: (root, path, reason, detail)."""
    reason = (
        F.when(~F.col("readable"), "unreadable").when(~F.col("has_frontmatter"), "no_frontmatter")
        .when(F.col("yaml_error").isNotNull(), "invalid_yaml").when(F.col("type") == "", "missing_type")
    )
    docs = parsed.where("kind = 'doc'").select("root", "path", reason.alias("reason"), F.coalesce("yaml_error", F.lit("")).alias("detail"))
    return docs.where("reason IS NOT NULL")


def documents(parsed: DataFrame) -> DataFrame:
    """Conformant documents."""
    return parsed.where(is_conformant(parsed)).select("root", "path", "title", "description", "type", "tags", "body_offset")


def ingest_warnings(parsed: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, path, message) for conformant documents without title or description, undecodable ones and empty roots."""
    ok = is_conformant(parsed)
    messages = F.array(
        F.when(ok & (F.col("title") == ""), F.lit("missing title")),
        F.when(ok & (F.col("description") == ""), F.lit("missing description")),
        F.when((F.col("kind") == "doc") & F.col("yaml_error").isNotNull(), F.concat(F.lit("skipping "), "path", F.lit(": "), "yaml_error")),
        F.when((F.col("kind") == "doc") & ~F.col("readable"), F.concat(F.lit("skipping "), "path", F.lit(": read error"))),
    )
    own = parsed.select("root", "path", F.explode(F.filter(messages, lambda m: m.isNotNull())).alias("message"))
    empty = roots.select("root").distinct().join(documents(parsed).select("root"), "root", "left_anti")
    return own.union(empty.select("root", F.lit("").alias("path"), F.lit("no conformant docs").alias("message")))
