"""Conformance checks. Codes and messages are fixed text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, quoted, trim_all
from .classify import RESERVED, is_conformant

# The type names known when a caller gives none.
DEFAULT_KNOWN_TYPES = ("Architecture", "Playbook", "Configuration", "API Reference", "Metrics Reference", "Log")
SEVERITY = {"E": "error", "W": "warning", "N": "notification"}


def _finding(when: Column, code: str, message: Column | str) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(SEVERITY[code[0]]).alias("severity"), message.alias("message")))


def _findings(rows: DataFrame, checks: list[Column]) -> DataFrame:
    found = rows.select("root", F.col("path").alias("file"), F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("f"))
    return found.select("root", "file", "f.code", "f.severity", F.lit(None).cast("int").alias("line"), "f.message")


def validate_docs(rows: DataFrame, known_types: list[str] | None = None) -> DataFrame:
    """Findings about documents: E0, E1 and E2 stop the checks; W1-W4 and N1 are independent."""
    readable, block = F.col("readable"), F.col("has_frontmatter")
    broken = F.col("yaml_error").isNotNull()
    good = readable & block & ~broken & (F.col("type") != "")
    n = F.size(F.coalesce("tags", F.array().cast("array<string>")))
    checks = [
        _finding(~readable, "E0", "read error: file can't be read"),
        _finding(readable & ~block, "E1", "missing YAML frontmatter (file must start with ---)"),
        _finding(readable & block & broken, "E2", F.concat(F.lit("invalid YAML frontmatter: "), "yaml_error")),
        _finding(readable & block & ~broken & (F.col("type") == ""), "E2", "empty or missing type field in frontmatter"),
        _finding(good & (F.col("title") == ""), "W1", "missing title in frontmatter"),
        _finding(good & (F.col("description") == ""), "W2", "missing description in frontmatter"),
        _finding(good & (n == 0), "W4", "no tags in frontmatter"),
        _finding(good & (n == 1), "N1", F.concat(F.lit("only one tag "), quoted(F.get("tags", F.lit(0))), F.lit(" — collections typically have multiple tags"))),
    ]
    if known_types:
        unknown = good & ~F.col("type").isin(*known_types)
        checks.append(_finding(unknown, "W3", F.concat(F.lit("unknown type "), quoted(F.col("type")), F.lit(" (not in known vocabulary)"))))
    return _findings(rows, checks)


def validate_reserved(rows: DataFrame) -> DataFrame:
    """Findings about index.md and log.md."""
    index, log = basename(F.col("path")) == "index.md", basename(F.col("path")) == "log.md"
    readable, block, broken = F.col("readable"), F.col("has_frontmatter"), F.col("yaml_error").isNotNull()
    good = log & readable & block & ~broken & (F.col("type") == "Log")
    dates = F.filter(F.transform(F.split("body", "\n"), trim_all), lambda x: x.rlike(r"\A## [0-9]{4}-[0-9]{2}-[0-9]{2}\z"))
    checks = [
        _finding(~readable, "E0", "read error: file can't be read"),
        _finding(index & readable & block, "E3", "index.md must not have frontmatter"),
        _finding(log & readable & ~block, "E3", "log.md must have frontmatter with type: Log"),
        _finding(log & readable & block & broken, "E3", "log.md has invalid YAML frontmatter"),
        _finding(log & readable & block & ~broken & (F.col("type") != "Log"), "E3", F.concat(F.lit('log.md type must be "Log", got '), quoted(F.col("type")))),
        _finding(good & ~F.contains("body", F.lit("](/")), "N2", "log.md has no bundle-relative cross-links"),
        _finding(good & (dates != F.sort_array(dates, asc=False)), "N3", "log.md date headings are not in reverse-chronological order"),
    ]
    return _findings(rows, checks)


def validate_bundle(parsed: DataFrame) -> DataFrame:
    """Findings about catalogued documents and reserved files; the types known are the root's own, so none is unknown."""
    return validate_docs(parsed.where(is_conformant(parsed))).unionByName(validate_reserved(parsed.where("kind = 'reserved'")))


def validate_paths(files: DataFrame, paths: DataFrame, known_types: list[str] | None = None) -> DataFrame:
    """Findings about just the files named by `paths(root, path)`, whatever directory they are in; a missing one is E0."""
    from ..functions.frontmatter import decode_frontmatter, split_frontmatter

    rows = paths.select("root", "path").join(files.select("root", "path", "content"), ["root", "path"], "left")
    rows = rows.withColumn("kind", F.when(basename(F.col("path")).isin(*RESERVED), "reserved").otherwise("doc"))
    rows = decode_frontmatter(split_frontmatter(rows)).withColumn("readable", F.col("content").isNotNull()).drop("content")
    return validate_docs(rows.where("kind = 'doc'"), known_types).unionByName(validate_reserved(rows.where("kind = 'reserved'")))


def summarise(findings: DataFrame, checked: DataFrame) -> DataFrame:
    """(root, files, errors, warnings, notifications) for every root of `checked(root, files)`."""
    counts = findings.groupBy("root").agg(*[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in SEVERITY.values()])
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return checked.join(counts, "root", "left").select("root", "files", *[zero(f"{s}s") for s in SEVERITY.values()])


def bundle_files(parsed: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, files): how many files whole-bundle validation looks at in each root."""
    counted = parsed.where(is_conformant(parsed) | (F.col("kind") == "reserved")).groupBy("root").agg(F.count("*").alias("n"))
    return roots.select("root").distinct().join(counted, "root", "left").select("root", F.coalesce("n", F.lit(0)).alias("files"))


def gate(summary: DataFrame) -> DataFrame:
    """status 1 for roots with an error, else 0; warnings never fail."""
    return summary.withColumn("status", F.when(F.col("errors") > 0, 1).otherwise(0))


def report_lines(findings: DataFrame, summary: DataFrame) -> DataFrame:
    """(root, line): a line for each finding and one of totals for each root."""
    lines = findings.select("root", F.format_string("%s: [%s] %s: %s", "file", "code", "severity", "message").alias("report_line"))
    totals = summary.select("root", F.format_string("%d files: %d errors, %d warnings, %d notifications", "files", "errors", "warnings", "notifications").alias("report_line"))
    return lines.union(totals)
