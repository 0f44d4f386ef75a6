"""Change logs: parsing, merging, filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename, trim_all

# The forms of a date heading and of an entry.
HEADING = r"\A## ([0-9]{4}-[0-9]{2}-[0-9]{2})(?:\n|\z)"
SECTION = r"(?:\A|\n)(?=## [0-9]{4}-[0-9]{2}-[0-9]{2}(?:\n|\z))"
ENTRY = r"\*\*\w+\*\*:[\t\f\r ]*`[^`\n]+`[\t\f\r ]*—[\t\f\r ]*[^\n]+"
ENTRY_FIELDS = r"\A\*\*(\w+)\*\*:[\t\f\r ]*`([^`\n]+)`[\t\f\r ]*—[\t\f\r ]*([^\n]+)"

#: Characters of a block of lines, and more sections than a block can hold.
BLOCK_CHARS, SECTIONS = 1 << 20, 1 << 32


def log_bodies(parsed: DataFrame) -> DataFrame:
    """(root, source, body) of every log.md."""
    return parsed.where((F.col("kind") == "reserved") & (basename(F.col("path")) == "log.md")).select("root", F.col("path").alias("source"), "body")


def parse_log(bodies: DataFrame) -> DataFrame:
    """(root, source, sec_pos, ent_pos, date, action, target, detail), one row an entry, without a shuffle.

    Lines behind an entry's first are trimmed and added to its detail; what comes before a first heading, or between a
    heading and its first entry, is dropped.
    """
    sections = bodies.select("root", "source", F.posexplode(F.split("body", SECTION)).alias("sec_pos", "section"))
    sections = sections.where(F.col("section").rlike(HEADING)).withColumn("date", F.regexp_extract("section", HEADING, 1))
    entries = sections.select("root", "source", "sec_pos", "date", F.posexplode(F.split("section", rf"\n(?={ENTRY})")).alias("ent_pos", "entry")).where("ent_pos > 0")
    lines = F.split("entry", "\n")
    rest = F.filter(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), trim_all), lambda x: x != "")
    first = trim_all(F.regexp_extract("entry", ENTRY_FIELDS, 3))
    detail = F.array_join(F.concat(F.filter(F.array(first), lambda x: x != ""), rest), "\n")
    return entries.select("root", "source", "sec_pos", "ent_pos", "date", F.regexp_extract("entry", ENTRY_FIELDS, 1).alias("action"), F.regexp_extract("entry", ENTRY_FIELDS, 2).alias("target"), detail.alias("detail"))


def cut_lines(bodies: DataFrame, size: int = BLOCK_CHARS) -> DataFrame:
    """`bodies(root, source, body)` as (root, source, block, text): runs of whole lines of `size` characters or little more.

    The blocks of a body, joined by line ends, are the body.
    """
    pattern = rf"(?s).{{0,{max(1, size) - 1}}}[^\n]*(?:\n|\z)"
    found = bodies.select("root", "source", F.posexplode(F.regexp_extract_all("body", F.lit(pattern), 0)).alias("block", "text"))
    return found.where("text <> ''").select("root", "source", F.col("block").cast("long").alias("block"), F.regexp_replace("text", r"\n\z", "").alias("text"))


def parse_log_blocks(blocks: DataFrame) -> DataFrame:
    """What parse_log gives of logs that no task could hold, from `blocks(root, source, block, text)` of consecutive lines.

    A block is parsed by itself, and says which heading and which entry are open where it ends. A pass over these short
    statements, one a block, hands them on. Only what stands before a block's first heading waits for that, and only entries that reach
    a block's end or begin before it are put together. sec_pos and ent_pos ascend as in the log.
    """
    key, by_block = ["root", "source"], Window.partitionBy("root", "source").orderBy("block")
    sections = blocks.select(*key, "block", F.posexplode(F.split("text", SECTION)).alias("n", "section"))
    dated = F.col("section").rlike(HEADING)
    sections = sections.select(*key, "block", "n", "section", F.when(dated, F.regexp_extract("section", HEADING, 1)).alias("date"))
    # an entry may be the first line of what stands before a heading
    rows = sections.select(*key, "block", "n", "date", F.posexplode(F.split("section", rf"(?:\A|\n)(?={ENTRY})")).alias("m", "entry"))
    begins = F.col("entry").rlike(rf"\A{ENTRY}")
    rows = rows.withColumn("begins", begins).where(F.col("begins") | F.col("date").isNull()).withColumns({
        "sec_pos": F.col("block") * SECTIONS + F.col("n"), "ent_pos": F.col("m"), "last": F.struct("n", "m"),
    })
    # which heading and entry are open behind a block; null: those that were open before
    own = F.when(F.col("begins"), F.struct("sec_pos", "ent_pos"))
    state = rows.groupBy(*key, "block").agg(F.max(F.when(F.col("begins"), F.struct("n", "m", own.alias("open")))).alias("entry"))
    heads = sections.where(F.col("date").isNotNull()).groupBy(*key, "block").agg(F.max(F.struct("n", "date")).alias("head"))
    state = state.join(heads, [*key, "block"], "full")
    # an entry counts if no heading comes behind it
    none = F.lit(None).cast("struct<sec_pos:bigint,ent_pos:int>")
    entry = F.when(F.col("head").isNull() | (F.col("entry.n") >= F.col("head.n")), F.col("entry.open")).otherwise(none)
    state = state.select(*key, "block", F.col("head.date").alias("date_after"), F.when(F.col("head").isNotNull() | F.col("entry").isNotNull(), F.struct(entry.alias("open"))).alias("open_after"))
    marks = blocks.select(*key, "block").join(state, [*key, "block"], "left")
    before = by_block.rowsBetween(Window.unboundedPreceding, -1)
    handed = marks.select(*key, "block", F.last("date_after", ignorenulls=True).over(before).alias("date_before"), F.last("open_after", ignorenulls=True).over(before).alias("open_before"))

    lines = F.split("entry", "\n")
    rest = lambda a: F.filter(F.transform(a, trim_all), lambda x: x != "")
    first = F.filter(F.array(trim_all(F.regexp_extract("entry", ENTRY_FIELDS, 3))), lambda x: x != "")
    shown = F.when(F.col("begins"), F.concat(first, rest(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))))).otherwise(rest(lines))
    field = lambda n: F.when(F.col("begins"), F.regexp_extract("entry", ENTRY_FIELDS, n))
    rows = rows.select(*key, "block", "n", "m", "begins", "date", "sec_pos", "ent_pos", field(1).alias("action"), field(2).alias("target"), shown.alias("lines"))
    # a block's last piece may go on; what is before its first heading belongs to what is open
    ends = rows.groupBy(*key, "block").agg(F.max(F.struct("n", "m")).alias("end"))
    fields = ["sec_pos", "ent_pos", "date", "action", "target"]
    rows = rows.join(ends, [*key, "block"]).withColumn("cut", (F.col("date").isNull()) | (F.struct("n", "m") == F.col("end")))
    whole = rows.where("NOT cut").select(*key, *fields, F.array_join("lines", "\n").alias("detail"))
    pieces = rows.where("cut").join(handed, [*key, "block"])
    pieces = pieces.withColumn("open", F.when(F.col("begins"), F.struct("sec_pos", "ent_pos")).otherwise(F.col("open_before.open"))).where("open IS NOT NULL")
    pieces = pieces.withColumn("date", F.when(F.col("begins"), F.coalesce("date", "date_before")))
    joined = pieces.groupBy(*key, "open").agg(
        F.max("date").alias("date"), F.max("action").alias("action"), F.max("target").alias("target"), F.array_sort(F.collect_list(F.struct("block", "n", "m", "lines"))).alias("parts"),
    ).where("date IS NOT NULL")
    joined = joined.select(*key, "open.sec_pos", "open.ent_pos", "date", "action", "target", F.array_join(F.flatten(F.transform("parts", lambda x: x["lines"])), "\n").alias("detail"))
    return whole.union(joined)


def log_block_checks(blocks: DataFrame) -> DataFrame:
    """(root, source, linked, ordered) of each log: whether some line holds a link into its tree, and whether date headings never ascend."""
    key, dates = ["root", "source"], F.filter(F.transform(F.split("text", "\n"), trim_all), lambda x: x.rlike(r"\A## [0-9]{4}-[0-9]{2}-[0-9]{2}\z"))
    each = blocks.select(*key, "block", F.contains("text", F.lit("](/")).alias("linked"), dates.alias("dates"))
    each = each.select(*key, "block", "linked", (F.col("dates") == F.sort_array("dates", asc=False)).alias("ordered"), F.get("dates", F.lit(0)).alias("first"), F.get("dates", F.size("dates") - 1).alias("last"))
    before = F.last("last", ignorenulls=True).over(Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("ordered", F.col("ordered") & F.coalesce(before >= F.col("first"), F.lit(True)))
    return each.groupBy(*key).agg(F.bool_or("linked").alias("linked"), F.bool_and("ordered").alias("ordered"))


def get_log(entries: DataFrame, since: str | None = None, action: str | None = None, limit: float | None = None, per_root: bool = False) -> DataFrame:
    """Entries newest first, then by source and place; dates are compared as text, filters come before the sort.

    A limit, of all entries or of each root's, is cut to a whole number; none, zero and less mean all.
    """
    rows = entries if not since else entries.where(F.col("date") >= since)
    rows = rows if not action else rows.where(F.col("action") == action)
    order = [F.col("date").desc(), "source", "root", "sec_pos", "ent_pos"]
    most = int(limit) if limit is not None else 0
    if most > 0 and per_root:
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy(*order))).where(F.col("place") <= most).drop("place")
    rows = rows.orderBy(*order)
    return rows.limit(most) if most > 0 and not per_root else rows


def log_notes(bodies: DataFrame, entries: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, note) for roots without a log, for those with a log that holds text but no entry, and for each log that can't be read."""
    missing = roots.select("root").distinct().join(bodies.select("root"), "root", "left_anti").select("root", F.lit("no log.md found").alias("note"))
    filled = bodies.where(trim_all(F.col("body")) != "").select("root", "source")
    malformed = filled.join(entries.select("root", "source"), ["root", "source"], "left_anti").select("root").distinct()
    unread = bodies.where("body IS NULL").select("root", F.concat(F.lit("failed to read "), "source").alias("note"))
    return missing.union(malformed.select("root", F.lit("log.md has malformed entries").alias("note"))).union(unread)
