"""Writing results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, segments
from ..operators.classify import RESERVED
from ..operators.ranges import placed

#: Codes of findings in the order in which they are checked.
CODES = ("E0", "E1", "E2", "E3", "W1", "W2", "W3", "W4", "N1", "N2", "N3")
OMIT_EMPTY = ("detail", "note", "doc_type", "title", "bundle", "line")


def json_value(value: Column) -> Column:
    """A value as JSON, a null one too."""
    inner = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.substring(inner, F.lit(2), F.length(inner) - 2)


def json_object(fields: dict[str, Column], omit_empty: tuple[str, ...] = ()) -> Column:
    """A JSON object; fields named in `omit_empty` are left out where they are null, '' or 0, other nulls stay."""

    def field(name: str, value: Column) -> Column:
        piece = F.concat(F.lit(f'"{name}":'), json_value(value))
        return F.when(F.coalesce(value.cast("string"), F.lit("")).isin("", "0"), F.lit(None)).otherwise(piece) if name in omit_empty else piece

    pieces = F.filter(F.array(*[field(n, v) for n, v in fields.items()]), lambda x: x.isNotNull())
    return F.concat(F.lit("{"), F.array_join(pieces, ","), F.lit("}"))


def json_rows(df: DataFrame, omit_empty: tuple[str, ...] = ()) -> DataFrame:
    """One column `value` of JSON objects; see json_object."""
    return df.select(json_object({c: F.col(c) for c in df.columns}, omit_empty).alias("value"))


def json_lists(items: DataFrame, order: list, ends: DataFrame) -> DataFrame:
    """(root, seq, piece): the pieces that, in order, are one JSON text for each root of `ends(root, head, tail)`.

    Between head and tail stand the root's `items(root, item)`, in `order`, with commas between them. They are numbered over ranges, so no
    task holds a root's list.
    """
    at = placed(items, ["root"], order, "place").select("root", "place", "item")
    listed = at.select("root", (F.col("place") + 1).alias("seq"), F.concat(F.when(F.col("place") > 0, ",").otherwise(""), "item").alias("piece"))
    counts = at.groupBy("root").agg(F.count("*").alias("n"))
    outer = ends.join(counts, "root", "left").select("root", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("seq"), F.col("head").alias("piece")), F.struct((F.coalesce("n", F.lit(0)) + 1).alias("seq"), F.col("tail").alias("piece")))).alias("e"))
    return listed.union(outer.select("root", "e.seq", "e.piece"))


def json_tags(tags: DataFrame, roots: DataFrame) -> DataFrame:
    """The list of tags of each of `roots`, from `tags(root, tag)`, as pieces."""
    ends = roots.select("root", F.lit("[").alias("head"), F.lit("]").alias("tail")).distinct()
    return json_lists(tags.select("root", "tag", json_value(F.col("tag")).alias("item")), ["tag"], ends)


def json_validation(summary: DataFrame, findings: DataFrame) -> DataFrame:
    """Summary and findings of each root, as pieces: documents in the order of a walk, then reserved files."""
    counts = json_object({c.capitalize(): F.col(c) for c in ("files", "errors", "warnings", "notifications")})
    ends = summary.select("root", F.concat(F.lit('{"summary":'), counts, F.lit(',"findings":[')).alias("head"), F.lit("]}").alias("tail"))
    item = json_object({c: F.col(c) for c in ("code", "severity", "file", "line", "message")}, ("line",))
    own = findings.select("root", basename(F.col("file")).isin(*RESERVED).alias("last"), segments(F.col("file")).alias("walk"), F.array_position(F.array(*map(F.lit, CODES)), F.col("code")).alias("rank"), item.alias("item"))
    return json_lists(own, ["last", "walk", "rank"], ends)


def json_logs(entries: DataFrame, notes: DataFrame, roots: DataFrame) -> DataFrame:
    """Each root's entries, newest first, and beside them its note, if it has one, as pieces. Of several notes that of a log that can't be read counts."""
    first = notes.groupBy("root").agg(F.min_by("note", F.struct(~F.startswith("note", F.lit("failed to read ")), "note")).alias("note"))
    tail = F.concat(F.lit("]"), F.when(F.col("note").isNull(), "").otherwise(F.concat(F.lit(',"note":'), json_value(F.col("note")))), F.lit("}"))
    ends = roots.select("root").distinct().join(first, "root", "left").select("root", F.lit('{"entries":[').alias("head"), tail.alias("tail"))
    item = json_object({c: F.col(c) for c in ("date", "action", "target", "detail", "source")}, ("detail",))
    own = entries.select("root", "date", "source", "sec_pos", "ent_pos", item.alias("item"))
    return json_lists(own, [F.col("date").desc(), "source", "sec_pos", "ent_pos"], ends)


def json_answers(answers: DataFrame) -> DataFrame:
    """(query_id, failed, value): a found document as an object, else the message."""
    value = json_object({c: F.col(c) for c in ("bundle", "content", "description", "file_path", "tags", "title")})
    ok = F.col("status") == "ok"
    return answers.select("query_id", (~ok).alias("failed"), F.when(ok, value).otherwise(F.col("message")).alias("value"))


def write_json(df: DataFrame, path: str, omit_empty: tuple[str, ...] = ()) -> None:
    json_rows(df, omit_empty).write.mode("overwrite").text(path)


def write_pieces(pieces: DataFrame, path: str) -> None:
    """`pieces(root, seq, piece)` as text: the files' lines, in the order of their names, are the roots' JSON objects one after the other."""
    pieces.orderBy("root", "seq").select("piece").write.mode("overwrite").text(path)


def write_catalog(tables: dict[str, DataFrame], path: str, buckets: int = 64) -> None:
    """Catalog tables as Parquet below `path`, each partitioned by a hash of root (roots may be many, or one be huge)."""
    for name, df in tables.items():
        df.withColumn("root_bucket", F.pmod(F.xxhash64("root"), F.lit(buckets))).write.mode("overwrite").partitionBy("root_bucket").parquet(f"{path}/{name}")
