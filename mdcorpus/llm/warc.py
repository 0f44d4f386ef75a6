"""WARC archives: writing records, and reading them back along verified record boundaries.

Archives are written by Spark's text writer, one record a row, the record end as the line separator; they are gzipped
and hold a bounded number of records each. Offsets are those of the unpacked archive. The reader cuts
files at the magic; every piece is a candidate record that names the offset of its successor. The magic may occur
inside payloads, so pointers are followed from the start of each file, doubling their reach each round, and only
records reached are kept.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, shared_dir

MAGIC = "WARC/1.1\r\n"
RECORD_END = "\r\n\r\n"
#: Payloads below this many bytes are always stored in full.
REVISIT_BYTES = 1000
RECORDS_PER_FILE = 4096


def with_references(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, html) -> also payload_bytes, payload_digest, record_type and refers_to."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "html", F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html).alias("payload_digest"))
    large = rows.where(F.col("payload_bytes") >= least).select("page_id", "payload_bytes", "payload_digest")
    firsts = large.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = large.join(firsts, ["payload_digest", "payload_bytes"]).where("coalesce(page_id < refers_to, refers_to IS NOT NULL)").select("page_id", "payload_digest", "refers_to").distinct()
    # joined by page and digest, not by digest: pages are dealt evenly even if a third of them are copies
    named = revisits.select(F.col("page_id").alias("p"), F.col("payload_digest").alias("d"), "refers_to")
    rows = rows.join(named, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("payload_digest") == F.col("d")), "left").drop("p", "d")
    return rows.withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def record(rows: DataFrame) -> Column:
    """The text of one record without its end; a revisit has no payload of its own."""
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    full = F.col("record_type") == "response"
    body = F.when(full, F.coalesce("html", F.lit(""))).otherwise("")
    return F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.col("record_type"), F.lit("\r\nWARC-Record-ID: "), urn(F.col("page_id")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(~full, F.concat(F.lit("\r\nWARC-Refers-To: "), urn(F.col("refers_to")))).otherwise(""),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(RECORD_END), body,
    )


def write_archives(pages: DataFrame, path: str, least: int = REVISIT_BYTES) -> None:
    rows = with_references(pages, least)
    rows.select(record(rows).alias("value")).write.option("lineSep", RECORD_END).option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").text(path)


def _header(name: str) -> Column:
    return F.nullif(F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def _payload(text: str, size: int) -> Column:
    """The payload within a text that starts behind the record's magic."""
    return F.expr(f"substring(cast({text} as binary), cast(body - at - {size} + 1 as int), cast(n as int))")


def records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The records on each file's boundary chain, without payloads, and all pieces of the files.

    Records: (file, at, row, body, n, record_type, page_id, digest, refers_to, whole, bytes, sha1). `whole` says that the
    record's own piece holds its payload; then bytes and sha1 are of that payload, taken while the piece was read.
    """
    size = len(MAGIC)
    pieces = spark.read.option("lineSep", MAGIC).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.octet_length("value").alias("length")
    )
    head = F.substring_index("value", RECORD_END, 1)
    heads = pieces.withColumn("head", F.when(F.contains("value", F.lit(RECORD_END)), head))
    # as if the piece lay at offset 0: body and n need no more than the piece
    heads = heads.withColumns({"at": F.lit(0), "body": F.octet_length("head") + len(RECORD_END) + size, "n": _header("Content-Length").try_cast("long")})
    heads = heads.withColumn("payload", F.when((F.col("n") >= 0) & (size + F.col("length") - F.col("body") >= F.col("n")), _payload("value", size)))
    heads = cut(heads.select("file", "block", "row", "length", "head", "body", "n", F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha1")))
    # before a piece come the earlier blocks of its file and the earlier pieces of its block
    in_block = Window.partitionBy("file", "block").orderBy("row")
    blocks = heads.groupBy("file", "block").agg(F.sum(F.col("length") + size).alias("total")).withColumn("before", F.sum("total").over(Window.partitionBy("file").orderBy("block")) - F.col("total"))
    placed = heads.withColumn("inside", F.sum(F.col("length") + size).over(in_block) - (F.col("length") + size)).join(blocks.select("file", "block", "before"), ["file", "block"])
    # a piece starts behind its magic; the first of a file stands for what lies before the first magic
    placed = cut(placed.withColumn("at", F.col("before") + F.col("inside") - size).drop("before", "inside"))
    found = placed.where("head IS NOT NULL AND n >= 0 AND at >= 0").withColumn("body", F.col("body") + F.col("at")).withColumn("next", F.col("body") + F.col("n") + len(RECORD_END))
    page = lambda c: F.regexp_extract(c, r"<urn:page:(.*)>", 1).try_cast("long")
    found = found.join(chain(found.select("file", "block", "at", "next")), ["file", "at"]).select(
        "file", "at", "row", "body", "n", _header("WARC-Type").alias("record_type"), page(_header("WARC-Record-ID")).alias("page_id"), F.regexp_extract(_header("WARC-Payload-Digest"), r"^sha1:(.*)$", 1).alias("digest"),
        page(_header("WARC-Refers-To")).alias("refers_to"), F.col("bytes").isNotNull().alias("whole"), "bytes", "sha1",
    )
    return cut(found), pieces.select("row", "value").join(placed.select("row", F.col("file").alias("piece_file"), F.col("at").alias("piece_at")), "row")


def chain(links: DataFrame) -> DataFrame:
    """(file, at) of the candidates that are reached from offset 0 of their file by `links(file, block, at, next)`.

    Candidates that follow one another in a block are one run, unless another candidate points among them; pointers
    are followed from run to run.
    """
    order = Window.partitionBy("file", "block").orderBy("at")
    links = links.withColumns({"follows": F.coalesce(F.lag("next").over(order) == F.col("at"), F.lit(False)), "leads": F.coalesce(F.lead("at").over(order) == F.col("next"), F.lit(False))})
    targets = links.where("NOT leads").select("file", F.col("next").alias("at")).distinct().withColumn("target", F.lit(True))
    links = links.join(targets, ["file", "at"], "left")
    links = cut(links.withColumn("run", F.count_if(~F.col("follows") | F.col("target").isNotNull()).over(order)))
    runs = links.groupBy("file", "block", "run").agg(F.min("at").alias("head"), F.max_by("next", "at").alias("next"))
    runs = cut(runs)
    seen = _reached(runs.select("file", F.col("head").alias("at"), "next")).withColumnRenamed("at", "head")
    return links.join(runs.select("file", "block", "run", "head"), ["file", "block", "run"]).join(seen, ["file", "head"]).select("file", "at")


def _cut_up(found: DataFrame, pieces: DataFrame, placed_bytes: int) -> DataFrame:
    """(file, at, payload) of the records whose payload holds the magic: their pieces put together again."""
    wanted = found.where("NOT whole").select(F.col("file").alias("f"), F.col("at").alias("from"), (F.col("body") + F.col("n")).alias("to"), "body", "n")
    inside = (F.col("f") == F.col("piece_file")) & (F.col("piece_at") >= F.col("from")) & (F.col("piece_at") < F.col("to"))
    wanted = F.broadcast(wanted) if wanted.count() <= placed_bytes else wanted
    parts = pieces.join(wanted, inside).groupBy("f", "from", "body", "n").agg(F.array_sort(F.collect_list(F.struct("piece_at", "value"))).alias("parts"))
    text = parts.select(F.col("f").alias("file"), F.col("from").alias("at"), "body", "n", F.array_join(F.transform("parts", lambda p: p["value"]), MAGIC).alias("text"))
    return text.select("file", "at", _payload("text", len(MAGIC)).alias("payload"))


#: So many records with the magic in their payload may be broadcast (a few dozen bytes each); more are joined.
BROADCAST_ROWS = 50_000


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, record_type, page_id, digest, refers_to, payload) of the records on each file's boundary chain.

    Bytes before a file's first magic, pieces without a whole header, and all that the chain does not reach are no
    records; a chain ends where its next record is missing; a record that is cut off has what there is of its payload.
    An empty folder gives an empty result.
    """
    found, pieces = records(spark, path)
    columns = [F.col("file"), F.col("at").alias("offset"), "record_type", "page_id", "digest", "refers_to", "payload"]
    whole = found.where("whole").join(pieces.select("row", "value"), "row").withColumn("payload", _payload("value", len(MAGIC)))
    rest = found.where("NOT whole").join(_cut_up(found, pieces, BROADCAST_ROWS), ["file", "at"])
    return whole.select(*columns).union(rest.select(*columns))


def _reached(links: DataFrame) -> DataFrame:
    """(file, at) on the chain of `next` offsets from offset 0 of each file, by pointer jumping."""
    jump, ends = links, links.select("file", "at")
    seen = cut(links.where("at = 0").select("file", "at"))
    count = seen.count()
    while True:
        step = jump.join(seen, ["file", "at"]).select("file", F.col("next").alias("at"))
        more = cut(seen.union(step.join(ends, ["file", "at"], "left_semi")).distinct())
        n = more.count()
        if n == count:
            return more
        seen, count = more, n
        on = jump.select("file", F.col("at").alias("next"), F.col("next").alias("far"))
        jump = cut(jump.join(on, ["file", "next"]).select("file", "at", F.col("far").alias("next")))


def round_trip(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Write `pages(page_id, html)` as archives to the shared folder and say what reading them back gives, page by page.

    (page_id, payload_bytes, payload_digest, record_type, refers_to). Null html is an empty payload. Of equal payloads
    of at least `least` bytes the one with the largest page_id is a response and the others revisit it; rows that share
    that page_id are all responses, and rows with a null page_id revisit any row with an id. Other columns are ignored.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid4().hex}"
    write_archives(pages, path, least)
    found, pieces = records(spark, path)
    columns = ["page_id", "record_type", "digest", "refers_to", "bytes", "sha1"]
    back = found.where("whole").select(columns)
    if not found.where("NOT whole").isEmpty():
        rest = found.where("NOT whole").drop("bytes", "sha1").join(_cut_up(found, pieces, BROADCAST_ROWS), ["file", "at"])
        back = back.union(rest.withColumns({"bytes": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload")}).select(columns))
    full = back.where("record_type = 'response'").groupBy(F.col("page_id").alias("r"), F.col("sha1").alias("s")).agg(F.max("bytes").alias("b"))
    revisits = back.where("record_type = 'revisit'").join(full, (F.col("refers_to") == F.col("r")) & (F.col("digest") == F.col("s")), "left")
    first = back.where("record_type = 'response'").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", "refers_to")
    return first.union(revisits.select("page_id", F.col("b").alias("payload_bytes"), F.col("s").alias("payload_digest"), "record_type", "refers_to"))
