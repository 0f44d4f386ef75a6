"""What the operators of this subpackage share: shared folders, sizes, and dealing rows into chunks."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, shared_dir

__all__ = ["BATCH_BYTES", "SPACE", "WORD", "Scratch", "crc_mod", "cut", "first_by_hash", "fresh", "numbered", "release", "shared_dir", "small_batches", "table"]

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


class Scratch:
    """Intermediate tables in the shared folder: written whole, so that later steps survive lost executors, and deleted once
    nothing reads them; what lazy results still read goes with the application."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.top = spark, f"{shared_dir(spark)}/{name}-{uuid4().hex}"

    def save(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        writer = df.write.partitionBy(by) if by else df.write
        writer.parquet(f"{self.top}/{name}")
        system, path = self._system(self.top)
        system.deleteOnExit(path)
        return self.spark.read.schema(df.schema).parquet(f"{self.top}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            system, path = self._system(f"{self.top}/{name}")
            system.delete(path, True)

    def _system(self, name: str):
        """The file system of a folder, and its path."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path


#: Rows are handed to Python in batches of so many bytes at most, which two processes a task hold.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Have texts handed to Python in batches of BATCH_BYTES, where the session's are larger."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = (spark.conf.get(name, None) or "").lower().removesuffix("b")
    if not have.isdigit() or int(have) > BATCH_BYTES or int(have) <= 0:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def fresh(columns: list[str], name: str) -> str:
    """`name`, or a longer one, such that no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs`, written to the shared folder with a number for each row, and the name of that column."""
    row = fresh(docs.columns, "row")
    return Scratch(docs.sparkSession, "numbered").save(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps whose results are checkpointed."""
    import gc

    gc.collect()
    spark.range(1).count()  # a session holds on to its last query
    spark.sparkContext._jvm.System.gc()


def first_by_hash(rows: DataFrame, most: int) -> DataFrame:
    """Of `rows` with a hash `h` the distinct ones with the least hashes, `most` at most; all, if there are no more.

    Of many rows only those below a hash are sorted that lets pass a few more than `most`, so no task gets all.
    """
    rows = cut(rows)
    many = rows.agg(F.approx_count_distinct("h", 0.02)).first()[0]
    share = 1.1 * (most + 10 * most**0.5 + 100) / max(1, many)
    if share < 0.5:
        below = rows.where(F.col("h") < int(share * 2.0**64) - 2**63).distinct()
        if below.count() >= most:
            return below.orderBy("h", *rows.columns).limit(most)
    return rows.distinct().orderBy("h", *rows.columns).limit(most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n (null ids: of the empty text)."""
    column = F.col(column) if isinstance(column, str) else column
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(n))
