"""Keeping a catalog of documents up to date while files keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.classify import documents, parse
from ..schemas import FILES


def documents_stream(spark: SparkSession, folder: str, include_hidden: bool = False) -> DataFrame:
    """Conformant documents of the files(root, path, content) that land as Parquet in `folder`; no state is kept."""
    return documents(parse(spark.readStream.schema(FILES).parquet(folder), include_hidden))


def start_catalog(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the documents to Parquet, exactly once, taking what is there and stopping."""
    return docs.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
