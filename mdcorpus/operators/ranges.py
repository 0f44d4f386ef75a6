"""Places in an order that are worked out over sorted ranges, so that no task holds all rows of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut


def placed(rows: DataFrame, key: list[str], order: list[str], name: str) -> DataFrame:
    """`rows` with the column `name`: the place, from 0, among those of the same key by `order`."""
    by = [*key, *order]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    # numbers ascend within a partition, whose own number is in their upper bits
    ranged = cut(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)))
    pieces = ranged.groupBy(*key, "_range").agg(F.min("_at").alias("_start"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*key).orderBy("_range")) - F.col("_n")
    pieces = pieces.select(*key, "_range", (before - F.col("_start")).alias("_shift"))
    return ranged.join(pieces, [*key, "_range"]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")
