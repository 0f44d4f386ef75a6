"""Equality joins on keys of very different weight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this is dealt over several tasks.
HEAVY = 1_000_000
#: So many keys are dealt at most, so that their list can be broadcast; with more, the bound is raised.
MOST_HEAVY = 10_000


def degree_join(many: DataFrame, few: DataFrame, keys: list[str], heavy: int = HEAVY) -> DataFrame:
    """`many` joined with `few` on `keys`, without a task that gets much more than `heavy` rows of one key of `many`.

    Rows of a heavy key are dealt by a hash of the whole row; the rows of `few` that they meet are repeated for each part. The
    bound changes the plan, not the result.
    """
    degrees = many.groupBy(*keys).agg(F.count("*").alias("_n"))
    total, most = degrees.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    bound = max(heavy, total // MOST_HEAVY)
    if most <= bound:
        return many.join(few, keys)
    parts = F.broadcast(degrees.where(F.col("_n") > bound).select(*keys, F.ceil(F.col("_n") / bound).alias("_parts")))  # MOST_HEAVY rows
    part = F.coalesce(F.pmod(F.xxhash64(*many.columns), F.col("_parts")), F.lit(0))
    dealt = many.join(parts, keys, "left").withColumn("_part", part).drop("_parts")
    repeated = few.join(parts, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(repeated, [*keys, "_part"]).drop("_part")
