"""Connected components of a graph given as edges, by contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """`edges(a, b)` of longs -> `(id, component)` for every id in an edge between two ids; component: the least id reachable.

    Each round points every node at its least neighbour, follows pointers twice, and contracts the edges, so a
    component of n nodes takes about log n rounds. Null ends, loops and repeated edges are ignored.
    """
    e = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    maps = []
    while not e.isEmpty():
        both = e.union(e.select("b", "a"))
        up = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("up"))
        for _ in range(2):
            up = up.join(up.select(F.col("id").alias("up"), F.col("up").alias("top")), "up").select("id", F.col("top").alias("up"))
        up = cut(up)
        maps.append(up)
        left = up.select(F.col("id").alias("a"), F.col("up").alias("x"))
        right = up.select(F.col("id").alias("b"), F.col("up").alias("y"))
        e = e.join(left, "a").join(right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        e = cut(e.where("a <> b").distinct())
    if not maps:
        return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = maps[0]
    for m in maps[1:]:
        m = m.select(F.col("id").alias("up"), F.col("up").alias("top"))
        out = out.join(m, "up", "left").select("id", F.coalesce("top", "up").alias("up"))
    return out.withColumnRenamed("up", "component")
