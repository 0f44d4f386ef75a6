"""A catalog kept as bucketed tables, and answers from it that move none of them."""

from __future__ import annotations

import json
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search, validate
from ..operators.classify import is_conformant

#: What a table's rows are bucketed and sorted by; what is looked up by root alone is a row a root.
KEYS = {"docs": ("root", "path"), "bodies": ("root", "path"), "reserved": ("root", "path"), "tree": ("root", "path"), "findings": ("root", "path"), "log_entries": ("root", "path"), "checked": ("root",), "severities": ("root",)}
BUCKETS = 64


def bodies_of(parsed: DataFrame) -> DataFrame:
    """(root, path, body) of conformant documents; `parsed` with bodies."""
    return parsed.where(is_conformant(parsed)).select("root", "path", "body")


def severities_of(findings: DataFrame) -> DataFrame:
    """(root, errors, warnings, notifications) of the roots with findings."""
    return findings.groupBy("root").agg(*[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in validate.SEVERITY.values()])


def _table(path: str, name: str) -> str:
    """The name that a session knows a table of the catalog at `path` by."""
    return f"catalog_{md5(path.encode()).hexdigest()[:16]}_{name}"


class StoredCatalog:
    """Tables below a folder, each in the same number of buckets by (root, path) and sorted within, so that they join where they lie.

    A root's rows are spread over all buckets, however large it is.
    """

    def __init__(self, spark: SparkSession, path: str):
        """Opens what `write` left, in this session or an earlier one."""
        self.spark, self.path = spark, path.rstrip("/")
        about = json.loads("".join(r[0] for r in spark.read.text(f"{self.path}/about").collect()))
        for name, (columns, buckets) in about.items():
            keys = ", ".join(KEYS[name])
            location = f"{self.path}/{name}".replace("'", "\\'")
            spark.sql(f"CREATE TABLE IF NOT EXISTS {_table(self.path, name)} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{location}'")
        self.names = list(about)

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.table(_table(self.path, name))

    @staticmethod
    def write(tables: dict[str, DataFrame], path: str, buckets: int = BUCKETS) -> StoredCatalog:
        """Tables of KEYS (some or all) as files below `path`: a file a bucket, dealt by the hash that buckets go by."""
        path, spark, about = path.rstrip("/"), None, {}
        for name, df in tables.items():
            spark, keys, own = df.sparkSession, KEYS[name], _table(path, name)
            spark.sql(f"DROP TABLE IF EXISTS {own}")
            df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{path}/{name}").mode("overwrite").saveAsTable(own)
            about[name] = (", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), buckets)
        if spark is None:
            raise ValueError("no table to write")
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
        return StoredCatalog(spark, path)

    def get_doc(self, queries: DataFrame, strategy: str = "direct") -> DataFrame:
        """As search.get_doc; of the stored documents and bodies none is moved, only the winners' keys are."""
        return search.get_stored_doc(self["docs"], self["bodies"], queries, strategy)

    def tree(self) -> DataFrame:
        """The stored tree; leaves of documents with their description and tags."""
        own = self["docs"].select("root", "path", "description", "tags")
        return self["tree"].join(own, ["root", "path"], "left")

    def summary(self) -> DataFrame:
        """As validate.summarise, from a row a root of either table."""
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return self["checked"].join(self["severities"], "root", "left").select("root", "files", *[zero(f"{s}s") for s in validate.SEVERITY.values()])
