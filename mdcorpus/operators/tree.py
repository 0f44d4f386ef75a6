"""The directory tree as a flat table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import quoted, segments
from .ranges import placed

#: Stands behind every place among siblings.
BEHIND = 2**31 - 1
#: Numbers of nodes that a request for a subtree meets at a time.
SPAN = 1024


def build_tree(docs: DataFrame, reserved: DataFrame) -> DataFrame:
    """(root, path, parent_path, name, depth, node_type, doc_type, title, bundle, ord); the root's path is ''.

    ord is the place among siblings: documents in the order of a walk, then reserved files; a directory stands where
    its first leaf was put. Directories are reduced to one row before they are ordered; the order is worked out over ranges,
    so that no task holds a whole directory.
    """
    leaf = lambda df, kind, title: df.select("root", "path", F.lit(kind).alias("node_type"), F.col("type").alias("doc_type"), title.alias("title"), "bundle")
    leaves = leaf(docs, "file", F.col("title")).union(leaf(reserved, "reserved", F.lit(None).cast("string")))
    parts = segments(F.col("path"))
    leaves = leaves.withColumn("first", F.struct((F.col("node_type") == "reserved").alias("r"), parts.alias("s")))
    ups = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, "").otherwise(F.array_join(F.slice(parts, 1, n), "/")))
    dirs = leaves.select("root", F.explode(ups).alias("path"), "first").groupBy("root", "path").agg(F.min("first").alias("first"))
    none = F.lit(None).cast("string")
    nodes = leaves.unionByName(dirs.select("root", "path", F.lit("directory").alias("node_type"), none.alias("doc_type"), none.alias("title"), none.alias("bundle"), "first"))
    top = F.col("path") == ""
    nodes = nodes.withColumns({
        "parent_path": F.when(~top, F.regexp_replace("path", r"/?[^/]*\z", "")),
        "name": F.when(top, ".").otherwise(F.element_at(parts, -1)),
        "depth": F.when(top, 0).otherwise(F.size(parts)),
    })
    return _placed(nodes).select("root", "path", "parent_path", "name", "depth", "node_type", "doc_type", "title", "bundle", "ord")


def _placed(nodes: DataFrame) -> DataFrame:
    """`nodes` with ord, their place by `first` among those of the same root and parent_path."""
    up = F.coalesce(F.concat(F.lit("/"), "parent_path"), F.lit(""))
    return placed(nodes.withColumn("up", up), ["root", "up"], ["first"], "place").withColumn("ord", (F.col("place") + 1).cast("int"))


def subtree(tree: DataFrame, path: str) -> DataFrame:
    """The node at just this path and all below; '' and '.' are the whole tree; no row means not found."""
    return tree if path in ("", ".") else tree.where((F.col("path") == path) | F.startswith("path", F.lit(path + "/")))


def _walks(tree: DataFrame) -> DataFrame:
    """`tree` with walk: the places among siblings of a node's ancestors and of itself, from the top down.

    Directories, not leaves, meet all that lie above them.
    """
    dirs = tree.where("node_type = 'directory' AND path <> ''").select("root", "path", "ord")
    parts = segments(F.col("path"))
    ups = dirs.select("root", "path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("level", "up"))
    above = ups.join(dirs.select("root", F.col("path").alias("up"), "ord"), ["root", "up"]).groupBy("root", "path").agg(F.array_sort(F.collect_list(F.struct("level", "ord"))).alias("s"))
    above = above.select("root", F.col("path").alias("parent_path"), F.transform("s", lambda x: x["ord"]).alias("above"))
    none = F.array().cast("array<int>")
    walk = F.when(F.col("path") == "", none).otherwise(F.concat(F.coalesce("above", none), F.array("ord")))
    return tree.join(above, ["root", "parent_path"], "left").withColumn("walk", walk).drop("above")


def tour(tree: DataFrame, *columns: str) -> DataFrame:
    """(root, opening, seq, `columns`): a walk round each tree that opens every node before what is in it and closes it after.

    seq, from 0, is the place in the walk of a root. Sorting is over ranges, so no task holds a root. Behind opening event number s
    of a node at depth d lie as many closings as openings but for d, so (s + d) / 2 nodes were opened before it.
    """
    walked = _walks(tree)
    ends = F.array(F.struct(F.lit(True).alias("opening"), F.col("walk").alias("at")), F.struct(F.lit(False).alias("opening"), F.concat("walk", F.array(F.lit(BEHIND))).alias("at")))
    events = walked.select("root", *[F.col(c) for c in columns], F.explode(ends).alias("e")).select("root", *columns, "e.opening", "e.at")
    return placed(events, ["root"], ["at"], "seq").select("root", "opening", "seq", *columns)


def nested_sets(tree: DataFrame) -> DataFrame:
    """`tree` with first and last: all in a node's subtree, and nothing else of its root, has a first from its first to its last."""
    events = tour(tree, "path", "depth")
    first = F.when(F.col("opening"), F.expr("(seq + depth) div 2"))
    last = F.when(~F.col("opening"), F.expr("(seq + depth + 1) div 2 - 1"))
    return tree.join(events.groupBy("root", "path").agg(F.max(first).alias("first"), F.max(last).alias("last")), ["root", "path"])


def subtrees(tree: DataFrame, requests: DataFrame) -> DataFrame:
    """For each of `requests(request_id, root, path)` the node at just this path and all below it, by place from 0, with status and message.

    None, '' and '.' ask for the whole tree, which is a lone root node where the root has no document. A path of no node
    (one that ends in a slash, too) gives one row of status not_found. Nodes are met by ranges of their numbers: an equality
    join on spans of SPAN numbers, so the work is in proportion to the result.
    """
    nodes = nested_sets(tree)
    asked = requests.select("request_id", "root", F.when(F.coalesce("path", F.lit("")) == ".", "").otherwise(F.coalesce("path", F.lit(""))).alias("asked"))
    hit = asked.join(nodes.select("root", F.col("path").alias("asked"), F.col("first").alias("a"), F.col("last").alias("z")), ["root", "asked"], "left")
    spans = hit.where("a IS NOT NULL").withColumn("span", F.explode(F.sequence(F.expr(f"a div {SPAN}"), F.expr(f"z div {SPAN}")))).drop("asked")
    shown = ["path", "parent_path", "name", "depth", "node_type", "doc_type", "title", "bundle", "ord"]
    found = spans.join(nodes.withColumn("span", F.expr(f"first div {SPAN}")), ["root", "span"]).where("first BETWEEN a AND z")
    found = found.select("request_id", "root", F.lit("ok").alias("status"), F.lit("").alias("message"), (F.col("first") - F.col("a")).alias("place"), *shown)
    none = {c: F.lit(None).cast(nodes.schema[c].dataType) for c in shown}
    whole = F.col("asked") == ""
    lone = none | {"path": F.when(whole, ""), "name": F.when(whole, "."), "depth": F.when(whole, 0), "node_type": F.when(whole, "directory"), "ord": F.when(whole, 1)}
    message = F.when(whole, "").otherwise(F.concat(F.lit("path "), quoted(F.col("asked")), F.lit(" not found in bundle tree")))
    unknown = hit.where("a IS NULL").select("request_id", "root", F.when(whole, "ok").otherwise("not_found").alias("status"), message.alias("message"), F.when(whole, F.lit(0).cast("long")).alias("place"), *[c.cast(nodes.schema[n].dataType).alias(n) for n, c in lone.items()])
    return found.union(unknown)


def nested_json(tree: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(root, seq, piece): the pieces that, in order, are one JSON object for each root, its nodes' children in lists within them.

    An opening piece holds a node's fields (doc_type, title and bundle where they aren't empty), after a comma if a sibling
    stands before it; a closing piece ends it. Of `roots` those without a node give a lone root.
    """
    field = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    fields = F.to_json(F.struct("name", "path", F.col("node_type").alias("type"), field("doc_type"), field("title"), field("bundle")))
    inner = F.col("node_type") == "directory"
    opened = F.concat(F.when(F.col("ord") > 1, ",").otherwise(""), F.substring(fields, F.lit(1), F.length(fields) - 1), F.when(inner, ',"children":[').otherwise(""))
    events = tour(tree.withColumns({"opened": opened, "inner": inner}), "opened", "inner")
    pieces = events.select("root", "seq", F.when(F.col("opening"), F.col("opened")).when(F.col("inner"), "]}").otherwise("}").alias("piece"))
    if roots is None:
        return pieces
    lone = roots.select("root").distinct().join(tree.select("root"), "root", "left_anti")
    return pieces.union(lone.select("root", F.lit(0).cast("long").alias("seq"), F.lit('{"name":".","path":"","type":"directory"}').alias("piece")))
