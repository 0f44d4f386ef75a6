"""Front matter: splitting it off with built-in functions, decoding its four fields with one Arrow function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = r"\A---\n((?s:.*?\n)?)---(?:\n|\z)"
FIELDS = "title string, description string, type string, tags array<string>, error string"


def split_frontmatter(files: DataFrame) -> DataFrame:
    """`files` with has_frontmatter, yaml_block, body_offset (bytes) and body (the whole content without a block)."""
    # the pattern goes over the content once (equal expressions are worked out once); the rest follows from the short head
    head = F.coalesce(F.regexp_extract("content", BLOCK, 0), F.lit(""))
    return files.withColumns({
        "has_frontmatter": head != "",
        "yaml_block": F.when(head != "", F.regexp_extract(head, BLOCK, 1)).otherwise(""),
        "body_offset": F.octet_length(head),
        "body": F.when(head != "", F.substring("content", F.char_length(head) + 1, F.char_length("content"))).otherwise(F.col("content")),
    })


MERGE = "tag:yaml.org,2002:merge"


def _fields(node, above: tuple = (), seen: dict | None = None) -> dict:
    """The values of a mapping by key, those that it merges in included: its own keys come first, then earlier merges.

    Keys may not occur twice in one mapping; a mapping can't be merged into itself.
    """
    import yaml

    seen = {} if seen is None else seen
    if id(node) in seen:
        return seen[id(node)]
    if any(node is x for x in above):
        raise ValueError("a merged mapping contains itself")
    scalars = [(k, v) for k, v in node.value if isinstance(k, yaml.ScalarNode)]
    if len(scalars) != len({k.value for k, _ in scalars}):
        raise ValueError("a key occurs twice")
    found = {k.value: v for k, v in scalars if k.tag != MERGE}
    for _, v in (x for x in scalars if x[0].tag == MERGE):
        merged = v.value if isinstance(v, yaml.SequenceNode) else [v]
        if not all(isinstance(m, yaml.MappingNode) for m in merged):
            raise ValueError("what is merged is no mapping or list of mappings")
        for m in merged:
            found = _fields(m, (*above, node), seen) | found
    seen[id(node)] = found
    return found


def _decode(block: str, type_only: bool) -> tuple:
    """(title, description, type, tags, error); scalars give their source text, nulls and absent fields ''."""
    import yaml

    empty = ("", "", "", None)
    text = lambda n: "" if n.tag == "tag:yaml.org,2002:null" else n.value
    try:
        node = next(iter(yaml.compose_all(block, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))), None)
        if node is None or (isinstance(node, yaml.ScalarNode) and text(node) == ""):
            return (*empty, None)
        if not isinstance(node, yaml.MappingNode):
            return (*empty, "front matter is not a mapping")
        fields = _fields(node)
    except (yaml.YAMLError, ValueError) as e:
        return (*empty, " ".join(str(e).split()))
    got: dict = {"tags": None}
    for name in ("type",) if type_only else ("title", "description", "type"):
        v = fields.get(name)
        if v is not None and not isinstance(v, yaml.ScalarNode):
            return (*empty, f"{name} must be a scalar")
        got[name] = text(v) if v is not None else ""
    v = None if type_only else fields.get("tags")
    if v is not None and not (isinstance(v, yaml.ScalarNode) and text(v) == ""):
        if not isinstance(v, yaml.SequenceNode) or not all(isinstance(x, yaml.ScalarNode) for x in v.value):
            return (*empty, "tags must be a list of scalars")
        got["tags"] = [text(x) for x in v.value if x.tag != "tag:yaml.org,2002:null"]
    return got.get("title", ""), got.get("description", ""), got["type"], got["tags"], None


def _decoded(block: pd.Series, type_only: pd.Series) -> pd.DataFrame:
    rows = [_decode(b or "", t) for b, t in zip(block, type_only)]
    return pd.DataFrame(rows, columns=["title", "description", "type", "tags", "error"])


def decode_frontmatter(split: DataFrame) -> DataFrame:
    """title, description, type, tags and yaml_error; only `type` is looked at in reserved files. Rows are kept on errors."""
    decoded = F.pandas_udf(_decoded, FIELDS)  # made here: at import there may be no session
    return (
        split.withColumn("_fm", decoded("yaml_block", F.col("kind") == "reserved"))
        .withColumns({**{c: F.col(f"_fm.{c}") for c in ("title", "description", "type", "tags")}, "yaml_error": F.when(F.col("has_frontmatter"), F.col("_fm.error"))})
        .drop("_fm")
    )
