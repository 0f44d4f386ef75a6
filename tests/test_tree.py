"""The tree as JSON and by requests, against trees built and walked in plain Python."""

import json
import random

import pytest

from mdcorpus.operators.tree import build_tree, nested_json, nested_sets, subtrees
from mdcorpus.sources.sinks import write_pieces

DOC = "root string, path string, type string, title string, bundle string"


def built(docs, reserved):
    """{root: nested dict}, leaves put in one after the other."""
    roots = {}
    for kind, rows in (("file", docs), ("reserved", reserved)):
        for root, path, type_, title, bundle in sorted(rows, key=lambda r: (r[0], r[1].split("/"))):
            node = roots.setdefault(root, {"name": ".", "path": "", "type": "directory", "children": []})
            for i, part in enumerate(path.split("/")[:-1]):
                below = next((c for c in node["children"] if c["name"] == part), None)
                if below is None:
                    below = {"name": part, "path": "/".join(path.split("/")[: i + 1]), "type": "directory", "children": []}
                    node["children"].append(below)
                node = below
            leaf = {"name": path.split("/")[-1], "path": path, "type": kind, "doc_type": type_, "title": title if kind == "file" else "", "bundle": bundle}
            node["children"].append({k: v for k, v in leaf.items() if v})
    return roots


def walked(node):
    yield node
    for c in node.get("children", ()):
        yield from walked(c)


@pytest.fixture(scope="module")
def forest(spark):
    r = random.Random(2)
    names = ["a", "a-b", "B", "c.d", "é", 'q"x', "deep"]
    paths = {"/".join(r.choice(names) for _ in range(r.randrange(0, 5))) + f"/{i}.md" for i in range(300)}
    docs = [(f"r{hash_ % 3}", p.lstrip("/"), "T", ["", "Title, {[:", 'q"\\'][hash_ % 3], ["", ".", "a"][hash_ % 3]) for hash_, p in enumerate(sorted(paths))]
    docs += [("long", "/".join(f"d{i}" for i in range(60)) + "/x.md", "T", "t", "b")] + [("wide", f"{i}.md", "T", "", "") for i in range(1500)]
    reserved = [("r0", "index.md", "", "", "."), ("r1", "only/log.md", "Log", "", "only"), ("r2", "a/index.md", "", "", "a"), ("bare", "index.md", "", "", ".")]
    tree = build_tree(spark.createDataFrame(docs, DOC), spark.createDataFrame(reserved, DOC)).cache()
    return tree, built(docs, reserved)


def test_pieces_make_the_recursive_json(spark, forest, tmp_path):
    tree, want = forest
    roots = spark.createDataFrame([(r,) for r in [*want, "empty"]], "root string")
    want = want | {"empty": {"name": ".", "path": "", "type": "directory"}}
    got = {}
    for r in sorted(nested_json(tree, roots).collect(), key=lambda r: (r.root, r.seq)):
        got.setdefault(r.root, []).append(r.piece)
    assert {k: json.loads("".join(v)) for k, v in got.items()} == want
    write_pieces(nested_json(tree, roots), str(tmp_path / "json"))
    text, at, read = "".join(f.read_text() for f in sorted((tmp_path / "json").glob("part-*"))), 0, []
    while text[at:].strip():
        one, at = json.JSONDecoder().raw_decode(text, at + len(text[at:]) - len(text[at:].lstrip()))
        read.append(one)
    assert read == [want[k] for k in sorted(want)]


def test_no_partition_holds_a_root(spark, forest):
    from pyspark.sql import functions as F

    from mdcorpus.operators.tree import tour

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        events = tour(forest[0], "path").where("root = 'wide'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in events) < 3002 / 2


def test_numbers_are_nested_sets(forest):
    tree, want = forest
    rows = nested_sets(tree).collect()
    for root, top in want.items():
        order = [n["path"] for n in walked(top)]
        by_path = {r.path: r for r in rows if r.root == root}
        assert [by_path[p]["first"] for p in order] == list(range(len(order)))
        for n in walked(top):
            assert by_path[n["path"]]["last"] - by_path[n["path"]]["first"] + 1 == sum(1 for _ in walked(n))


def test_requests_for_subtrees(spark, forest):
    tree, want = forest
    nodes = {(root, n["path"]): n for root, top in want.items() for n in walked(top)}
    some = sorted(nodes)[::7]
    asked = [(i, *k) for i, k in enumerate(some)] + [(10_000, "wide", None), (10_001, "r0", "."), (10_002, "r0", "nowhere/x"), (10_003, "r1", "only/"), (10_004, "none", ""), (10_005, "none", "a"), (10_006, "r1", "./only"), (10_007, "long", "d0/d1/d2"), (10_007, "r0", "index.md"), (10_008, "r0", 'q"\t')]
    got = {}
    for r in subtrees(tree, spark.createDataFrame(asked, "request_id long, root string, path string")).collect():
        got.setdefault((r.request_id, r.root), []).append(r)
    assert set(got) == {(i, root) for i, root, _ in asked}
    for i, root, path in asked:
        rows = sorted(got[i, root], key=lambda r: r.place or 0)
        node = nodes.get((root, "" if path in (None, ".") else path))
        if node:
            assert [r.path for r in rows] == [n["path"] for n in walked(node)] and {(r.status, r.message) for r in rows} == {("ok", "")}
            assert [(r.node_type, r.doc_type or "", r.title or "", r.bundle or "") for r in rows] == [(n["type"], n.get("doc_type", ""), n.get("title", ""), n.get("bundle", "")) for n in walked(node)]
        elif not path:
            assert [(r.status, r.path, r.name, r.place) for r in rows] == [("ok", "", ".", 0)]
        else:
            shown = path.replace('"', '\\"').replace("\t", "\\t")
            assert [(r.status, r.message, r.path, r.place) for r in rows] == [("not_found", f'path "{shown}" not found in bundle tree', None, None)]


def test_lists_of_a_root_are_json(spark):
    """Lists in pieces, of roots with many, few and no items; what has no note has none."""
    from mdcorpus.sources.sinks import json_logs, json_tags, json_validation

    def read(pieces):
        out = {}
        for r in sorted(pieces.collect(), key=lambda r: (r.root, r.seq)):
            out.setdefault(r.root, []).append(r.piece)
        return {k: json.loads("".join(v)) for k, v in out.items()}

    roots = spark.createDataFrame([("a",), ("b",), ("b",), ("none",)], "root string")
    tags = [("a", f't{i:03}"') for i in range(500)] + [("b", "é")]
    assert read(json_tags(spark.createDataFrame(tags, "root string, tag string").repartition(5), roots)) == {"a": [t for r, t in tags if r == "a"], "b": ["é"], "none": []}
    found = [("a", "z/log.md", "N2", "notification", None, "m"), ("a", "b.md", "N1", "notification", None, "q\"x"), ("a", "b.md", "W1", "warning", 3, "w"), ("a", "a/x.md", "W4", "warning", 0, "v")]
    summary = spark.createDataFrame([("a", 4, 0, 2, 2), ("none", 0, 0, 0, 0)], "root string, files long, errors long, warnings long, notifications long")
    got = read(json_validation(summary, spark.createDataFrame(found, "root string, file string, code string, severity string, line int, message string")))
    assert got["none"] == {"summary": {"Files": 0, "Errors": 0, "Warnings": 0, "Notifications": 0}, "findings": []}
    assert [(f["file"], f["code"], f.get("line")) for f in got["a"]["findings"]] == [("a/x.md", "W4", None), ("b.md", "W1", 3), ("b.md", "N1", None), ("z/log.md", "N2", None)]
    entries = spark.createDataFrame([("a", "l", 1, 1, "2024-01-01", "Add", "x", ""), ("a", "l", 0, 1, "2024-02-01", "Fix", "y", "d"), ("a", "k", 5, 1, "2024-01-01", "Add", "z", "e")], "root string, source string, sec_pos long, ent_pos int, date string, action string, target string, detail string")
    notes = spark.createDataFrame([("b", "log.md has malformed entries"), ("b", "failed to read log.md")], "root string, note string")
    got = read(json_logs(entries, notes, roots))
    assert [(e["date"], e["source"], e.get("detail")) for e in got["a"]["entries"]] == [("2024-02-01", "l", "d"), ("2024-01-01", "k", "e"), ("2024-01-01", "l", None)] and "note" not in got["a"]
    assert got["b"] == {"entries": [], "note": "failed to read log.md"} and got["none"] == {"entries": []}
