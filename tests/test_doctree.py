"""The data source of documentation trees: what it reads, what it plans, what it is asked to leave out."""

import os

import pytest
from pyspark.sql import functions as F

from mdcorpus.sources.corpus import read_tree
from mdcorpus.sources.doctree import DocTreeReader, register


@pytest.fixture(scope="module")
def top(tmp_path_factory):
    top = tmp_path_factory.mktemp("trees")
    for root in ("a", "b", "c d"):
        for path in ("x.md", "empty.md", ".dot.md", "_u.md", "pic.png", "d/e/f/y.md", ".hid/z.md", ".hid/in/z.md", "d/.git/q.md", "d/.h/w.md", "é/log.md", "MD/x.MD"):
            f = top / root / path
            f.parent.mkdir(parents=True, exist_ok=True)
            f.write_bytes(b"" if path == "empty.md" else f"{root} {path} \xff".encode("latin-1"))
    os.symlink(top / "a" / "d", top / "b" / "linked")
    os.symlink(top / "a" / "x.md", top / "b" / "link.md")
    os.symlink(top / "nowhere", top / "b" / "broken.md")
    (top / "file-beside-the-roots.md").write_text("x")
    return str(top)


@pytest.fixture(scope="module")
def trees(spark, top):
    register(spark)
    return lambda **options: spark.read.format("doctree").options(**options).load(top)


def rows(df):
    return sorted((r.root, r.path, r.content) for r in df.select("root", "path", "content").collect())


@pytest.mark.parametrize("parts", [1, 5, 1000])
def test_it_reads_what_read_tree_reads(spark, top, trees, parts):
    roots = {r: f"{top}/{r}" for r in ("a", "b", "c d")}
    assert rows(trees(parts=parts)) == rows(read_tree(spark, roots, include_hidden=True))
    assert rows(trees(parts=parts).where("NOT hidden")) == rows(read_tree(spark, roots))


def test_filters_are_pushed(spark, trees):
    every = trees().cache()
    wanted = F.col("root").isin("a", "c d") & F.endswith("path", F.lit(".md")) & (F.col("hidden") == F.lit(False))
    for condition in (wanted, (F.col("root") == "b") & F.col("hidden"), F.endswith("path", F.lit("log.md")), (F.col("root") == "a") & (F.col("root") == "b"), F.col("hidden") & ~F.col("hidden"), F.startswith("path", F.lit("d/"))):
        assert rows(trees().where(condition)) == rows(every.where(condition))
    plan = spark._jvm.PythonSQLUtils.explainString(trees().where(wanted)._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [" in plan and all(f in plan for f in ("In(root, [a,c d])", "StringEndsWith(path,.md)", "Not(EqualTo(hidden,true))"))
    assert "Condition" not in plan  # nothing is left for Spark to filter


def test_what_is_left_out_is_not_walked(top, monkeypatch):
    from pyspark.sql.datasource import EqualTo, IsNotNull, StringContains, StringEndsWith

    reader = DocTreeReader(top, 1000)
    left = list(reader.pushFilters([EqualTo(("root",), "a"), EqualTo(("hidden",), False), StringEndsWith(("path",), ".md"), IsNotNull(("path",)), StringContains(("path",), "e"), IsNotNull(("content",))]))
    assert left == [StringContains(("path",), "e"), IsNotNull(("content",))]
    opened, scandir = [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: opened.append(os.path.relpath(p, top)) or scandir(p))
    found = [f for part in reader.partitions() for batch in reader.read(part) for f in batch.column("path").to_pylist()]
    assert sorted(found) == [".dot.md", "_u.md", "d/e/f/y.md", "empty.md", "x.md", "é/log.md"]
    assert set(opened) == {".", "a", "a/d", "a/d/e", "a/d/e/f", "a/é", "a/MD"}


def test_parts_are_many_for_one_root(tmp_path):
    for i in range(40):
        for k in range(3):
            (tmp_path / "one" / f"d{i}" / f"s{k}").mkdir(parents=True)
            (tmp_path / "one" / f"d{i}" / f"s{k}" / "x.md").write_text("x")
    parts = DocTreeReader(str(tmp_path), 60).partitions()
    assert 60 <= len(parts) <= 62 and sum(batch.num_rows for p in parts for batch in DocTreeReader(str(tmp_path), 60).read(p)) == 120


def test_a_path_is_needed(spark):
    register(spark)
    with pytest.raises(Exception, match="directory that holds the roots"):
        spark.read.format("doctree").load().collect()
