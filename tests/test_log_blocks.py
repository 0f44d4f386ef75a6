"""Logs parsed in blocks against logs parsed whole, whatever the blocks."""

import random

import pytest
from pyspark.sql import functions as F

from mdcorpus.operators import changelog
from mdcorpus.sources.corpus import read_log_blocks

BODY = "root string, source string, body string"
LINES = ["## 2024-01-0{d}", "## 2024-01-0{d}", " ## 2024-01-0{d} ", "## 2024-1-01", "**Add**: `x{d}.md` — first {d}", "**Add**: `x{d}.md` — first {d}", "**Fix**:`y`—z", "**Fix**: `y` — \t", "more {d}", "  more\t", "", "", "\r", "see [x](/x.md)", "**Bad**: no target", "é — `q`"]


def bodies():
    r = random.Random(7)
    for i in range(60):
        yield (f"r{i % 3}", f"{i}/log.md", "\n".join(r.choice(LINES).format(d=r.randrange(1, 9)) for _ in range(r.randrange(0, 30))) + r.choice(["", "\n", "\n\n"]))
    yield ("r0", "none/log.md", None)
    yield ("r0", "empty/log.md", "")
    yield ("r1", "long/log.md", "## 2024-01-01\n**Add**: `x` — one\n" + "line\n" * 400 + "## 2023-12-31\nlost\n**Add**: `y` — two")
    yield ("r1", "text/log.md", "no heading\n**Add**: `x` — lost\nmore\n" * 20)


def ordered(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.root, r.source, r.sec_pos, r.ent_pos)):
        out.setdefault((r.root, r.source), []).append((r.date, r.action, r.target, r.detail))
    return out


@pytest.fixture(scope="module")
def logs(spark):
    df = spark.createDataFrame(list(bodies()), BODY).repartition(4).cache()
    return df, ordered(changelog.parse_log(df).collect())


@pytest.mark.parametrize("size", [1, 2, 15, 40, 41, 300, 1 << 20])
def test_blocks_change_nothing(logs, size):
    df, want = logs
    blocks = changelog.cut_lines(df, size).cache()
    whole = {(r.root, r.source): r.body for r in df.collect() if r.body}
    joined = {}
    for r in sorted(blocks.collect(), key=lambda r: r.block):
        joined.setdefault((r.root, r.source), []).append(r.text)
    assert {k: "\n".join(v) for k, v in joined.items()} == {k: v.removesuffix("\n") for k, v in whole.items()}
    assert ordered(changelog.parse_log_blocks(blocks.repartition(3)).collect()) == want


@pytest.mark.parametrize("size", [1, 50])
def test_checks_by_block(logs, size):
    df, _ = logs
    got = {(r.root, r.source): (r.linked, r.ordered) for r in changelog.log_block_checks(changelog.cut_lines(df, size)).collect()}
    for r in df.where("body <> ''").collect():
        dates = [x.strip() for x in r.body.split("\n") if len(x.strip()) == 13 and x.strip().startswith("## 2024-0")]
        assert got[r.root, r.source] == ("](/" in r.body, dates == sorted(dates, reverse=True))


def test_only_cut_entries_are_put_together(spark):
    """Of 2000 entries in some 90 blocks two a block at most are grouped."""
    body = "## 2024-01-01\n" + "\n".join(f"**Add**: `{i}` — text\nmore" for i in range(2000))
    df = spark.createDataFrame([("r", "log.md", body)], BODY)
    blocks = changelog.cut_lines(df, 512).cache()
    entries = changelog.parse_log_blocks(blocks)
    assert entries.count() == 2000 and blocks.count() > 80
    assert entries.agg(F.countDistinct("target")).first()[0] == 2000


def test_logs_are_read_by_splits(spark, tmp_path):
    r = random.Random(3)
    text = "---\ntype: Log\n---\n" + "".join(f"## 2024-01-{d:02}\n" + "".join(f"**Add**: `{i}-é` — {'x' * r.randrange(30)}\n  more\n" for i in range(r.randrange(20))) for d in range(28, 0, -1))
    names = ("log.md", "a b/log.md", "a b/c+%20/log.md")
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text.replace("`", f"`{len(name)}-", 1))
    (tmp_path / "other.md").write_text("## 2024-01-01\n**Add**: `x` — y\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        blocks = read_log_blocks(spark, "r", str(tmp_path), block_bytes=90).cache()
        got = ordered(changelog.parse_log_blocks(blocks).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    body = spark.createDataFrame([("r", n, (tmp_path / n).read_text().split("\n---\n", 1)[1]) for n in names], BODY)
    want = ordered(changelog.parse_log(body).collect())
    assert blocks.count() > 60 and got == want
