"""Row-level examples of classification, front matter, catalog, retrieval, tree, validation and change logs."""

import random

import pytest
from pyspark.sql import functions as F

from mdcorpus.functions.frontmatter import _decode, split_frontmatter
from mdcorpus.functions.text import quoted
from mdcorpus.operators import catalog, changelog, classify, search, tree, validate
from mdcorpus.schemas import FILES, QUERIES

DOCS = "root string, path string, title string, description string, type string, tags array<string>"


def page(body="", **fields):
    """A markdown file whose front matter holds the fields given."""
    lines = [f"{k}: {v if not isinstance(v, list) else '[' + ', '.join(v) + ']'}" for k, v in fields.items()]
    return "\n".join(["---", *lines, "---", body])


GARDEN = [
    ("garden", "soil/compost.md", page("turn it weekly", type="howto", title="Hot compost", description="Layers and heat", tags=["soil", "heat", "worms"])),
    ("garden", "soil/index.md", ""),
    ("garden", "soil/log.md", page("## 2023-05-04\n**Added**: `compost.md` — see [it](/soil/compost.md)\n## 2023-05-01\n**Added**: `index.md` — start\n", type="Log")),
    ("garden", "tools/spade.md", page("dig", type="tool", title="Spade", description="For compost and clay", tags=["iron"])),
    ("garden", "tools/log.md", page("## 2023-04-01\n**Bought**: `spade.md` — used\n## 2023-06-01\n", type="Log")),
    ("garden", "tools/index.md", page("hello", type="Index")),
    ("garden", "rake.md", page("", title="Rake")),
    ("garden", "plain.md", "no block here\n"),
    ("garden", "broken.md", "---\ntype: 'x\n---\n"),
    ("garden", ".attic/old.md", page("", type="tool", title="Old", description="d", tags=["a", "b"])),
    ("garden", ".attic/log.md", page("", type="log")),
    ("garden", ".svn/entry.md", page("", type="tool")),
    ("garden", "photo.MD", "x"),
    ("desert", "note.txt", "x"),
]


@pytest.fixture(scope="module")
def garden(spark):
    files = spark.createDataFrame(GARDEN, FILES).repartition(3)
    parsed = classify.parse(files).cache()
    return files, parsed, catalog.resolve_bundles(classify.documents(parsed), catalog.reserved_files(parsed))


def test_garden_is_catalogued(garden):
    files, parsed, docs = garden
    assert {r.path: r.bundle for r in docs.collect()} == {"soil/compost.md": "soil", "tools/spade.md": "tools"}
    assert [r.tag for r in catalog.list_tags(docs).collect()] == ["heat", "iron", "soil", "worms"]
    assert {r.type for r in catalog.type_vocabulary(docs).collect()} == {"howto", "tool"}
    assert {(r.path, r.reason) for r in classify.skip_report(parsed).collect()} == {("rake.md", "missing_type"), ("plain.md", "no_frontmatter"), ("broken.md", "invalid_yaml")}
    reasons = {r.path: r.skip_reason for r in classify.classify(files).collect()}
    assert (reasons[".attic/old.md"], reasons[".svn/entry.md"], reasons["photo.MD"], reasons["rake.md"]) == ("hidden", "vcs", "extension", None)
    warned = {(r.root, r.path, r.message.split(":")[0]) for r in classify.ingest_warnings(parsed, files).collect()}
    assert warned == {("garden", "broken.md", "skipping broken.md"), ("desert", "", "no conformant docs")}


def test_hidden_directories_on_request(garden):
    kinds = {r.path: r.kind for r in classify.classify(garden[0], include_hidden=True).collect()}
    assert (kinds[".attic/old.md"], kinds[".attic/log.md"], kinds[".svn/entry.md"]) == ("doc", "reserved", "skipped")


def test_garden_findings(garden):
    files, parsed, _ = garden
    findings = validate.validate_bundle(parsed)
    assert {(r.file, r.code) for r in findings.collect()} == {("tools/spade.md", "N1"), ("tools/index.md", "E3"), ("tools/log.md", "N2"), ("tools/log.md", "N3")}
    summary = validate.summarise(findings, validate.bundle_files(parsed, files))
    got = {r.root: tuple(r)[1:] for r in validate.gate(summary).collect()}
    assert got == {"garden": (6, 1, 0, 3, 1), "desert": (0, 0, 0, 0, 0)}
    lines = {r.report_line for r in validate.report_lines(findings, summary).collect()}
    assert "tools/index.md: [E3] error: index.md must not have frontmatter" in lines and "0 files: 0 errors, 0 warnings, 0 notifications" in lines


def test_results_do_not_depend_on_partitions(spark, garden):
    files = spark.createDataFrame(random.Random(4).sample(GARDEN, len(GARDEN)), FILES)
    for n in (1, 7):
        parsed = classify.parse_once(files.repartition(n))
        assert sorted(map(tuple, validate.validate_bundle(parsed).collect()), key=repr) == sorted(map(tuple, validate.validate_bundle(garden[1]).collect()), key=repr)
        reserved = catalog.reserved_files(parsed)
        assert sorted(map(tuple, catalog.resolve_bundles(classify.documents(parsed), reserved).collect()), key=repr) == sorted(map(tuple, garden[2].collect()), key=repr)


@pytest.mark.parametrize("topic, tags, match, status, path, message", [
    ("compost", ["HEAT"], "and", "ok", "soil/compost.md", ""), ("compost", ["iron", "gold"], "or", "ok", "tools/spade.md", ""), ("compost", ["iron", "gold"], "", "no_match", None, 'no document matched topic "compost" with tags [iron gold]'),
    ("clay", None, None, "ok", "tools/spade.md", ""), ("clay", None, "nor", "invalid_match", None, 'invalid match value "nor": must be "and" or "or"'), ("", None, "nor", "empty_topic", None, "topic is required"),
    ("?!", None, "and", "no_match", None, 'no document matched topic "?!" with tags []'), ('qq "zz"\\\n', None, "and", "no_match", None, r'no document matched topic "qq \"zz\"\\\n" with tags []'),
])
def test_retrieval_outcomes(spark, garden, topic, tags, match, status, path, message):
    files, _, docs = garden
    row = search.get_doc(files, docs, spark.createDataFrame([(1, "garden", topic, tags, match)], QUERIES)).first()
    assert (row.status, row.file_path, row.message) == (status, path, message)
    assert row.content == {"soil/compost.md": "turn it weekly", "tools/spade.md": "dig", None: None}[path]


def test_quoted(spark):
    texts = ['say "hi"', "back\\slash", "tab\tline\nend\r", "bell\a\b\f\v", "\x01\x7f", "café 中文 — 1", "no break​", "\U0001f600\U000e0001", ""]
    want = ['"say \\"hi\\""', '"back\\\\slash"', '"tab\\tline\\nend\\r"', '"bell\\a\\b\\f\\v"', '"\\x01\\x7f"', '"café 中文 — 1"', '"no\\u00a0break\\u200b"', '"\U0001f600\\U000e0001"', '""']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r.q for r in df.orderBy("i").select(quoted(F.col("t")).alias("q")).collect()] == want


@pytest.mark.parametrize("content, block, offset", [
    ("---\nname: x\n---\nrest", "name: x\n", 16), ("---\nname: é\n---", "name: é\n", 16), ("---\n---\nrest", "", 8), ("---\na: 1\n---\n---\nb: 2\n---\n", "a: 1\n", 13),
    ("---\nname: x\n", None, 0), ("text first\n---\na: 1\n---\n", None, 0), ("", None, 0), ("----\na: 1\n---\n", None, 0), ("---\na: 1\n --- \n", None, 0), ("---\r\na: 1\r\n---\r\n", None, 0), ("---\n\x07\x00\n---\n", "\x07\x00\n", 11), (None, None, 0),
])
def test_front_matter_edges(spark, content, block, offset):
    row = split_frontmatter(spark.createDataFrame([("r", "a.md", content)], FILES)).first()
    assert (row.has_frontmatter, row.yaml_block, row.body_offset) == (block is not None, block or "", offset)
    assert row.body == (content if content is None else content.encode()[offset:].decode())


@pytest.mark.parametrize("yaml, want", [
    ("type: 7\ntitle: 2021-12-31\n", ("2021-12-31", "7", None, False)), ("type: null\n", ("", "", None, False)), ("title: a\ntitle: b\n", ("", "", None, True)), ("type: {a: b}\n", ("", "", None, True)),
    ("tags: solo\ntype: a\n", ("", "", None, True)), ("tags: [x, null, 9]\ntype: a\n", ("", "a", ["x", "9"], False)), ("- item\n", ("", "", None, True)), ('type: "open\n', ("", "", None, True)), ("", ("", "", None, False)),
])
def test_yaml_shapes(yaml, want):
    title, _, type_, tags, error = _decode(yaml, False)
    assert (title, type_, tags, error is not None) == want


@pytest.mark.parametrize(
    "block, want",
    [
        ("b: &b {type: T, title: old}\n<<: *b\n", ("old", "", "T", None)),
        ("b: &b {type: T, title: old}\ntitle: own\n<<: *b\n", ("own", "", "T", None)),
        ("a: &a {type: A}\nb: &b {type: B, description: d, tags: [x]}\n<<: [*a, *b]\n", ("", "d", "A", ["x"])),
        ("a: &a {type: A}\nb: &b {type: B, title: t}\nc: &c {<<: [*b, *a], description: c}\n<<: *c\n", ("t", "c", "B", None)),
        ("b: &b {type: T}\n<<: {title: inline, type: I}\n", ("inline", "", "I", None)),
        ("b: &b {type: T}\n'<<': *b\ntype: own\n", ("", "", "own", None)),
        ("b: &b {type: T}\n<<: *b\ntype: null\n", ("", "", "", None)),
    ],
)
def test_merge_keys(block, want):
    assert _decode(block, False) == (*want, None)


@pytest.mark.parametrize("block", ["a: &a {type: A}\n<<: *a\n<<: *a\n", "b: &b {title: x, title: y}\n<<: *b\ntype: T\n", "b: &b\n  <<: *b\n<<: *b\n", "<<: text\ntype: T\n", "l: &l [1]\n<<: *l\n", "type: a\ntype: b\n"])
def test_merges_that_are_refused(block):
    assert _decode(block, False)[:4] == ("", "", "", None) and _decode(block, False)[4]


def test_many_nested_merges_take_little_time():
    levels = "".join(f"n{i}: &n{i} {{<<: [*n{i - 1}, *n{i - 1}], k{i}: 1}}\n" for i in range(1, 60))
    assert _decode(f"n0: &n0 {{type: T}}\n{levels}<<: *n59\n", False)[2] == "T"

@pytest.mark.parametrize("query, title, desc, tags, want", [
    ("orchid", "Wild Orchids", "shade", ["moss"], 3.0), ("orchid", "Shade", "moss", ["orchid", "orchids"], 2.0), ("ORCHID", "Shade", "two orchids", None, 1.0),
    ("moss, moss; MOSS", "Moss", "moss on stone", ["moss"], 6.0), ("moss stone", "Moss", "moss on stone", ["stone"], 7.0), ("", "Moss", "moss", ["moss"], 0.0), ("fern", "Moss", "", None, 0.0),
])
def test_scores(spark, query, title, desc, tags, want):
    docs = spark.createDataFrame([("r", "a.md", title, desc, "t", tags)], DOCS)
    asked = spark.createDataFrame([(1, "r", query, None, "and")], QUERIES)
    assert search.score(docs, asked).first().score == want
    assert [r.score for r in search.vocabulary_score(docs, asked).collect()] == ([want] if want > 0 else [])


def test_both_strategies_agree_on_random_documents(spark):
    rng = random.Random(9)
    words = ["ab", "abc", "b", "cab", "é1", "x-y", "zz", "B"]
    some = lambda n: " ".join(rng.choices(words, k=rng.randint(0, n)))
    docs = spark.createDataFrame([(f"r{rng.randint(0, 2)}", f"{i}.md", some(3), some(5), "t", rng.choice([None, rng.choices(words, k=2)])) for i in range(80)], DOCS)
    asked = spark.createDataFrame([(i, f"r{rng.randint(0, 3)}", some(3), rng.choice([None, rng.choices(words, k=1)]), rng.choice(["and", "or", "", None, "nor"])) for i in range(60)], QUERIES)
    direct = sorted(map(tuple, search.score(docs, asked).where("score > 0").collect()))
    assert direct and direct == sorted(map(tuple, search.vocabulary_score(docs, asked.repartition(5)).collect()))
    assert sorted(map(tuple, search.find_best(docs, asked).collect())) == sorted(map(tuple, search.find_best(docs, asked, "vocab").collect()))


def test_ties_go_to_the_smaller_path(spark):
    docs = spark.createDataFrame([("r", p, "Fern", "", "t", None) for p in ("b/fern.md", "a/z.md", "a-b.md")], DOCS)
    assert search.find_best(docs, spark.createDataFrame([(1, "r", "fern", None, "and")], QUERIES)).first().path == "a-b.md"


@pytest.mark.parametrize("path, index, bundle", [
    ("soil/deep/peat.md", ["soil/index.md"], "soil"), ("shed/nail.md", [], "shed"), ("top.md", ["index.md"], "."), ("top.md", [], "."), ("shed/nail.md", ["index.md", "soil/index.md"], "."), ("x/y/z.md", ["index.md", "x/y/index.md", "x/index.md"], "x/y"),
])
def test_bundles(spark, path, index, bundle):
    files = spark.createDataFrame([("r", path)], "root string, path string")
    reserved = spark.createDataFrame([("r", p) for p in index], "root string, path string")
    assert catalog.resolve_bundles(files, reserved).first().bundle == bundle


def test_tree_order_and_subtree(spark):
    names = ("m-n.md", "m/n.md", "y.md", "m/k/j.md")
    files = [("r", p, page("", type="t", title="T", description="D", tags=["x"])) for p in names] + [("r", "index.md", ""), ("r", "m/index.md", "")]
    parsed = classify.parse(spark.createDataFrame(files, FILES))
    reserved = catalog.reserved_files(parsed)
    t = tree.build_tree(catalog.resolve_bundles(classify.documents(parsed), reserved), catalog.resolve_bundles(reserved, reserved))
    assert [r.path for r in t.where("parent_path = ''").orderBy("ord").collect()] == ["m", "m-n.md", "y.md", "index.md"]
    assert [r.path for r in t.where("parent_path = 'm'").orderBy("ord").collect()] == ["m/k", "m/n.md", "m/index.md"]
    assert {r.path for r in tree.subtree(t, "m").collect()} == {"m", "m/n.md", "m/index.md", "m/k", "m/k/j.md"}
    assert tree.subtree(t, "m/").count() == 0 and tree.subtree(t, ".").count() == t.count()


def test_paths_mode(spark):
    files = spark.createDataFrame([("r", "odd.md", page("", type="strange")), ("r", "bare.md", "words\n"), ("r", "log.md", page("## 2020-01-01\n## 2020-02-01\n", type="Log")), ("r", "x/log.md", "words"), ("r", "y/log.md", page("", type='"log"'))], FILES)
    paths = spark.createDataFrame([("r", p) for p in ("odd.md", "bare.md", "log.md", "x/log.md", "y/log.md", "gone.md")], "root string, path string")
    found = validate.validate_paths(files, paths, ["guide"]).collect()
    assert {(r.file, r.code) for r in found} == {("odd.md", c) for c in ("W1", "W2", "W3", "W4")} | {("bare.md", "E1"), ("gone.md", "E0"), ("log.md", "N2"), ("log.md", "N3"), ("x/log.md", "E3"), ("y/log.md", "E3")}
    assert {r.code for r in validate.validate_paths(files, paths.where("path = 'odd.md'"), []).collect()} == {"W1", "W2", "W4"}


def test_log_entries(spark):
    body = "intro\n## 2022-08-09\nlost\n**Sown**: `beans.md` — in rows\n  two deep \nno entry\n**Cut**: `hedge.md` — low\n\n## 2022-08-01\n## 2022-07-30 \n**Dug**: `bed.md` — x\n"
    rows = changelog.parse_log(spark.createDataFrame([("r", "log.md", body)], "root string, source string, body string"))
    got = [(r.date, r.action, r.target, r.detail) for r in changelog.get_log(rows).collect()]
    # the third heading ends in a space, so it is none
    assert got == [("2022-08-09", "Sown", "beans.md", "in rows\ntwo deep\nno entry"), ("2022-08-09", "Cut", "hedge.md", "low"), ("2022-08-01", "Dug", "bed.md", "x")]
    assert [r.action for r in changelog.get_log(rows, limit=1.9).collect()] == ["Sown"]
    assert changelog.get_log(rows, since="2022-08-10").count() == 0 and changelog.get_log(rows, limit=-1).count() == 3


def test_logs_are_merged_and_limited(spark):
    logs = [("p", "z/log.md", "## 2022-01-02\n**A**: `1` — a\n## 2022-01-01\n**A**: `2` — b\n"), ("p", "b/log.md", "## 2022-01-02\n**B**: `3` — c\n**B**: `4` — d\n"), ("q", "log.md", "## 2021-01-01\n**C**: `5` — e\n"), ("q", "bad/log.md", "only words"), ("s", "log.md", None)]
    bodies = spark.createDataFrame(logs, "root string, source string, body string").repartition(3)
    entries = changelog.parse_log(bodies)
    assert [r.target for r in changelog.get_log(entries).collect()] == ["3", "4", "1", "2", "5"]
    assert [r.target for r in changelog.get_log(entries, limit=1, per_root=True).collect()] == ["3", "5"]
    assert [r.target for r in changelog.get_log(entries, action="A", since="2022-01-02").collect()] == ["1"]
    roots = spark.createDataFrame([(r,) for r in "pqst"], "root string")
    assert {tuple(r) for r in changelog.log_notes(bodies, entries, roots).collect()} == {("q", "log.md has malformed entries"), ("s", "failed to read log.md"), ("t", "no log.md found")}


def test_sources_and_sinks(spark, tmp_path):
    from mdcorpus.sources.corpus import read_corpus, read_tree
    from mdcorpus.sources.sinks import json_rows, write_catalog

    for name, text in {"docs/index.md": "", "_x.md": "a", ".n.md": "b", ".h/c.md": "c", ".git/d.md": "d", "pic.png": "e", "a/b/c/d.md": "f"}.items():
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text(text)
    (tmp_path / "t" / "linked").symlink_to(tmp_path / "t" / "docs")
    (tmp_path / "t" / "dead.md").symlink_to(tmp_path / "nowhere")
    (tmp_path / "empty").mkdir()
    rows = {(r.root, r.path): r.content for r in read_tree(spark, {"r": str(tmp_path / "t"), "e": str(tmp_path / "empty")}).collect()}
    assert rows == {("r", "docs/index.md"): "", ("r", "_x.md"): "a", ("r", ".n.md"): "b", ("r", "pic.png"): None, ("r", "a/b/c/d.md"): "f", ("r", "dead.md"): None}
    hidden = {r.path for r in read_tree(spark, {"r": str(tmp_path / "t")}, include_hidden=True).collect()}
    assert ".h/c.md" in hidden and ".git/d.md" not in hidden
    df = spark.createDataFrame([("r", "a.md", "x")], FILES)
    write_catalog({"files": df}, str(tmp_path / "out"))
    assert read_corpus(spark, str(tmp_path / "out" / "files")).count() == 1
    with pytest.raises(ValueError):
        spark.createDataFrame([(1,)], "root int").write.parquet(str(tmp_path / "other"))
        read_corpus(spark, str(tmp_path / "other"))
    rows = spark.createDataFrame([("r", "", None, 0, ["a", 'b"']), ("q", "t", "d", 3, None)], "root string, title string, detail string, line int, tags array<string>")
    got = sorted(r.value for r in json_rows(rows, ("title", "detail", "line")).collect())
    assert got == ['{"root":"q","title":"t","detail":"d","line":3,"tags":null}', '{"root":"r","tags":["a","b\\""]}']


def test_streamed_catalog(spark, tmp_path):
    from mdcorpus.streaming.ingest import documents_stream, start_catalog

    spark.createDataFrame(GARDEN, FILES).write.parquet(str(tmp_path / "in"))
    start_catalog(documents_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert {r.path for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"soil/compost.md", "tools/spade.md"}
