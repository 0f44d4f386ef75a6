"""The registered queries over the driver's tables, and DuckDB SQL for each."""

from __future__ import annotations

from functools import cached_property, reduce
from pathlib import Path
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.frontmatter import split_frontmatter
from ..functions.text import basename, tokenise
from ..operators import catalog, changelog, classify, search, tree, validate
from ..sources.corpus import read_corpus, read_tree
from ..sources.doctree import register
from ..sources.shared import cut, shared_dir
from ..sources.sinks import json_answers, json_logs, json_rows, json_tags, json_validation
from ..sources.stored import StoredCatalog, bodies_of, severities_of
from . import testcorpus
from .testcorpus import CORPUS_SQL

ACTION, SINCE, LIMIT = "click", "2024-01-15", 25


class Corpus:
    """What the queries share; nothing is computed before a query asks."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.files = testcorpus.files(spark, sf_dir)
        self.queries = testcorpus.topics(spark, sf_dir)
        self.roots = self.files.select("root").distinct()

    @cached_property
    def parsed(self) -> DataFrame:
        """For what reads the parsed files once."""
        return classify.parse(self.files)

    @cached_property
    def once(self) -> DataFrame:
        """For what reads them several times: worked out once, without the bodies of documents."""
        return classify.parse_once(self.files)

    def reserved(self, parsed: DataFrame) -> DataFrame:
        return catalog.reserved_files(parsed)

    def docs(self) -> DataFrame:
        return catalog.resolve_bundles(classify.documents(self.once), self.reserved(self.once))

    def plain_docs(self) -> DataFrame:
        return classify.documents(self.parsed)

    def tree(self) -> DataFrame:
        reserved = self.reserved(self.once)
        return tree.build_tree(self.docs(), catalog.resolve_bundles(reserved, reserved))

    def summary(self) -> DataFrame:
        return validate.summarise(validate.validate_bundle(self.once), validate.bundle_files(self.once, self.once.select("root").union(self.roots)))

    def entries(self, parsed: DataFrame | None = None) -> DataFrame:
        return changelog.parse_log(changelog.log_bodies(self.parsed if parsed is None else parsed))


def _tags(df: DataFrame) -> DataFrame:
    return df.withColumn("tags", F.coalesce(F.array_join("tags", "|"), F.lit("")))


def _split(c: Corpus) -> DataFrame:
    rows = split_frontmatter(classify.classify(c.files).where("kind <> 'skipped'"))
    return rows.select("root", "path", "has_frontmatter", "yaml_block", "body_offset", F.md5(F.col("body").cast("binary")).alias("body_md5"))


def _skipped(c: Corpus) -> DataFrame:
    return classify.skip_report(c.parsed).select("root", "path", "reason")


def _warnings(c: Corpus) -> DataFrame:
    # a decoder's own words differ from one decoder to the next
    return classify.ingest_warnings(c.once, c.roots).withColumn("message", F.regexp_replace("message", r"(?s)^(skipping [^:]*): .*", "$1"))


def _entries(df: DataFrame) -> DataFrame:
    return df.select("root", "source", "date", "action", "target", "detail")


def _paths(c: Corpus) -> DataFrame:
    paths = c.files.where(basename(F.col("path")).endswith(".md")).select("root", "path").union(c.roots.select("root", F.lit("missing.md").alias("path")))
    found = validate.validate_paths(c.files, paths, list(validate.DEFAULT_KNOWN_TYPES))
    return found.select("root", "file", "code", "severity", F.regexp_replace("message", r"(?s)^(invalid YAML frontmatter): .*", "$1").alias("message"))


def _merged(c: Corpus) -> DataFrame:
    parsed = classify.parse(testcorpus.merging(c.spark, c.sf_dir))
    return _tags(parsed.select("root", "path", "title", "description", "type", "tags", F.col("yaml_error").isNotNull().alias("refused")))


def _bundles(c: Corpus) -> DataFrame:
    reserved = c.reserved(c.once)
    return catalog.resolve_bundles(classify.documents(c.once).select("root", "path").union(reserved.select("root", "path")), reserved)


def _folder(c: Corpus, name: str) -> str:
    return f"{shared_dir(c.spark)}/{name}-{uuid4().hex}"


def _digests(files: DataFrame) -> DataFrame:
    return files.select("root", "path", F.coalesce(F.md5(F.col("content").cast("binary")), F.lit("")).alias("content_md5"))


def _landed(c: Corpus) -> DataFrame:
    path = _folder(c, "files")
    c.files.write.parquet(path)
    return _digests(read_corpus(c.spark, path))


#: So small a block that most of the logs' entries are cut.
LOG_BLOCK = 200


def _log_blocks(c: Corpus) -> DataFrame:
    return cut(changelog.cut_lines(changelog.log_bodies(c.parsed), LOG_BLOCK))


def _planted(c: Corpus) -> tuple[str, DataFrame]:
    """The files written out as directories in the shared folder, and the names of their roots."""
    top = _folder(c, "tree")
    if not top.startswith("file:"):
        raise ValueError("directories are read through the operating system: spark.checkpoint.dir must be a folder that all executors mount")
    top = top.removeprefix("file:")

    def write(batches):
        for pdf in batches:
            for root, path, content in pdf.itertuples(index=False, name=None):
                full = Path(top, root, path)
                full.parent.mkdir(parents=True, exist_ok=True)
                full.write_bytes((content or "").encode())
            yield pd.DataFrame({"root": pdf["root"]})

    return top, cut(c.files.select("root", "path", "content").mapInPandas(write, "root string").distinct())


def _walked(c: Corpus) -> DataFrame:
    top, roots = _planted(c)
    return _digests(read_tree(c.spark, {r["root"]: f"{top}/{r['root']}" for r in roots.collect()}))  # one name a tree


def _loaded(c: Corpus) -> DataFrame:
    top, _ = _planted(c)
    register(c.spark)
    return _digests(c.spark.read.format("doctree").load(top).where("NOT hidden AND endswith(path, '.md')"))


def _json_docs(c: Corpus) -> DataFrame:
    return json_rows(catalog.list_docs(c.docs()))


def _json_log(c: Corpus) -> DataFrame:
    return json_rows(c.entries().select("date", "action", "target", "detail", "source"), ("detail",))


def _catalog(c: Corpus) -> StoredCatalog:
    """All tables written out, and opened again."""
    parsed = c.parsed
    reserved, findings = c.reserved(c.once), validate.validate_bundle(c.once)
    entries = c.entries(c.once).withColumnRenamed("source", "path")
    order = Window.partitionBy("root", "path").orderBy("sec_pos", "ent_pos")
    tables = {
        "docs": c.docs(), "bodies": bodies_of(parsed), "reserved": catalog.resolve_bundles(reserved, reserved), "tree": c.tree(), "findings": findings.withColumnRenamed("file", "path"),
        "log_entries": entries.withColumn("place", F.row_number().over(order)).drop("sec_pos", "ent_pos"), "checked": validate.bundle_files(c.once, c.once.select("root").union(c.roots)), "severities": severities_of(findings),
    }
    path = _folder(c, "catalog")
    StoredCatalog.write(tables, path, CATALOG_BUCKETS)
    return StoredCatalog(c.spark, path)


#: Columns of the stored tables, in the order in which they are compared.
STORED = {
    "docs": ("root", "path", "title", "description", "type", "tags", "body_offset", "bundle"), "bodies": ("root", "path", "body"), "reserved": ("root", "path", "has_frontmatter", "type", "bundle"),
    "tree": ("root", "path", "parent_path", "name", "depth", "node_type", "doc_type", "title", "bundle", "ord"), "findings": ("root", "path", "code", "severity", "message"),
    "log_entries": ("root", "path", "date", "action", "target", "detail", "place"), "checked": ("root", "files"), "severities": ("root", "errors", "warnings", "notifications"),
}
CATALOG_BUCKETS = 8


def _stored(c: Corpus) -> DataFrame:
    """Every row of every stored table, with all its columns."""
    stored = _catalog(c)
    row = lambda columns: F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("stored_row")
    return reduce(DataFrame.union, [stored[name].select(F.lit(name).alias("table_name"), row(columns)) for name, columns in STORED.items()])


def _answer(answer: DataFrame) -> DataFrame:
    return _tags(answer).withColumn("content", F.md5(F.coalesce("content", F.lit("")).cast("binary")))


PLANS = {
    "classify": lambda c: classify.classify(c.files).select("root", "path", "kind", F.coalesce("skip_reason", F.lit("")).alias("skip_reason")),
    "skip_report": _skipped,
    "split_frontmatter": _split,
    "documents": lambda c: _tags(c.plain_docs()),
    "merged_frontmatter": _merged,
    "ingest_warnings": _warnings,
    "reserved_files": lambda c: c.reserved(c.parsed),
    "bundles": _bundles,
    "list_docs": lambda c: _tags(catalog.list_docs(c.docs())),
    "list_tags": lambda c: catalog.list_tags(c.plain_docs()),
    "type_vocabulary": lambda c: catalog.type_vocabulary(c.plain_docs()),
    "tokenise": lambda c: c.queries.select("query_id", F.array_join(tokenise(F.col("topic")), "|").alias("tokens")),
    "tag_filter": lambda c: search.tag_filter(c.plain_docs(), c.queries),
    "score": lambda c: search.score(c.plain_docs(), c.queries),
    "find_best": lambda c: search.find_best(c.plain_docs(), c.queries),
    "find_best_vocab": lambda c: search.find_best(classify.documents(c.once), c.queries, "vocab"),
    "get_doc": lambda c: _answer(search.get_doc(c.files, c.docs(), c.queries)),
    "get_doc_status": lambda c: search.outcomes(classify.documents(c.once), c.queries, search.find_best(classify.documents(c.once), c.queries)),
    "validate_bundle": lambda c: validate.validate_bundle(c.parsed).drop("line"),
    "validate_paths": _paths,
    "summary": lambda c: c.summary(),
    "gate": lambda c: validate.gate(c.summary()),
    "report_lines": lambda c: validate.report_lines(validate.validate_bundle(c.once), c.summary()),
    "tree": lambda c: c.tree(),
    "subtree": lambda c: tree.subtree(c.tree(), "en/d1"),
    "tree_json": lambda c: tree.nested_json(c.tree(), c.roots),
    "subtrees": lambda c: tree.subtrees(c.tree(), testcorpus.requests(c.spark, c.sf_dir)),
    "log_entries": lambda c: _entries(c.entries()),
    "log_entries_by_block": lambda c: _entries(changelog.parse_log_blocks(_log_blocks(c))),
    "log_checks_by_block": lambda c: changelog.log_block_checks(_log_blocks(c)),
    "get_log_since": lambda c: _entries(changelog.get_log(c.entries(), since=SINCE)),
    "get_log_action": lambda c: _entries(changelog.get_log(c.entries(), action=ACTION)),
    "get_log_limit": lambda c: _entries(changelog.get_log(c.entries(), limit=LIMIT)),
    "get_log_root_limit": lambda c: _entries(changelog.get_log(c.entries(), limit=LIMIT, per_root=True)),
    "log_notes": lambda c: changelog.log_notes(changelog.log_bodies(c.once), c.entries(c.once), c.roots),
    "read_corpus": _landed,
    "read_tree": _walked,
    "doctree_source": _loaded,
    "json_docs": _json_docs,
    "json_log": _json_log,
    "json_tags": lambda c: json_tags(catalog.list_tags(classify.documents(c.once)), c.roots),
    "json_validation": lambda c: json_validation(c.summary(), validate.validate_bundle(c.once)),
    "json_logs": lambda c: json_logs(c.entries(c.once), changelog.log_notes(changelog.log_bodies(c.once), c.entries(c.once), c.roots), c.roots),
    "json_answers": lambda c: json_answers(search.get_doc(c.files, c.docs(), c.queries)),
    "catalog_tables": _stored,
    "catalog_get_doc": lambda c: _answer(_catalog(c).get_doc(c.queries)),
    "catalog_summary": lambda c: _catalog(c).summary(),
    "catalog_tree": lambda c: _tags(_catalog(c).tree()),
}

JOINED = "array_to_string({}, '|')"
QUOTED = r"""'"' || replace(replace({}, '\', '\\'), '"', '\"') || '"'"""
STATUS = f"""CASE status WHEN 'empty_topic' THEN 'topic is required' WHEN 'invalid_match' THEN 'invalid match value ' || {QUOTED.format('match')} || ': must be "and" or "or"'
  WHEN 'empty_index' THEN 'index is empty: no markdown documents found in cwd' WHEN 'no_match' THEN 'no document matched topic ' || {QUOTED.format('topic')} || ' with tags [' || array_to_string(asked, ' ') || ']' ELSE '' END"""
BEST = "SELECT query_id, root, path, score FROM best"
ENTRY = "SELECT root, source, date, action, target, detail FROM log_table"
TREE = "SELECT root, path, parent_path, name, depth, node_type, doc_type, title, bundle, ord FROM tree"
GET_DOC = f"""SELECT s.query_id, s.status, {STATUS} AS message, md5(coalesce(p.body, '')) AS content, p.path AS file_path, coalesce({JOINED.format('p.tags')}, '') AS tags, p.title, p.description, bu.bundle
        FROM status s LEFT JOIN best b ON b.query_id = s.query_id LEFT JOIN docs p ON p.root = b.root AND p.path = b.path LEFT JOIN bundled bu ON bu.root = b.root AND bu.path = b.path"""

STORED_ROWS = {
    "docs": "SELECT d.* EXCLUDE (tags), CASE WHEN len(tags) > 0 THEN tags END AS tags, bundle FROM docs d JOIN bundled b ON b.root = d.root AND b.path = d.path", "bodies": "FROM docs",
    "reserved": "SELECT d.*, bundle FROM reserved d JOIN bundled b ON b.root = d.root AND b.path = d.path", "tree": "FROM tree", "findings": "SELECT *, file AS path FROM findings",
    "log_entries": "SELECT *, source AS path, row_number() OVER (PARTITION BY root, source ORDER BY sec, ent) AS place FROM log_table", "checked": "FROM summary", "severities": "FROM summary WHERE errors + warnings + notifications > 0",
}
STORED_SQL = " UNION ALL ".join(f"SELECT '{name}' AS table_name, to_json({{{', '.join(f'{c}: {c}' for c in STORED[name])}}})::VARCHAR AS stored_row FROM ({rows})" for name, rows in STORED_ROWS.items())

def _listed(items: str, ends: str) -> str:
    """SQL of a list a root: `items` gives root, item and n (from 1), `ends` root, head and tail."""
    return f""", items AS ({items}), ends AS ({ends})
        SELECT root, n AS seq, CASE WHEN n > 1 THEN ',' ELSE '' END || item AS piece FROM items UNION ALL SELECT root, 0, head FROM ends
        UNION ALL SELECT root, (SELECT count(*) FROM items i WHERE i.root = e.root) + 1, tail FROM ends e"""


JSON_TAGS = _listed("SELECT root, to_json(tag)::VARCHAR AS item, row_number() OVER (PARTITION BY root ORDER BY tag) AS n FROM (SELECT DISTINCT root, unnest(tags) AS tag FROM docs)", "SELECT root, '[' AS head, ']' AS tail FROM roots")
JSON_VALIDATION = _listed(
    """SELECT root, '{"code":"' || code || '","severity":"' || severity || '","file":' || to_json(file) || ',"message":' || to_json(message) || '}' AS item,
        row_number() OVER (PARTITION BY root ORDER BY string_split(file, '/')[-1] IN ('index.md', 'log.md'), string_split(file, '/'), list_position(['E3', 'W1', 'W2', 'W4', 'N1', 'N2', 'N3'], code)) AS n FROM findings""",
    """SELECT root, '{"summary":{"Files":' || files || ',"Errors":' || errors || ',"Warnings":' || warnings || ',"Notifications":' || notifications || '},"findings":[' AS head, ']}' AS tail FROM summary""",
)
JSON_LOGS = _listed(
    """SELECT root, '{"date":' || to_json(date) || ',"action":' || to_json(action) || ',"target":' || to_json(target) || CASE WHEN coalesce(detail, '') = '' THEN '' ELSE ',"detail":' || to_json(detail) END || ',"source":' || to_json(source) || '}' AS item,
        row_number() OVER (PARTITION BY root ORDER BY date DESC, source, sec, ent) AS n FROM log_table""",
    r"""SELECT root, '{"entries":[' AS head, ']' || CASE WHEN root NOT IN (SELECT root FROM reserved WHERE base = 'log.md') THEN ',"note":"no log.md found"'
        WHEN EXISTS (SELECT 1 FROM reserved r WHERE r.root = o.root AND base = 'log.md' AND trim(body) <> '' AND NOT EXISTS (SELECT 1 FROM log_table l WHERE l.root = r.root AND l.source = r.path)) THEN ',"note":"log.md has malformed entries"' ELSE '' END || '}' AS tail FROM roots o""",
)
JSON_ANSWERS = f"""SELECT query_id, status <> 'ok' AS failed, CASE WHEN status <> 'ok' THEN message ELSE '{{"bundle":' || to_json(bundle) || ',"content":' || to_json(body) || ',"description":' || to_json(description) || ',"file_path":' || to_json(path)
        || ',"tags":' || CASE WHEN len(tags) = 0 THEN 'null' ELSE to_json(tags)::VARCHAR END || ',"title":' || to_json(title) || '}}' END AS value
      FROM (SELECT s.query_id, s.status, {STATUS} AS message, p.body, p.path, p.tags, p.title, p.description, bu.bundle FROM status s LEFT JOIN best b ON b.query_id = s.query_id
        LEFT JOIN docs p ON p.root = b.root AND p.path = b.path LEFT JOIN bundled bu ON bu.root = b.root AND bu.path = b.path)"""

SQL = {
    "classify": "SELECT root, path, kind, coalesce(skip_reason, '') AS skip_reason FROM kinds",
    "skip_report": "SELECT root, path, CASE WHEN NOT has_frontmatter THEN 'no_frontmatter' WHEN bad THEN 'invalid_yaml' ELSE 'missing_type' END AS reason FROM parsed WHERE kind = 'doc' AND (NOT has_frontmatter OR bad OR type = '')",
    "split_frontmatter": "SELECT root, path, has_frontmatter, yaml_block, body_offset, md5(body) AS body_md5 FROM decoded",
    "documents": f"SELECT root, path, title, description, type, {JOINED.format('tags')} AS tags, body_offset FROM docs",
    "merged_frontmatter": """, m AS (SELECT coalesce(source, 'none') AS source, coalesce(doc_id, 0) AS doc_id, coalesce(doc_id, 0) % 6 AS k, coalesce(lang, 'xx') AS lang FROM documents)
        SELECT source AS root, doc_id || '.md' AS path, CASE k WHEN 0 THEN lang WHEN 1 THEN lang WHEN 2 THEN 'more' ELSE '' END AS title, CASE WHEN k IN (1, 2, 4) THEN 'of ' || doc_id ELSE '' END AS description,
          CASE k WHEN 0 THEN 'guide' WHEN 1 THEN 'guide' WHEN 2 THEN 'own' WHEN 4 THEN 'both' ELSE '' END AS type, CASE WHEN k IN (3, 5) THEN '' ELSE source END AS tags, k IN (3, 5) AS refused FROM m""",
    "ingest_warnings": """SELECT root, path, 'missing title' AS message FROM docs WHERE title = '' UNION ALL SELECT root, path, 'missing description' FROM docs WHERE description = ''
        UNION ALL SELECT root, path, 'skipping ' || path FROM parsed WHERE kind = 'doc' AND bad UNION ALL SELECT root, '', 'no conformant docs' FROM roots WHERE root NOT IN (SELECT root FROM docs)""",
    "reserved_files": "SELECT root, path, has_frontmatter, type FROM reserved",
    "bundles": "SELECT root, path, bundle FROM bundled",
    "list_docs": f"SELECT d.root, title, description, {JOINED.format('tags')} AS tags, d.path AS file_path, bundle FROM docs d JOIN bundled b ON b.root = d.root AND b.path = d.path",
    "list_tags": "SELECT DISTINCT root, unnest(tags) AS tag FROM docs",
    "type_vocabulary": "SELECT DISTINCT root, type FROM docs",
    "tokenise": r"SELECT query_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), '|') AS tokens FROM (SELECT query_id, list_filter(regexp_split_to_array(lower(topic), '[^\p{L}\p{Nd}]+'), lambda x: x <> '') AS w FROM queries)",
    "tag_filter": "SELECT query_id, root, path FROM passing WHERE pass",
    "score": "SELECT query_id, root, path, score FROM scores",
    "find_best": BEST,
    "find_best_vocab": BEST,
    "get_doc": GET_DOC,
    "get_doc_status": f"SELECT query_id, status, {STATUS} AS message FROM status",
    "validate_bundle": "SELECT root, file, code, severity, message FROM findings",
    "validate_paths": r"""SELECT root, file, code, severity, message FROM findings
        UNION ALL SELECT root, path, 'W3', 'warning', 'unknown type "' || type || '" (not in known vocabulary)' FROM docs WHERE type NOT IN ('Architecture', 'Log')
        UNION ALL SELECT root, path, 'E1', 'error', 'missing YAML frontmatter (file must start with ---)' FROM parsed WHERE kind = 'doc' AND NOT has_frontmatter
        UNION ALL SELECT root, path, 'E2', 'error', CASE WHEN bad THEN 'invalid YAML frontmatter' ELSE 'empty or missing type field in frontmatter' END FROM parsed WHERE kind = 'doc' AND has_frontmatter AND (bad OR type = '')
        UNION ALL SELECT root, 'missing.md', 'E0', 'error', 'read error: file can''t be read' FROM roots""",
    "summary": "SELECT * FROM summary",
    "gate": "SELECT *, CASE WHEN errors > 0 THEN 1 ELSE 0 END AS status FROM summary",
    "report_lines": """SELECT root, file || ': [' || code || '] ' || severity || ': ' || message AS report_line FROM findings
        UNION ALL SELECT root, files || ' files: ' || errors || ' errors, ' || warnings || ' warnings, ' || notifications || ' notifications' FROM summary""",
    "tree": TREE,
    "subtree": f"{TREE} WHERE path = 'en/d1' OR starts_with(path, 'en/d1/')",
    "tree_json": """, euler AS (
          SELECT root, path, []::BIGINT[] AS walk FROM tree WHERE path = '' UNION ALL SELECT t.root, t.path, list_append(e.walk, t.ord) FROM euler e JOIN tree t ON t.root = e.root AND t.parent_path = e.path
        ), events AS (
          SELECT root, walk AS place_key, (CASE WHEN ord > 1 THEN ',' ELSE '' END) || '{"name":' || to_json(name) || ',"path":' || to_json(path) || ',"type":"' || node_type || '"' || CASE WHEN coalesce(doc_type, '') = '' THEN '' ELSE ',"doc_type":' || to_json(doc_type) END
            || CASE WHEN coalesce(title, '') = '' THEN '' ELSE ',"title":' || to_json(title) END || CASE WHEN coalesce(bundle, '') = '' THEN '' ELSE ',"bundle":' || to_json(bundle) END || CASE WHEN node_type = 'directory' THEN ',"children":[' ELSE '' END AS piece
          FROM tree JOIN euler USING (root, path)
          UNION ALL SELECT root, list_append(walk, 2147483647), CASE WHEN node_type = 'directory' THEN ']}' ELSE '}' END FROM tree JOIN euler USING (root, path)
          UNION ALL SELECT root, [], '{"name":".","path":"","type":"directory"}' FROM roots WHERE root NOT IN (SELECT root FROM tree)
        ) SELECT root, row_number() OVER (PARTITION BY root ORDER BY place_key) - 1 AS seq, piece FROM events""",
    "subtrees": f""", requests AS (
          SELECT item_id AS request_id, 'src' || (item_id % 20) AS root, {testcorpus.REQUEST} FROM benchmark WHERE item_id IS NOT NULL
          UNION ALL SELECT item_id + 1000000, 'nosrc' || (item_id % 3), CASE WHEN item_id % 2 = 0 THEN '' ELSE 'x' END FROM benchmark WHERE item_id IS NOT NULL
        ), asked AS (SELECT request_id, root, CASE WHEN coalesce(path, '') = '.' THEN '' ELSE coalesce(path, '') END AS asked FROM requests
        ), euler AS (
          SELECT root, path, []::BIGINT[] AS walk FROM tree WHERE path = '' UNION ALL SELECT t.root, t.path, list_append(e.walk, t.ord) FROM euler e JOIN tree t ON t.root = e.root AND t.parent_path = e.path
        ), found AS (
          SELECT a.request_id, a.root, 'ok' AS status, '' AS message, row_number() OVER (PARTITION BY a.request_id ORDER BY walk) - 1 AS place, t.path, t.parent_path, t.name, t.depth, t.node_type, t.doc_type, t.title, t.bundle, t.ord
          FROM asked a JOIN tree x ON x.root = a.root AND x.path = a.asked JOIN tree t ON t.root = a.root AND (a.asked = '' OR t.path = a.asked OR starts_with(t.path, a.asked || '/')) JOIN euler e ON e.root = t.root AND e.path = t.path
        ) SELECT * FROM found
        UNION ALL SELECT request_id, root, 'ok', '', 0, '', NULL, '.', 0, 'directory', NULL, NULL, NULL, 1 FROM asked WHERE asked = '' AND root NOT IN (SELECT root FROM tree)
        UNION ALL SELECT request_id, a.root, 'not_found', 'path ' || {QUOTED.format('asked')} || ' not found in bundle tree', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
          FROM asked a WHERE asked <> '' AND NOT EXISTS (SELECT 1 FROM tree t WHERE t.root = a.root AND t.path = a.asked)""",
    "log_entries": ENTRY,
    "log_entries_by_block": ENTRY,
    "log_checks_by_block": "SELECT root, path AS source, contains(body, '](/') AS linked, dates = list_reverse_sort(dates) AS ordered FROM log_dates WHERE base = 'log.md' AND body <> ''",
    "get_log_since": f"{ENTRY} WHERE date >= '{SINCE}'",
    "get_log_action": f"{ENTRY} WHERE action = '{ACTION}'",
    "get_log_limit": f"{ENTRY} ORDER BY date DESC, source, root, sec, ent LIMIT {LIMIT}",
    "get_log_root_limit": f"{ENTRY} QUALIFY row_number() OVER (PARTITION BY root ORDER BY date DESC, source, sec, ent) <= {LIMIT}",
    "read_corpus": "SELECT root, path, md5(content) AS content_md5 FROM files",
    "read_tree": "SELECT root, path, CASE WHEN ends_with(path, '.md') THEN md5(content) ELSE '' END AS content_md5 FROM classified WHERE coalesce(skip_reason, '') NOT IN ('vcs', 'hidden')",
    "doctree_source": "SELECT root, path, md5(content) AS content_md5 FROM classified WHERE ends_with(path, '.md') AND coalesce(skip_reason, '') NOT IN ('vcs', 'hidden')",
    "json_docs": """SELECT '{"root":' || to_json(d.root) || ',"title":' || to_json(title) || ',"description":' || to_json(description) || ',"tags":' || CASE WHEN len(tags) = 0 THEN 'null' ELSE to_json(tags)::VARCHAR END
        || ',"file_path":' || to_json(d.path) || ',"bundle":' || to_json(bundle) || '}' AS value FROM docs d JOIN bundled b ON b.root = d.root AND b.path = d.path""",
    "json_log": """SELECT '{"date":' || to_json(date) || ',"action":' || to_json(action) || ',"target":' || to_json(target) || CASE WHEN coalesce(detail, '') = '' THEN '' ELSE ',"detail":' || to_json(detail) END
        || ',"source":' || to_json(source) || '}' AS value FROM log_table""",
    "json_tags": JSON_TAGS,
    "json_validation": JSON_VALIDATION,
    "json_logs": JSON_LOGS,
    "json_answers": JSON_ANSWERS,
    "catalog_tables": STORED_SQL,
    "catalog_get_doc": GET_DOC,
    "catalog_summary": "SELECT * FROM summary",
    "catalog_tree": f"SELECT t.*, d.description, coalesce({JOINED.format('d.tags')}, '') AS tags FROM ({TREE}) t LEFT JOIN docs d ON d.root = t.root AND d.path = t.path",
    "log_notes": r"""SELECT root, 'no log.md found' AS note FROM roots WHERE root NOT IN (SELECT root FROM reserved WHERE base = 'log.md')
        UNION ALL SELECT DISTINCT root, 'log.md has malformed entries' FROM reserved r WHERE base = 'log.md' AND trim(body) <> '' AND NOT EXISTS (SELECT 1 FROM log_table l WHERE l.root = r.root AND l.source = r.path)""",
}

# Paths mode looks at every .md file, hidden and version-controlled ones too.
PATHS_SQL = CORPUS_SQL.replace("FROM kinds WHERE kind <> 'skipped'", "FROM (SELECT * EXCLUDE (kind), CASE WHEN base IN ('index.md', 'log.md') THEN 'reserved' ELSE 'doc' END AS kind FROM kinds) WHERE ends_with(base, '.md')")

RECURSIVE_SQL = CORPUS_SQL.replace("WITH d0", "WITH RECURSIVE d0", 1)


def queries() -> dict:
    return {name: (lambda spark, sf_dir, plan=plan: plan(Corpus(spark, sf_dir))) for name, plan in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    own = {"validate_paths": PATHS_SQL, "tree_json": RECURSIVE_SQL, "subtrees": RECURSIVE_SQL}
    return {name: own.get(name, CORPUS_SQL) + sql for name, sql in SQL.items()}
