"""Documentation trees made of the driver's tables by string functions, for the registered queries.

`documents` become markdown files whose paths and front matter vary with the id, `events` change logs, `benchmark`
topics. CORPUS_SQL says the same in DuckDB's SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: A text's first 15 words, which titles, descriptions and topics are made of.
WORD = r"\\p{L}\\p{Nd}"
FIRST = f"regexp_extract(coalesce(text, ''), '^[^{WORD}]*(([{WORD}]+[^{WORD}]+){{0,14}}[{WORD}]*)', 1)"


#: A change log holds at most so many events, so that there are more logs, not longer ones, for more events.
LOG_EVENTS = 100


def _views(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _views(spark, sf_dir, "documents", "events")
    d = t["documents"].selectExpr(
        "coalesce(source, 'none') AS root", "coalesce(doc_id, 0) AS doc_id", "coalesce(lang, 'xx') AS lang", "coalesce(text, '') AS text", "coalesce(doc_id, 0) div 20 AS q",
        f"split(trim(regexp_replace({FIRST}, '[^{WORD}]+', ' ')), ' ') AS w",
    ).selectExpr(
        "*", "q % 17 AS k", "concat('title: \"', array_join(slice(w, 1, 5), ' '), '\"\\n') AS title", "concat('description: \"', array_join(slice(w, 6, 10), ' '), '\"\\n') AS description",
        "CASE q % 3 WHEN 0 THEN 'guide' WHEN 1 THEN 'Architecture' ELSE 'note' END AS kind", "lower(coalesce(get(w, 0), '')) AS w1", "coalesce(get(w, 1), '') AS w2",
    )
    path = """CASE q % 20 WHEN 0 THEN concat('.notes/design/', doc_id, '.md') WHEN 1 THEN concat('.git/', doc_id, '.md') WHEN 2 THEN concat('_draft/', doc_id, '.md')
        WHEN 3 THEN concat(lang, '/', doc_id, '.txt') WHEN 4 THEN concat(lang, '/', doc_id, '.MD') WHEN 5 THEN concat('a/', doc_id, '.md') WHEN 6 THEN concat('a-', doc_id, '.md')
        ELSE concat(lang, '/d', q % 5, '/', doc_id, '.md') END"""
    tags = "concat('tags:\\n  - \"', lang, '\"\\n', CASE WHEN k = 7 THEN '' ELSE concat('  - \"', w1, '\"\\n  - \"', w2, '\"\\n') END)"
    content = f"""CASE k WHEN 0 THEN text WHEN 1 THEN concat('---\\ntype: "guide"\\n', text) WHEN 2 THEN concat('---\\r\\ntype: "guide"\\r\\n---\\r\\n', text)
        WHEN 8 THEN concat('---\\ntype: "guide\\n---\\n', text)
        ELSE concat('---\\n', CASE WHEN k = 3 THEN '' ELSE concat('type: "', kind, '"\\n') END, CASE WHEN k = 4 THEN '' ELSE title END, CASE WHEN k = 5 THEN '' ELSE description END,
          CASE WHEN k = 6 THEN '' WHEN k = 9 THEN 'tags: "one"\\n' ELSE {tags} END, '---\\n', text) END"""
    docs = d.selectExpr("root", f"{path} AS path", f"{content} AS content")
    dirs = d.groupBy("root", "lang").agg(F.min("doc_id").alias("m")).where("m % 3 <> 0")
    index = dirs.selectExpr("root", "concat(lang, '/index.md') AS path", "CASE WHEN m % 3 = 1 THEN '' ELSE '---\\ntype: \"Index\"\\n---\\n' END AS content")
    e = t["events"].where("event_id IS NOT NULL AND ts IS NOT NULL").selectExpr(
        "event_id % 20 AS s", f"event_id div {LOG_EVENTS * 20} AS k", "date_format(ts, 'yyyy-MM-dd') AS day", "event_id", "concat('**', coalesce(event_type, 'none'), '**: `user-', coalesce(user_id, 0), '` — event ', event_id, CASE WHEN event_id % 3 = 0 THEN '\\n  more on it' ELSE '' END) AS line"
    )
    days = e.groupBy("s", "k", "day").agg(F.concat(F.lit("## "), F.col("day"), F.lit("\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "\n")).alias("section"))
    body = F.array_sort(F.collect_list(F.struct("day", "section")))
    logs = days.groupBy("s", "k").agg(F.array_join(F.transform(F.when(F.col("s") % 4 == 0, body).otherwise(F.reverse(body)), lambda x: x["section"]), "\n\n").alias("body"))
    logs = logs.selectExpr(
        "concat('src', s) AS root", "concat('log/b', k, CASE s WHEN 9 THEN '/history.md' ELSE '/log.md' END) AS path",
        "concat(CASE WHEN s % 5 = 0 THEN '' ELSE '---\\ntype: Log\\n---\\n' END, CASE WHEN s % 5 = 1 THEN 'see [x](/x.md)\\n' ELSE '' END, CASE s WHEN 7 THEN replace(body, '**', '__') ELSE body END, '\\n') AS content",
    )
    return docs.union(index).union(logs)


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _views(spark, sf_dir, "benchmark")["benchmark"].where("item_id IS NOT NULL")
    b = b.selectExpr("item_id", f"split(trim(regexp_replace({FIRST}, '[^{WORD}]+', ' ')), ' ') AS w")
    return b.selectExpr(
        "item_id AS query_id", "concat('src', item_id % 20) AS root", "CASE WHEN item_id % 11 = 5 THEN '' WHEN item_id % 11 = 6 THEN 'qqqxyz' WHEN item_id % 11 = 7 THEN concat(get(w, 0), ' \"', coalesce(get(w, 1), ''), '\" \\\\n') ELSE array_join(slice(w, 1, 2), ' ') END AS topic",
        "CASE item_id % 5 WHEN 1 THEN array('en') WHEN 2 THEN array('EN', 'zz') ELSE NULL END AS tags", "CASE WHEN item_id % 21 = 3 THEN 'x\"or' WHEN item_id % 7 = 3 THEN 'xor' WHEN item_id % 7 = 4 THEN '' WHEN item_id % 2 = 0 THEN 'or' ELSE 'and' END AS match",
    )


def merging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A markdown file for each document whose front matter merges mappings into its own."""
    base = "concat('base: &base\n  type: \"guide\"\n  title: \"', coalesce(lang, 'xx'), '\"\n  tags: [\"', coalesce(source, 'none'), '\"]\nmore: &more {title: \"more\", description: \"of ', coalesce(doc_id, 0), '\"}\nboth: &both\n  <<: [*more, *base]\n  type: \"both\"\n')"
    own = """CASE coalesce(doc_id, 0) % 6 WHEN 0 THEN '<<: *base\n' WHEN 1 THEN '<<: [*base, *more]\n' WHEN 2 THEN '<<: [*more, *base]\ntype: "own"\n' WHEN 3 THEN 'type: "a"\n<<: *base\ntype: "b"\n' WHEN 4 THEN '<<: *both\ntitle: null\n' ELSE '<<: "text"\n' END"""
    return _views(spark, sf_dir, "documents")["documents"].selectExpr("coalesce(source, 'none') AS root", "concat(coalesce(doc_id, 0), '.md') AS path", f"concat('---\n', {base}, {own}, '---\n', coalesce(text, '')) AS content")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for parts of trees: whole ones, directories, leaves, and paths that are none."""
    b = _views(spark, sf_dir, "benchmark")["benchmark"].where("item_id IS NOT NULL")
    return b.selectExpr("item_id AS request_id", "concat('src', item_id % 20) AS root", REQUEST).union(b.selectExpr("item_id + 1000000 AS request_id", "concat('nosrc', item_id % 3) AS root", "CASE WHEN item_id % 2 = 0 THEN '' ELSE 'x' END AS path"))


#: The same in both languages.
REQUEST = """CASE item_id % 13 WHEN 0 THEN '' WHEN 1 THEN '.' WHEN 2 THEN 'en' WHEN 3 THEN 'fr/d2' WHEN 4 THEN 'en/' WHEN 5 THEN 'no "such" path' WHEN 6 THEN 'en/index.md' WHEN 7 THEN NULL WHEN 8 THEN 'log/b0' WHEN 9 THEN 'log'
  WHEN 10 THEN 'a' WHEN 11 THEN './en' ELSE 'a/' || cast(100 + item_id % 20 + 400 * (item_id % 2) AS VARCHAR(20)) || '.md' END AS path"""


CORPUS_SQL = r"""
WITH d0 AS (
  SELECT coalesce(source, 'none') AS root, coalesce(doc_id, 0) AS doc_id, coalesce(lang, 'xx') AS lang, coalesce(text, '') AS text, coalesce(doc_id, 0) // 20 AS q,
    string_split(trim(regexp_replace(regexp_extract(coalesce(text, ''), '^[^\p{L}\p{Nd}]*(([\p{L}\p{Nd}]+[^\p{L}\p{Nd}]+){0,14}[\p{L}\p{Nd}]*)', 1), '[^\p{L}\p{Nd}]+', ' ', 'g')), ' ') AS w
  FROM documents
), d AS (
  SELECT *, q % 17 AS k, 'title: "' || array_to_string(w[1:5], ' ') || '"' || chr(10) AS title, 'description: "' || array_to_string(w[6:15], ' ') || '"' || chr(10) AS description,
    CASE q % 3 WHEN 0 THEN 'guide' WHEN 1 THEN 'Architecture' ELSE 'note' END AS kind, lower(coalesce(w[1], '')) AS w1, coalesce(w[2], '') AS w2
  FROM d0
), ev AS (
  SELECT event_id % 20 AS s, event_id // LOG_BLOCK AS k, strftime(ts, '%Y-%m-%d') AS day, event_id,
    '**' || coalesce(event_type, 'none') || '**: `user-' || coalesce(user_id, 0) || '` — event ' || event_id || CASE WHEN event_id % 3 = 0 THEN chr(10) || '  more on it' ELSE '' END AS line
  FROM events WHERE event_id IS NOT NULL AND ts IS NOT NULL
), days AS (SELECT s, k, day, '## ' || day || chr(10) || string_agg(line, chr(10) ORDER BY event_id) AS section FROM ev GROUP BY s, k, day),
logs AS (
  SELECT s, k, CASE WHEN s % 4 = 0 THEN string_agg(section, chr(10) || chr(10) ORDER BY day) ELSE string_agg(section, chr(10) || chr(10) ORDER BY day DESC) END AS body FROM days GROUP BY s, k
), files AS (
  SELECT root,
    CASE q % 20 WHEN 0 THEN '.notes/design/' || doc_id || '.md' WHEN 1 THEN '.git/' || doc_id || '.md' WHEN 2 THEN '_draft/' || doc_id || '.md' WHEN 3 THEN lang || '/' || doc_id || '.txt'
      WHEN 4 THEN lang || '/' || doc_id || '.MD' WHEN 5 THEN 'a/' || doc_id || '.md' WHEN 6 THEN 'a-' || doc_id || '.md' ELSE lang || '/d' || (q % 5) || '/' || doc_id || '.md' END AS path,
    CASE k WHEN 0 THEN text WHEN 1 THEN '---' || chr(10) || 'type: "guide"' || chr(10) || text
      WHEN 2 THEN '---' || chr(13) || chr(10) || 'type: "guide"' || chr(13) || chr(10) || '---' || chr(13) || chr(10) || text
      WHEN 8 THEN '---' || chr(10) || 'type: "guide' || chr(10) || '---' || chr(10) || text
      ELSE '---' || chr(10) || CASE WHEN k = 3 THEN '' ELSE 'type: "' || kind || '"' || chr(10) END || CASE WHEN k = 4 THEN '' ELSE title END || CASE WHEN k = 5 THEN '' ELSE description END
        || CASE WHEN k = 6 THEN '' WHEN k = 9 THEN 'tags: "one"' || chr(10)
          ELSE 'tags:' || chr(10) || '  - "' || lang || '"' || chr(10) || CASE WHEN k = 7 THEN '' ELSE '  - "' || w1 || '"' || chr(10) || '  - "' || w2 || '"' || chr(10) END END
        || '---' || chr(10) || text END AS content
  FROM d
  UNION ALL
  SELECT root, lang || '/index.md', CASE WHEN m % 3 = 1 THEN '' ELSE '---' || chr(10) || 'type: "Index"' || chr(10) || '---' || chr(10) END
  FROM (SELECT root, lang, min(doc_id) AS m FROM d GROUP BY root, lang) WHERE m % 3 <> 0
  UNION ALL
  SELECT 'src' || s, 'log/b' || k || CASE s WHEN 9 THEN '/history.md' ELSE '/log.md' END, CASE WHEN s % 5 = 0 THEN '' ELSE '---' || chr(10) || 'type: Log' || chr(10) || '---' || chr(10) END
    || CASE WHEN s % 5 = 1 THEN 'see [x](/x.md)' || chr(10) ELSE '' END || CASE s WHEN 7 THEN replace(body, '**', '__') ELSE body END || chr(10)
  FROM logs
), parts AS (
  SELECT *, string_split(path, '/') AS seg, string_split(path, '/')[-1] AS base, string_split(path, '/')[:-2] AS dirs FROM files
), classified AS (
  SELECT *, CASE WHEN list_has_any(dirs, ['.git', '.hg', '.svn']) THEN 'vcs' WHEN len(list_filter(dirs, lambda s: s LIKE '.%')) > 0 THEN 'hidden'
    WHEN base NOT IN ('index.md', 'log.md') AND NOT ends_with(base, '.md') THEN 'extension' END AS skip_reason
  FROM parts
), kinds AS (
  SELECT *, CASE WHEN skip_reason IS NOT NULL THEN 'skipped' WHEN base IN ('index.md', 'log.md') THEN 'reserved' ELSE 'doc' END AS kind FROM classified
), split AS (
  SELECT *, CASE WHEN len(dirs) = 0 THEN '.' ELSE array_to_string(dirs, '/') END AS dir,
    regexp_extract(content, '\A---\n((?s:.*?\n)?)---(?:\n|\z)', 0) AS head, regexp_extract(content, '\A---\n((?s:.*?\n)?)---(?:\n|\z)', 1) AS yaml_block
  FROM kinds WHERE kind <> 'skipped'
), decoded AS (
  SELECT *, head <> '' AS has_frontmatter, strlen(head) AS body_offset, CASE WHEN head <> '' THEN substr(content, length(head) + 1) ELSE content END AS body,
    regexp_matches(yaml_block, '(?m)^type: "[^"\n]*$') OR (kind = 'doc' AND regexp_matches(yaml_block, '(?m)^tags: "')) AS bad
  FROM split
), parsed AS (
  SELECT *, CASE WHEN bad THEN '' ELSE regexp_extract(yaml_block, '(?m)^title: "([^"\n]*)"$', 1) END AS title, CASE WHEN bad THEN '' ELSE regexp_extract(yaml_block, '(?m)^description: "([^"\n]*)"$', 1) END AS description,
    CASE WHEN bad THEN '' ELSE regexp_extract(yaml_block, '(?m)^type: "?([^"\n]*)"?$', 1) END AS type, CASE WHEN bad THEN [] ELSE regexp_extract_all(yaml_block, '(?m)^  - "([^"\n]*)"$', 1) END AS tags
  FROM decoded
), docs AS (SELECT * FROM parsed WHERE kind = 'doc' AND has_frontmatter AND NOT bad AND type <> ''),
reserved AS (SELECT * FROM parsed WHERE kind = 'reserved'),
roots AS (SELECT DISTINCT root FROM files),
bundled AS (
  SELECT p.root, p.path, coalesce((
      SELECT arg_max(r.dir, CASE WHEN r.dir = '.' THEN 0 ELSE length(r.dir) END) FROM reserved r
      WHERE r.root = p.root AND r.base = 'index.md' AND (r.dir = '.' OR r.dir = p.dir OR starts_with(p.dir, r.dir || '/'))), p.dir) AS bundle
  FROM (SELECT * FROM docs UNION ALL SELECT * FROM reserved) p
), b0 AS (SELECT item_id, string_split(trim(regexp_replace(regexp_extract(coalesce(text, ''), '^[^\p{L}\p{Nd}]*(([\p{L}\p{Nd}]+[^\p{L}\p{Nd}]+){0,14}[\p{L}\p{Nd}]*)', 1), '[^\p{L}\p{Nd}]+', ' ', 'g')), ' ') AS w FROM benchmark WHERE item_id IS NOT NULL),
queries AS (
  SELECT item_id AS query_id, 'src' || (item_id % 20) AS root, CASE WHEN item_id % 11 = 5 THEN '' WHEN item_id % 11 = 6 THEN 'qqqxyz' WHEN item_id % 11 = 7 THEN w[1] || ' "' || coalesce(w[2], '') || '" \n' ELSE array_to_string(w[1:2], ' ') END AS topic,
    CASE item_id % 5 WHEN 1 THEN ['en'] WHEN 2 THEN ['EN', 'zz'] ELSE [] END AS asked, CASE WHEN item_id % 21 = 3 THEN 'x"or' WHEN item_id % 7 = 3 THEN 'xor' WHEN item_id % 7 = 4 THEN 'and' WHEN item_id % 2 = 0 THEN 'or' ELSE 'and' END AS match
  FROM b0
), pairs AS (
  SELECT q.query_id, q.root, d.path, q.match, q.topic, list_transform(q.asked, lambda x: lower(x)) AS asked, list_transform(d.tags, lambda x: lower(x)) AS tags_lc, lower(d.title) AS t, lower(d.description) AS ds,
    list_distinct(list_filter(regexp_split_to_array(lower(q.topic), '[^\p{L}\p{Nd}]+'), lambda x: x <> '')) AS tokens
  FROM queries q JOIN docs d ON d.root = q.root
), passing AS (
  SELECT *, CASE WHEN match NOT IN ('and', 'or') THEN FALSE WHEN len(asked) = 0 THEN TRUE WHEN match = 'and' THEN list_has_all(tags_lc, asked) ELSE list_has_any(tags_lc, asked) END AS pass FROM pairs
), scores AS (
  SELECT *, CASE WHEN NOT pass THEN -1.0 ELSE coalesce(list_sum(list_transform(tokens, lambda x: CASE WHEN contains(t, x) THEN 3.0 ELSE 0.0 END
      + CASE WHEN len(list_filter(tags_lc, lambda g: contains(g, x))) > 0 THEN 2.0 ELSE 0.0 END + CASE WHEN contains(ds, x) THEN 1.0 ELSE 0.0 END)), 0.0) END::DOUBLE AS score
  FROM passing
), best AS (
  SELECT query_id, root, path, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS n FROM scores WHERE score > 0 AND topic <> '') WHERE n = 1
), status AS (
  SELECT q.query_id, CASE WHEN q.topic = '' THEN 'empty_topic' WHEN q.match NOT IN ('and', 'or') THEN 'invalid_match' WHEN b.path IS NOT NULL THEN 'ok'
      WHEN NOT EXISTS (SELECT 1 FROM docs d WHERE d.root = q.root) THEN 'empty_index' ELSE 'no_match' END AS status, q.topic, q.match, q.asked
  FROM queries q LEFT JOIN best b ON b.query_id = q.query_id
), doc_findings AS (
  SELECT root, path, unnest(list_filter([
    CASE WHEN title = '' THEN {c: 'W1', s: 'warning', m: 'missing title in frontmatter'} END, CASE WHEN description = '' THEN {c: 'W2', s: 'warning', m: 'missing description in frontmatter'} END,
    CASE WHEN len(tags) = 0 THEN {c: 'W4', s: 'warning', m: 'no tags in frontmatter'} END,
    CASE WHEN len(tags) = 1 THEN {c: 'N1', s: 'notification', m: 'only one tag "' || tags[1] || '" — collections typically have multiple tags'} END], lambda x: x IS NOT NULL)) AS f
  FROM docs
), log_dates AS (
  SELECT *, list_filter(list_transform(string_split(body, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: regexp_matches(x, '\A## [0-9]{4}-[0-9]{2}-[0-9]{2}\z')) AS dates FROM reserved
), reserved_findings AS (
  SELECT root, path, unnest(list_filter([
    CASE WHEN base = 'index.md' AND has_frontmatter THEN {c: 'E3', s: 'error', m: 'index.md must not have frontmatter'} END,
    CASE WHEN base = 'log.md' AND NOT has_frontmatter THEN {c: 'E3', s: 'error', m: 'log.md must have frontmatter with type: Log'} END,
    CASE WHEN base = 'log.md' AND has_frontmatter AND type <> 'Log' THEN {c: 'E3', s: 'error', m: 'log.md type must be "Log", got "' || type || '"'} END,
    CASE WHEN base = 'log.md' AND type = 'Log' AND NOT contains(body, '](/') THEN {c: 'N2', s: 'notification', m: 'log.md has no bundle-relative cross-links'} END,
    CASE WHEN base = 'log.md' AND type = 'Log' AND dates <> list_reverse_sort(dates) THEN {c: 'N3', s: 'notification', m: 'log.md date headings are not in reverse-chronological order'} END], lambda x: x IS NOT NULL)) AS f
  FROM log_dates
), findings AS (
  SELECT root, path AS file, f.c AS code, f.s AS severity, f.m AS message FROM doc_findings UNION ALL SELECT root, path, f.c, f.s, f.m FROM reserved_findings
), summary AS (
  SELECT r.root, (SELECT count(*) FROM docs d WHERE d.root = r.root) + (SELECT count(*) FROM reserved d WHERE d.root = r.root) AS files,
    (SELECT count(*) FROM findings f WHERE f.root = r.root AND severity = 'error') AS errors, (SELECT count(*) FROM findings f WHERE f.root = r.root AND severity = 'warning') AS warnings,
    (SELECT count(*) FROM findings f WHERE f.root = r.root AND severity = 'notification') AS notifications
  FROM roots r
), leaves AS (
  SELECT d.root, d.path, 'file' AS node_type, type AS doc_type, title, b.bundle, d.seg, 0 AS r FROM docs d JOIN bundled b ON b.root = d.root AND b.path = d.path
  UNION ALL SELECT d.root, d.path, 'reserved', type, NULL, b.bundle, d.seg, 1 FROM reserved d JOIN bundled b ON b.root = d.root AND b.path = d.path
), dirs AS (
  SELECT root, CASE WHEN n = 0 THEN '' ELSE array_to_string(seg[1:n], '/') END AS path, min({r: r, s: seg}) AS first FROM (SELECT *, unnest(range(0, len(seg))) AS n FROM leaves) GROUP BY 1, 2
), nodes AS (
  SELECT root, path, node_type, doc_type, title, bundle, {r: r, s: seg} AS first FROM leaves UNION ALL SELECT root, path, 'directory', NULL, NULL, NULL, first FROM dirs
), tree AS (
  SELECT *, row_number() OVER (PARTITION BY root, parent_path ORDER BY first) AS ord FROM (
    SELECT *, CASE WHEN path <> '' THEN regexp_replace(path, '/?[^/]*$', '') END AS parent_path, CASE WHEN path = '' THEN '.' ELSE string_split(path, '/')[-1] END AS name,
      CASE WHEN path = '' THEN 0 ELSE len(string_split(path, '/')) END AS depth FROM nodes)
), log_lines AS (
  SELECT root, path AS source, unnest(string_split(body, chr(10))) AS line, unnest(range(0, len(string_split(body, chr(10))))) AS n FROM reserved WHERE base = 'log.md'
), marked AS (
  SELECT *, regexp_extract(line, '^## (\d{4}-\d{2}-\d{2})$', 1) AS heading, regexp_extract(line, '^\*\*(\w+)\*\*:[\t\f\r ]*`([^`]+)`[\t\f\r ]*—[\t\f\r ]*(.+)', 1) AS action FROM log_lines
), numbered AS (
  SELECT *, sum(CASE WHEN heading <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY root, source ORDER BY n) AS sec FROM marked
), placed AS (
  SELECT *, sum(CASE WHEN action <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY root, source, sec ORDER BY n) AS ent FROM numbered WHERE sec > 0
), log_entries AS (
  SELECT root, source, sec, ent, max(heading) AS entry_heading, max(action) AS action, min(n) AS first,
    max(CASE WHEN action <> '' THEN regexp_extract(line, '`([^`]+)`', 1) END) AS target,
    string_agg(CASE WHEN action <> '' THEN trim(regexp_extract(line, '—[\t\f\r ]*(.+)', 1)) ELSE trim(line) END, chr(10) ORDER BY n) FILTER (WHERE heading = '' AND trim(line) <> '') AS detail
  FROM placed WHERE ent > 0 GROUP BY root, source, sec, ent
), log_table AS (
  SELECT e.root, e.source, h.heading AS date, e.action, e.target, e.detail, e.sec, e.ent FROM log_entries e JOIN (SELECT root, source, sec, max(heading) AS heading FROM numbered GROUP BY 1, 2, 3) h USING (root, source, sec)
)
""".replace("LOG_BLOCK", str(LOG_EVENTS * 20))
