"""DuckDB SQL for the queries whose results SQL can express."""

OP7 = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), win AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS p FROM w WHERE len(words) >= 13
), keyed AS (
  SELECT doc_id, p, min(doc_id) OVER (PARTITION BY words[p:p + 12]) AS lowest FROM win
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS pos FROM keyed WHERE lowest < doc_id
), flat AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w
), left_over AS (
  SELECT f.doc_id, string_agg(f.word, ' ' ORDER BY f.pos) AS kept, count(*) AS n
  FROM flat f LEFT JOIN gone g ON f.doc_id = g.doc_id AND f.pos = g.pos WHERE g.pos IS NULL GROUP BY f.doc_id
)
SELECT w.doc_id, len(w.words) AS n_words, len(w.words) - coalesce(l.n, 0) AS n_removed, sha256(coalesce(l.kept, '')) AS kept_sha256
FROM w LEFT JOIN left_over l ON w.doc_id = l.doc_id
"""

OP2 = """
WITH RECURSIVE ok AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach(id, to_id) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.to_id
), component AS (SELECT id, min(to_id) AS component_id FROM reach GROUP BY id)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN component c ON c.id = e.vec_id
"""

OP3 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM m
"""

OP12 = r"""
WITH RECURSIVE f AS (
  SELECT doc_id, source, text, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
  FROM documents
), hashed AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h,
    sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS lowered,
    -- crc32 of the decimal id: eight steps a character
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda x, b: list_reduce(list_concat([xor(x, b)], range(8)), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295) AS crc
  FROM f
), leaf AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM hashed
), nodes AS (
  SELECT source, 0 AS lvl, pos, n, h FROM leaf
  UNION ALL SELECT source, lvl + 1, pos // 16, any_value((n + 15) // 16), sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY source, lvl, pos // 16
), subroots AS (
  SELECT source, lvl AS top, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), upper_nodes AS (
  SELECT 0 AS lvl, pos, n, h FROM subroots
  UNION ALL SELECT lvl + 1, pos // 16, any_value((n + 15) // 16), sha256(string_agg(h, '' ORDER BY pos)) FROM upper_nodes WHERE n > 1 GROUP BY lvl, pos // 16
), sides AS (
  SELECT a.source, a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS before_it, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS after_it
  FROM nodes a JOIN nodes b ON a.source IS NOT DISTINCT FROM b.source AND a.lvl = b.lvl AND a.pos // 16 = b.pos // 16 WHERE a.n > 1 GROUP BY ALL
), upper_sides AS (
  SELECT a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS before_it, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS after_it
  FROM upper_nodes a JOIN upper_nodes b ON a.lvl = b.lvl AND a.pos // 16 = b.pos // 16 WHERE a.n > 1 GROUP BY ALL
), way AS (
  SELECT l.source, l.pos, s.lvl, s.before_it, s.after_it FROM leaf l JOIN sides s ON s.source IS NOT DISTINCT FROM l.source AND s.pos = l.pos // (16 ** s.lvl)::BIGINT
  UNION ALL SELECT l.source, l.pos, r.top + s.lvl, s.before_it, s.after_it FROM leaf l JOIN subroots r ON r.source IS NOT DISTINCT FROM l.source JOIN upper_sides s ON s.pos = r.pos // (16 ** s.lvl)::BIGINT
), ways AS (
  SELECT source, pos, string_agg(before_it || after_it, '' ORDER BY lvl) AS siblings, list({b: before_it, a: after_it} ORDER BY lvl) AS steps FROM way GROUP BY source, pos
), root AS (SELECT h FROM upper_nodes WHERE n = 1), proven AS (
  SELECT l.doc_id, l.h AS leaf, r.h AS subroot, root.h AS root, sha256(coalesce(w.siblings, '')) AS proof_sha256,
    list_reduce(list_concat([{b: CASE WHEN l.crc % 5 = 0 THEN l.lowered ELSE l.h END, a: ''}], coalesce(w.steps, [])), lambda x, y: {b: sha256(y.b || x.b || y.a), a: ''}).b AS folded_root
  FROM leaf l JOIN subroots r ON r.source IS NOT DISTINCT FROM l.source CROSS JOIN root LEFT JOIN ways w ON w.source IS NOT DISTINCT FROM l.source AND w.pos = l.pos
)
SELECT *, folded_root = root AS verified FROM proven
"""

OP11 = r"""
WITH docs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), tfs AS (SELECT doc_id, term, count(*) AS tf FROM docs GROUP BY ALL),
lengths AS (SELECT doc_id, count(*) AS n FROM docs GROUP BY doc_id),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), totals),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scores AS (
  SELECT a.item_id, t.doc_id, sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 20 * (50 + (50 * l.n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked a JOIN weights w ON w.term = a.term JOIN tfs t ON t.term = a.term JOIN lengths l ON l.doc_id = t.doc_id CROSS JOIN totals GROUP BY a.item_id, t.doc_id
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 50
"""

ORACLES = {"op2_vector_near_dedup": OP2, "op3_warc": OP3, "op7_substring_dedup": OP7, "op11_ranked_search": OP11, "op12_merkle_manifest": OP12}
