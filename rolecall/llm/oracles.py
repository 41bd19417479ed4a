"""DuckDB texts of the queries that SQL can express on small tables."""

from __future__ import annotations

from rolecall.llm.secret_scan import RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

JACCARD = rf"""
WITH RECURSIVE base AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM base
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(node, root) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node WHERE r.root < e.b
), roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(r.root, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN roots r ON r.node = d.doc_id
"""


def _matches(rank: int) -> str:
    rule = RULES[rank]
    pattern = rule.pattern.replace("'", "''")
    return rf"""
  SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, unnest(gaps[:-2]) AS gap, unnest(whole) AS whole, unnest(part) AS part, generate_subscripts(whole, 1) AS i
  FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}', 0) AS whole, regexp_extract_all(text, '{pattern}', {rule.group}) AS part FROM t)"""


SECRETS = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS ({" UNION ALL ".join(map(_matches, range(len(RULES))))}
), placed AS (
  SELECT *, sum(length(gap) + length(whole)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS finish FROM m
), kept AS (
  SELECT doc_id, rank, kind, finish - length(whole) AS start, concat_ws(':', kind, finish - length(whole), finish) AS span
  FROM placed WHERE length(part) >= CASE kind {" ".join(f"WHEN '{r.kind}' THEN {r.least}" for r in RULES)} END
)
SELECT t.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, rank), '') AS spans
FROM t LEFT JOIN kept ON kept.doc_id = t.doc_id GROUP BY t.doc_id
"""

REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, p, md5(substr(h, (2 * p + 1)::BIGINT, 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS p FROM d)
), late AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w) WHERE k > 1
), runs AS (
  SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run
  FROM (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM late)
), spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM runs GROUP BY ALL
), cuts AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM spans
), sums AS (
  SELECT c.doc_id, count(*) AS n, sum(b - a) AS removed, max(b) AS last, string_agg(substr(h, (2 * z + 1)::BIGINT, (2 * (a - z))::BIGINT), '' ORDER BY a) AS head
  FROM cuts c JOIN d ON d.doc_id = c.doc_id GROUP BY c.doc_id
)
SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, (2 * coalesce(last, 0) + 1)::BIGINT))) AS kept_sha256
FROM d LEFT JOIN sums ON sums.doc_id = d.doc_id
"""

CHAT = r"""
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, concat(conv_id, '-', turn) AS call_id, CASE role WHEN 'user' THEN 'answer' ELSE 'instruct' END AS name,
    len(string_split_regex(trim(text), '\s+')) AS words, text, CASE role WHEN 'user' THEN concat(conv_id, '-', turn - 2) END AS after, count(*) AS copies
  FROM conversations WHERE role IN ('user', 'system') GROUP BY ALL
), results AS (
  SELECT conv_id, turn, concat(conv_id, '-', turn - 1) AS call_id, text AS content, count(*) AS copies FROM conversations WHERE role = 'assistant' GROUP BY ALL
), levels AS (
  SELECT c.conv_id, c.call_id, 0 AS level FROM calls c LEFT JOIN calls p ON p.call_id = c.after WHERE p.call_id IS NULL
  UNION ALL SELECT c.conv_id, c.call_id, l.level + 1 FROM levels l JOIN calls c ON c.after = l.call_id
), linked AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.name, c.words, c.text, c.turn AS call_turn, r.turn AS result_turn, r.content,
    coalesce(c.copies, r.copies) AS copies, CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status
  FROM calls c FULL JOIN results r ON r.call_id = c.call_id
)
SELECT b.conv_id, b.call_id, status, call_turn, result_turn, level, false AS cyclic, copies,
  CASE WHEN name IS NULL THEN NULL ELSE array_to_string(list_filter([
    CASE WHEN text IS NULL THEN 'prompt: missing' WHEN length(text) < 1 THEN 'prompt: too short' END,
    CASE WHEN words < 1 THEN 'words: under 1' WHEN name = 'answer' AND words > 40 THEN 'words: over 40' WHEN name = 'instruct' AND words > 20 THEN 'words: over 20' END
  ], lambda x: x IS NOT NULL), ', ') END AS errors,
  concat('{', CASE WHEN name IS NULL THEN '' ELSE concat('"arguments":{"prompt":', to_json(text), ',"words":', words, '},') END, '"call_id":', to_json(b.call_id),
    CASE WHEN content IS NULL THEN '' ELSE concat(',"content":', to_json(content)) END, ',"conv_id":', b.conv_id,
    CASE WHEN name IS NULL THEN '' ELSE concat(',"name":"', name, '"') END, ',"status":"', status, '"}') AS json
FROM linked b LEFT JOIN levels l ON l.call_id = b.call_id
"""

_FIELDS = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}"))
#: crc32 bit by bit, over the decimal digits of doc_id.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), list_transform(range(8), lambda i: 0::BIGINT)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""

MERKLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, sha256({_FIELDS.format(text="text")}) AS leaf,
    CASE WHEN {_CRC} % 5 = 0 THEN sha256({_FIELDS.format(text=f"translate(text, '{_UPPER}', '{_LOWER}')")}) END AS replaced FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS branch FROM leaves
), nodes AS (
  SELECT branch, 0 AS level, place, n, leaf AS digest FROM placed
  UNION ALL SELECT branch, level + 1, place // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY place)) FROM nodes WHERE n > 1 GROUP BY branch, level, place // 16, n
), subroots AS (SELECT branch, level, digest FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, branch AS place, (SELECT count(*) FROM subroots) AS n, digest FROM subroots
  UNION ALL SELECT level + 1, place // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY place)) FROM tops WHERE n > 1 GROUP BY level, place // 16, n
), whole AS (
  SELECT branch, level, place, n, digest FROM nodes WHERE n > 1
  UNION ALL SELECT s.branch, s.level + t.level, t.place, t.n, t.digest FROM subroots s, tops t
), folds AS (
  SELECT p.doc_id, p.leaf, p.branch, 0 AS level, p.place, w.n, coalesce(p.replaced, p.leaf) AS digest, '' AS siblings
  FROM placed p JOIN (SELECT DISTINCT branch, level, n FROM whole WHERE level = 0) w ON w.branch = p.branch AND p.n > 1
  UNION ALL
  SELECT p.doc_id, p.leaf, p.branch, 0, p.branch, (SELECT count(*) FROM subroots), coalesce(p.replaced, p.leaf), '' FROM placed p WHERE p.n = 1
  UNION ALL
  SELECT f.doc_id, f.leaf, f.branch, f.level + 1, CASE WHEN f.level + 1 = s.level THEN f.branch ELSE f.place // 16 END,
    CASE WHEN f.level + 1 = s.level THEN (SELECT count(*) FROM subroots) ELSE (f.n + 15) // 16 END,
    sha256(string_agg(CASE WHEN w.place = f.place THEN f.digest ELSE w.digest END, '' ORDER BY w.place)),
    f.siblings || coalesce(string_agg(w.digest, '' ORDER BY w.place) FILTER (w.place <> f.place), '')
  FROM folds f JOIN subroots s ON s.branch = f.branch JOIN whole w ON w.branch = f.branch AND w.level = f.level AND w.place // 16 = f.place // 16 WHERE f.n > 1
  GROUP BY f.doc_id, f.leaf, f.branch, f.level, f.place, f.n, f.digest, f.siblings, s.level
)
SELECT f.doc_id, f.leaf, s.digest AS subroot, t.digest AS root, sha256(f.siblings) AS proof_sha256, f.digest AS folded_root, f.digest = t.digest AS verified
FROM folds f JOIN subroots s ON s.branch = f.branch, (SELECT digest FROM tops WHERE n = 1) t WHERE f.n = 1
"""
