"""DuckDB SQL for the queries that SQL can express."""

_OP2 = r"""
WITH it AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS span, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM it WHERE len(w) > 0)
), d AS (
  SELECT doc_id, row_number() OVER () AS rid, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), spans AS (SELECT DISTINCT span FROM win
), pos AS (
  SELECT rid, span, i, array_to_string(w[i : i + span - 1], ' ') AS gram
  FROM (SELECT rid, w, span, unnest(range(1, len(w) - span + 2)) AS i FROM d, spans WHERE len(w) >= span)
), hit AS (SELECT p.rid, p.i, p.span, w.item_id FROM pos p JOIN win w ON p.span = w.span AND p.gram = w.gram
), nh AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(range(i, i + span)) AS x FROM (SELECT DISTINCT rid, i, span FROM hit)) GROUP BY rid
), ids AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT rid, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN nh USING (rid) LEFT JOIN ids USING (rid)
"""

_OP3 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY conv_id) AS n,
    length(regexp_replace(replace(role, '\', '\\'), '([<\[])(\||/?s>|/?INST\])', '\1\\\2', 'g')) AS lr,
    length(regexp_replace(replace(text, '\', '\\'), '([<\[])(\||/?s>|/?INST\])', '\1\\\2', 'g')) AS lt
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), c AS (
  SELECT *, sum(lr + lt + 24) OVER (PARTITION BY conv_id ORDER BY rn) AS upto FROM e
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR rn = n) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

_OP6 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents
), g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), rep AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1
), nr AS (SELECT rid, count(DISTINCT x) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS x FROM rep) GROUP BY rid
), b AS (
  SELECT doc_id, text, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines,
    len(regexp_extract_all(text, '(\.\.\.|…)(\n|$)')) AS n_ellipsis, len(regexp_extract_all(text, '\p{L}+')) AS n_letter_runs
  FROM d LEFT JOIN nr USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR word_chars < 3 * n_words OR word_chars > 10 * n_words
    OR 10 * n_dup_lines > 3 * n_lines OR 10 * n_ellipsis > 3 * n_lines OR 2 * n_letter_runs < n_words) AS kept
FROM b
"""

_OP4 = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), h AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex FROM p
), f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(((
    CAST('0x' || substr(hex || '0000', 1 + 2 * (5 * k // 8), 4) AS INTEGER) >> (11 - 5 * k % 8)) & 31) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

_OP11 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(':' || source, '') AS g, text,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_transform(range(0, 8), lambda j: (ascii(c) >> j) & 1)))),
      lambda c, b: xor(c >> 1, 3988292384 * xor(c & 1, b))) AS crc
  FROM documents
), l AS (
  SELECT doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS other
  FROM d
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM l
), low AS (
  SELECT g, i, n, leaf AS h FROM leaves
  UNION ALL
  SELECT g, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY g, i // 3, n
), heads AS (
  SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1
), top AS (
  SELECT i, n, subroot AS h FROM heads
  UNION ALL
  SELECT i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY i // 3, n
), lowkids AS (SELECT g, n, i // 3 AS p, list(h ORDER BY i) AS kids FROM low WHERE n > 1 GROUP BY g, n, i // 3
), topkids AS (SELECT n, i // 3 AS p, list(h ORDER BY i) AS kids FROM top WHERE n > 1 GROUP BY n, i // 3
), up AS (
  SELECT doc_id, leaf, g, i AS place, i, n, coalesce(other, leaf) AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT u.doc_id, u.leaf, u.g, u.place, u.i // 3, (u.n + 2) // 3,
    sha256(array_to_string(kids[1 : u.i % 3], '') || u.h || array_to_string(kids[u.i % 3 + 2 :], '')), u.proof || array_to_string(kids[1 : u.i % 3], '') || array_to_string(kids[u.i % 3 + 2 :], '')
  FROM up u JOIN lowkids k ON u.g = k.g AND u.n = k.n AND u.i // 3 = k.p
), upper AS (
  SELECT u.doc_id, u.leaf, u.g, u.place, s.subroot, s.i, s.n, u.h, u.proof FROM up u JOIN heads s ON u.g = s.g WHERE u.n = 1
  UNION ALL
  SELECT u.doc_id, u.leaf, u.g, u.place, u.subroot, u.i // 3, (u.n + 2) // 3,
    sha256(array_to_string(kids[1 : u.i % 3], '') || u.h || array_to_string(kids[u.i % 3 + 2 :], '')), u.proof || array_to_string(kids[1 : u.i % 3], '') || array_to_string(kids[u.i % 3 + 2 :], '')
  FROM upper u JOIN topkids k ON u.n = k.n AND u.i // 3 = k.p
)
SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = (SELECT h FROM top WHERE n = 1) AS verified
FROM upper WHERE n = 1
"""

ORACLE_SQL = {"op11_merkle": _OP11, "op4_warc": _OP4, "op2_decontaminate": _OP2, "op3_chat_format": _OP3, "op6_quality_rules": _OP6}
