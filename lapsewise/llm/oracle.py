"""DuckDB SQL of the operators that SQL expresses."""

ORACLES = {}

ORACLES["op9_url_filter"] = r"""
WITH rest AS (
  SELECT page_id, url, html,
         CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r
  FROM pages),
parts AS (
  SELECT page_id, html,
         translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
listed AS (
  SELECT DISTINCT host, path FROM parts
  WHERE host <> '' AND regexp_matches(html, '[A-Z]{2,}!! [A-Z]{2,}!!')),
fits AS (
  SELECT *, '.' || host AS dotted FROM parts),
ruled AS (
  SELECT page_id, host, path, dotted,
         CASE WHEN dotted LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
              WHEN dotted LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
              WHEN dotted LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
              WHEN dotted LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
              WHEN dotted LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM fits)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN (dotted LIKE '%.cheap-pills.example.com' OR dotted LIKE '%.spam-farm.example.org')
                 AND starts_with(path, '/') THEN 'block'
            WHEN (host, path) IN (SELECT (host, path) FROM listed) THEN 'block'
            ELSE 'allow' END AS verdict
FROM ruled
"""

ORACLES["op10_quality_rules"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
tokens AS (
  SELECT k, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM docs),
words AS (
  SELECT k, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM tokens),
windows AS (
  SELECT k, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g
  FROM words WINDOW o AS (PARTITION BY k ORDER BY i)),
again AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM windows WHERE g IS NOT NULL)
  WHERE n > 1),
repeats AS (
  SELECT k, count(DISTINCT i + d) AS n_repeat_words FROM again, range(3) AS r(d) GROUP BY k),
word_counts AS (
  SELECT k, count(*) AS n_words, sum(length(w)) AS word_chars,
         sum(CASE WHEN regexp_matches(w, '[A-Za-z]|[^\x00-\x7F]') THEN 1 ELSE 0 END) AS alpha_words
  FROM words GROUP BY k),
lines AS (
  SELECT k, unnest(string_split(text, chr(10))) AS line FROM docs),
line_counts AS (
  SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
counts AS (
  SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines, coalesce(alpha_words, 0) AS alpha_words
  FROM docs d LEFT JOIN word_counts USING (k) LEFT JOIN line_counts USING (k) LEFT JOIN repeats USING (k)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
       n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 50 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 12 * n_words
            OR 100 * alpha_words < 40 * n_words) AS kept
FROM judged
"""

ORACLES["op4_jaccard_join"] = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                      'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT k, unnest(CASE WHEN len(w) = 0 THEN []
                                 WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                 ELSE list_transform(range(1, len(w) - 3),
                                                     lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM docs),
sizes AS (SELECT k, count(*) AS n FROM shingles GROUP BY k),
pairs AS (
  SELECT a.k AS x, b.k AS y, count(*) AS i FROM shingles a JOIN shingles b ON a.g = b.g AND a.k < b.k
  GROUP BY 1, 2),
links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.k = x JOIN sizes q ON q.k = y
  WHERE 100 * i >= 80 * (p.n + q.n - i)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(k, r) AS (
  SELECT k, k FROM docs
  UNION
  SELECT reach.k, edges.y FROM reach JOIN edges ON reach.r = edges.x)
SELECT d.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM docs d JOIN reach USING (k) JOIN docs o ON o.k = reach.r LEFT JOIN sizes s ON s.k = d.k
GROUP BY d.k, d.doc_id
"""

ORACLES["op11_decontamination"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 8, 2))) AS i
        FROM items WHERE len(w) > 0)),
places AS (
  SELECT k, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
met AS (SELECT k, i, p.n, item FROM places p JOIN windows USING (n, g)),
hit AS (SELECT k, count(DISTINCT place) AS n_hit
        FROM (SELECT k, unnest(range(i, i + n)) AS place FROM met) GROUP BY k),
named AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT k, item FROM met) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (k) LEFT JOIN named USING (k)
"""

ORACLES["op13_prefix_trie"] = r"""
WITH own AS (
  SELECT conv_id AS c,
         list([coalesce(role, ''), coalesce(text, '')]
              ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
crc AS (
  SELECT c, t, list_reduce(
      list_prepend(4294967295::BIGINT, flatten(list_transform(
          string_split(c::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384 * (s & 1)) END) AS x
  FROM own),
convs AS (
  SELECT a.c, list_concat(coalesce(b.t[1:h], []), a.t[h + 1:]) AS s
  FROM (SELECT c, t, xor(x, 4294967295) % 6 AS h FROM crc) a
  LEFT JOIN own b ON b.c = a.c - a.c % 100),
prefixes AS (
  SELECT c, d, s[1:d] AS p, d = len(s) AS ends, s FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM convs)),
nodes AS (
  SELECT p, d, min(c) AS c, count(*) AS n,
         coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '') AS ids,
         CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * length(p[d][2]) END AS saved
  FROM prefixes GROUP BY p, d),
children AS (
  SELECT p[1:d - 1] AS up, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
own_sums AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children ON up = n.p),
below AS (
  SELECT p[1:u] AS top, sum(saved) AS saved, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves
  FROM (SELECT p, saved, n_children, unnest(range(0, d + 1)) AS u FROM own_sums) GROUP BY 1)
SELECT n.c AS conv_id, n.d::BIGINT AS depth, up.c AS parent_conv_id, n.n AS n_convs, n.n_children,
       b.n_leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, sha256(n.ids) AS ends_sha256
FROM own_sums n JOIN below b ON b.top = n.p
LEFT JOIN nodes up ON n.d > 0 AND up.d = n.d - 1 AND up.p = n.p[1:n.d - 1]
"""
