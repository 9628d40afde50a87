"""DuckDB statements for the queries of this subpackage that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op10_url_filters"] = r"""
WITH RECURSIVE parts AS (
  SELECT page_id, url, html,
    coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '') AS rest
  FROM pages
), base AS (
  SELECT page_id, url, html,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(verdict, rule_host, prefix) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fits AS (
  SELECT b.page_id, r.rule_host || r.prefix AS rule, r.verdict,
    row_number() OVER (PARTITION BY b.page_id ORDER BY length(r.rule_host || r.prefix) DESC, r.verdict) AS k
  FROM base b JOIN rules r
    ON (b.host = r.rule_host OR ends_with(b.host, '.' || r.rule_host)) AND starts_with(b.path, r.prefix)
), own AS (SELECT * FROM fits WHERE k = 1),
keyed AS (
  SELECT b.*, o.rule, o.verdict,
    CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(url, '^([^#]*)', 1) END AS key,
    regexp_extract(regexp_extract(coalesce(html, ''),
      '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS target
  FROM base b LEFT JOIN own o USING (page_id)
), edges AS (
  SELECT key AS a, target AS b FROM keyed WHERE target LIKE '%://%' AND key IS NOT NULL AND key <> target
  UNION SELECT target, key FROM keyed WHERE target LIKE '%://%' AND key IS NOT NULL AND key <> target
), reach(start, node) AS (
  SELECT a, a FROM edges UNION SELECT r.start, e.b FROM reach r JOIN edges e ON r.node = e.a
), blocked AS (
  SELECT DISTINCT r.start FROM reach r JOIN keyed k ON k.key = r.node WHERE k.verdict = 'block'
)
SELECT k.page_id, k.host, k.path, k.rule,
  coalesce(k.verdict, CASE WHEN b.start IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM keyed k LEFT JOIN blocked b ON b.start = k.key
"""

ORACLE["op8_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t
  FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t
  FROM benchmark
), bl AS (SELECT item_id, len(t) AS n, least(13, len(t)) AS w, t FROM b WHERE len(t) > 0),
dw AS (SELECT doc_id, len(t) AS n, unnest(t) AS word, generate_subscripts(t, 1) AS i FROM d),
bw AS (SELECT item_id, n, w, unnest(t) AS word, generate_subscripts(t, 1) AS j FROM bl),
same AS (
  SELECT doc_id, item_id, i - j AS shift, j, dw.n AS doc_n, bw.n AS item_n, w, CAST(ceil(w * 0.8) AS BIGINT) AS least_same
  FROM dw JOIN bw USING (word)
), laid AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, shift) AS total FROM same
  WHERE least(item_n, doc_n - shift) - greatest(0, -shift) >= w
), near AS (
  SELECT doc_id, item_id, least_same,
    count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY j RANGE BETWEEN 12 PRECEDING AND CURRENT ROW) AS here
  FROM laid WHERE total >= least_same
), hits AS (SELECT DISTINCT doc_id, item_id FROM near WHERE here >= least_same)
SELECT d.doc_id, count(h.item_id) > 0 AS contaminated, count(h.item_id) AS n_items
FROM d LEFT JOIN hits h USING (doc_id) GROUP BY d.doc_id
"""

ORACLE["op2_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM documents
), starts AS (
  SELECT doc_id, unnest(range(1, len(t) - 48)) AS i, t FROM w WHERE len(t) >= 50
), windows AS (
  SELECT doc_id, i, hash(array_to_string(t[i:i + 49], ' ')) AS h, md5(array_to_string(t[i:i + 49], ' ')) AS g FROM starts
), firsts AS (SELECT h, g, min(doc_id) AS least FROM windows GROUP BY h, g),
repeats AS (SELECT doc_id, i FROM windows JOIN firsts USING (h, g) WHERE least < doc_id),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS places FROM repeats GROUP BY doc_id),
words AS (SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) AS i FROM w),
dropped AS (SELECT doc_id, unnest(places) AS i FROM gone),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
)
SELECT w.doc_id, len(w.t) AS n_words, coalesce(len(gone.places), 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLE["op9_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(t[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, t, unnest(range(1, greatest(len(t) - 3, 2))) AS i FROM w WHERE len(t) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k * 10 >= 8 * (x.n + y.n - k)
), reach(start, node) AS (
  SELECT a, a FROM links UNION SELECT r.start, l.b FROM reach r JOIN links l ON r.node = l.a
), classes AS (SELECT start AS doc_id, min(node) AS class_id FROM reach GROUP BY 1),
counts AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY 1)
SELECT w.doc_id, coalesce(c.class_id, w.doc_id) AS class_id, coalesce(k.n_links, 0) AS n_links
FROM w LEFT JOIN classes c USING (doc_id) LEFT JOIN counts k USING (doc_id)
"""

ORACLE["op11_prefix_trie"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'role': role, 'text': text}
    ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text), length(text)) AS seq
  FROM turns GROUP BY conv_id
), heads AS (
  SELECT conv_id, seq, xor(4294967295, list_reduce(
    list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
    lambda a, c: list_reduce(range(0, 8),
      lambda b, k: CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END, xor(a, c)),
    4294967295::BIGINT)) % 6 AS h
  FROM own
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.seq[1:c.h], []), c.seq[c.h + 1:]) AS seq
  FROM heads c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100
), prefixes AS (
  SELECT conv_id, len(seq) AS n, d, seq[1:d] AS p FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM prefixes GROUP BY p, d
), families AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
counted AS (
  SELECT n.*, coalesce(f.n_children, 0) AS n_children,
    CASE WHEN n.d = 0 THEN 0 ELSE (n.n_convs - 1) * length(n.p[n.d].text) END AS saved
  FROM nodes n LEFT JOIN families f ON f.p = n.p AND f.d = n.d
), subtrees AS (
  SELECT p[1:k] AS p, k AS d, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM (SELECT p, saved, n_children, unnest(range(0, d + 1)) AS k FROM counted) GROUP BY ALL
)
SELECT c.conv_id, c.d::BIGINT AS depth, u.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves,
  s.saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
FROM counted c JOIN subtrees s ON s.p = c.p AND s.d = c.d
LEFT JOIN nodes u ON c.d > 0 AND u.d = c.d - 1 AND u.p = c.p[1:c.d - 1]
"""
