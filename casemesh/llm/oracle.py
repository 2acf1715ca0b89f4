"""SQL for the queries that SQL can express over whole tables, with literals of its own."""

WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DEDUP = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS.format(text=LOWER.format(text="coalesce(text, '')"))} AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1),
                                          lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * c >= 85 * (nx.n + ny.n - c)
), e AS (SELECT x, y FROM l UNION SELECT y, x FROM l
), r(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT e.y, r.root FROM r JOIN e ON r.doc_id = e.x
), m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept
FROM m LEFT JOIN n USING (doc_id)
"""

HOST_RULES = rf"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         {WORDS.format(text="coalesce(text, '')")} AS ws
  FROM documents
), g AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), again AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS t(k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM w)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT w.doc_id, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
), h AS (
  SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f
  FROM f WHERE source IS NOT NULL GROUP BY source
), t AS (
  SELECT count(*) AS k, sum(n) AS n, sum(f) / sum(n) AS p, sum(n * n) AS nn, sum(f) AS f,
         sum(f * f / n) AS ff FROM h
), b AS (
  SELECT p, p * (1 - p) AS noise,
         (ff - p * f - (k - 1) * p * (1 - p)) / nullif(n - nn / n, 0) AS between FROM t
), a AS (
  SELECT p, least(greatest(CASE WHEN between > 0 THEN noise / between - 1 ELSE 10000 END, 1), 10000) AS v
  FROM b
), v AS (
  SELECT source, (f + p * v) / (n + v) AS rate, n + v AS size FROM h, a
), k AS (
  SELECT source, rate - 2 * sqrt(rate * (1 - rate) / (size + 1)) <= 0.5 AS host_kept FROM v
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(host_kept, TRUE) AS kept
FROM f LEFT JOIN k USING (source)
"""


def _level(key: str, above: str) -> str:
    """One level of shrinking: its counts, the weight of its prior, its rate for each host."""
    return f"""
{key}_n AS (SELECT {key}, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM o GROUP BY {key}),
{key}_s AS (
  SELECT m * (1 - m) AS noise,
         (sum((bad - n * m) * (bad - n * m) / n) - (count(*) - 1) * m * (1 - m))
           / nullif(sum(n) - sum(n * n) / sum(n), 0) AS between
  FROM {key}_n, t GROUP BY m
),
{key}_w AS (
  SELECT least(greatest(CASE WHEN between > 0 THEN noise / between - 1 ELSE 1000 END, 1), 1000) AS v
  FROM {key}_s
),
{key}_r AS (
  SELECT a.host, a.domain, a.suffix, coalesce(n, 0) + v AS size,
         (coalesce(bad, 0) + v * a.rate) / (coalesce(n, 0) + v) AS rate
  FROM {above} a LEFT JOIN {key}_n USING ({key}), {key}_w
)"""


URL_FILTERS = rf"""
WITH u AS (
  SELECT page_id,
         {LOWER.format(text="coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
),
parts AS (
  SELECT DISTINCT host, regexp_extract(host, '[^.]*$') AS suffix,
         regexp_extract(host, '([^.]*[.])?[^.]*$') AS domain FROM u
),
o AS (
  SELECT host, any_value(domain) AS domain, any_value(suffix) AS suffix,
         count(*) AS n, sum(1 - quality) AS bad
  FROM u JOIN labels ON doc_id = page_id JOIN parts USING (host)
  WHERE quality IS NOT NULL GROUP BY host
),
t AS (SELECT sum(bad) / sum(n) AS m FROM o),
base AS (SELECT host, domain, suffix, m AS rate FROM parts, t),
{_level("suffix", "base")},
{_level("domain", "suffix_r")},
{_level("host", "domain_r")},
k AS (SELECT host, rate - 2 * sqrt(rate * (1 - rate) / (size + 1)) <= 0.5 AS good FROM host_r),
rules(verdict, h, p) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
),
hit AS (
  SELECT DISTINCT host, path, arg_max(h || p, length(h || p)) AS rule,
         arg_max(verdict, length(h || p)) AS verdict
  FROM (SELECT DISTINCT host, path FROM u), rules
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY host, path
)
SELECT page_id, u.host, u.path, rule,
       coalesce(hit.verdict, CASE WHEN good THEN 'allow' ELSE 'block' END) AS verdict
FROM u LEFT JOIN k ON k.host = u.host
LEFT JOIN hit ON hit.host = u.host AND hit.path = u.path
"""

HARD_NEGATIVES = """
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, c.r AS cr, c.vec_id, a.label = c.label AS same,
         list_inner_product(a.q, c.q)::BIGINT AS score
  FROM v a, v c WHERE a.vec_id % 50 = 0 AND a.r <> c.r
),
p AS (
  SELECT * FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, cr) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id,
       row_number() OVER (PARTITION BY p.ar, p.cr ORDER BY n.score DESC, n.vec_id, n.cr)::INT AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.ar = p.ar AND NOT n.same
  AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""

ORACLE_SQL = {
    "op12_bond_hard_negatives": HARD_NEGATIVES,
    "op2_minhash_near_dedup": NEAR_DEDUP,
    "op7_host_quality_rules": HOST_RULES,
    "op9_url_filters": URL_FILTERS,
}
