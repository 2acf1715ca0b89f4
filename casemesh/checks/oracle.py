"""The same results in plain SQL for DuckDB, written without looking at the Spark plans."""

from __future__ import annotations

from casemesh.checks import inputs
from casemesh.functions.text import CONTENT_CLASS
from casemesh.operators import rules as r
from casemesh.operators.evaluate import POISSON

WORD = r"\p{L}\p{N}_"
TOKENS = r"regexp_extract_all(lower(%s), '[\p{L}\p{N}]+')"
MASK = 4294967295


def _words(column: str, words) -> str:
    pattern = f"(^|[^{WORD}])({'|'.join(words)})([^{WORD}]|$)"
    return f"regexp_matches(lower({column}), '{pattern}')"


def _not_blank(column: str) -> str:
    space = (
        r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
        r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
    )
    return f"coalesce(regexp_matches({column}, '[^{space}]'), false)"


DEFAULTS = {rule.name: rule for rule in r.DEFAULT_RULES}
FIRE, WATER = DEFAULTS["emergency"], DEFAULTS["water"]

REQUESTS = """
  SELECT 'D' || doc_id AS complaint_id, text FROM documents
  UNION ALL
  SELECT 'L' || doc_id, CASE WHEN quality = 0 AND toxic = 0 THEN '!!! ???'
                             WHEN quality = 0 AND toxic = 1 THEN 'Error: no sound'
                             WHEN quality = 1 AND toxic = 0 THEN '   ' END
  FROM labels
"""

STAGED = f"""
requests AS ({REQUESTS}),
staged AS (
  SELECT complaint_id, text, CASE
      WHEN NOT {_not_blank('text')} THEN 'pending'
      WHEN starts_with(text, 'Error:') THEN 'failure'
      WHEN NOT regexp_matches(text, '[{CONTENT_CLASS}]') THEN 'rejected'
      WHEN {_words('text', inputs.SCOPE_WORDS)} THEN 'out_of_scope'
      WHEN {_words('text', inputs.EMERGENCY_WORDS)} THEN 'emergency'
      WHEN {_words('text', inputs.WATER_WORDS)} THEN 'water'
      ELSE 'model' END AS status
  FROM requests)
"""

FIELDS = f"""
  CASE status WHEN 'pending' THEN '{r.PENDING}' WHEN 'failure' THEN '{r.FAILURE}'
    WHEN 'rejected' THEN '{r.REJECTED_OFFICER}' WHEN 'out_of_scope' THEN '{r.OUT_OF_SCOPE_OFFICER}'
    WHEN 'emergency' THEN '{FIRE.officer}' WHEN 'water' THEN '{WATER.officer}' END AS officer,
  CASE status WHEN 'pending' THEN '{r.PENDING}' WHEN 'failure' THEN '{r.FAILURE}'
    WHEN 'rejected' THEN '{r.REJECTED_PRIORITY}'
    WHEN 'out_of_scope' THEN '{r.OUT_OF_SCOPE_PRIORITY}'
    WHEN 'emergency' THEN '{FIRE.priority}' END AS priority,
  CASE status WHEN 'pending' THEN '{r.PENDING}' WHEN 'failure' THEN '{r.FAILURE}'
    WHEN 'rejected' THEN '{r.REJECTED_ETA}' WHEN 'out_of_scope' THEN '{r.OUT_OF_SCOPE_ETA}'
    WHEN 'emergency' THEN '{FIRE.eta_label}' END AS eta_label
"""

TRIAGE_RULES = f"WITH {STAGED} SELECT complaint_id, status, {FIELDS} FROM staged"

SPOKEN_WORD = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
TRIAGE_RULE_TABLE = f"""
WITH {STAGED},
spoken AS (SELECT conv_id, turn, {SPOKEN_WORD} AS w FROM conversations),
rule AS (
  SELECT 'R-' || conv_id || '-' || turn AS rule, conv_id * 1000 + turn AS priority,
    conv_id % 5 <> 0 AS forcing, 'Officer_' || turn AS officer, turn, w
  FROM spoken WHERE len(w) >= 3),
keyword AS (
  SELECT DISTINCT rule, unnest([w[1] || ' ' || w[2], w[3]]) AS word FROM rule),
said AS (
  SELECT DISTINCT complaint_id, unnest(regexp_extract_all(lower(text), '[{WORD}]+')) AS one FROM staged),
near AS MATERIALIZED (
  SELECT complaint_id, word
  FROM said JOIN (SELECT DISTINCT word FROM keyword) ON split_part(word, ' ', 1) = one),
hit AS (
  SELECT complaint_id, word FROM near WHERE NOT contains(word, ' ')
  UNION
  SELECT complaint_id, word FROM near JOIN staged USING (complaint_id)
  WHERE contains(word, ' ') AND contains(lower(text), word)
    AND regexp_matches(lower(text), '(^|[^{WORD}])(' || word || ')([^{WORD}]|$)')),
fired AS (
  SELECT complaint_id, rule, forcing, officer, turn FROM hit JOIN keyword USING (word) JOIN rule USING (rule)
  QUALIFY row_number() OVER (PARTITION BY complaint_id ORDER BY forcing, priority, rule) = 1)
SELECT s.complaint_id,
  CASE WHEN status IN ('pending', 'failure', 'rejected') THEN status
    WHEN f.rule IS NULL THEN 'model' WHEN forcing THEN f.rule ELSE 'out_of_scope' END AS status,
  CASE WHEN status NOT IN ('pending', 'failure', 'rejected') THEN f.rule END AS rule,
  CASE WHEN status NOT IN ('pending', 'failure', 'rejected') AND forcing THEN officer END AS forced_officer,
  CASE WHEN status NOT IN ('pending', 'failure', 'rejected') AND forcing AND turn = 0 THEN 'High' END
    AS forced_priority,
  NULL::VARCHAR AS forced_eta
FROM staged s LEFT JOIN fired f USING (complaint_id)
"""

STREAM_AWAITED = f"""
SELECT 'D' || doc_id AS complaint_id,
  CASE WHEN {_not_blank('text')}
    AND (lang = 'de' OR (lang IN ('es', 'fr') AND doc_id % 900 <= {inputs.WAIT_SECONDS})) THEN text END
    AS complaint_text,
  CASE WHEN lang = 'de' THEN NULL ELSE 'file' || doc_id END AS media_path,
  {inputs.WAIT_SECONDS} * (1000 + 2 * doc_id) AS requested_at
FROM documents
"""

ETA_LABEL = """
SELECT event_id,
  CASE WHEN event_type = 'error' THEN '0.1 Days' ELSE printf('%.1f', value) || ' Days' END
    AS eta_label,
  printf('%.1f', value) || ' days' AS plain_label
FROM events
"""


def _media(column: str, otherwise: str) -> str:
    name = f"lower(regexp_replace({column}, '^.*/', ''))"
    cases = " ".join(
        f"WHEN contains({name}, '{word}') THEN 'Media about {word}'" for word in inputs.MEDIA_WORDS
    )
    return f"CASE WHEN {column} IS NULL THEN NULL {cases} ELSE '{otherwise}' END"


OTHERWISE = (
    "There is a serious infrastructure issue in our local municipal division that needs "
    "routing."
)
MEDIA_TEXT = f"SELECT page_id, {_media('url', 'Media')} AS media_text FROM pages"

MEDIA_TRANSCRIPTS = f"""
SELECT p.page_id, coalesce(d.text, {_media('p.url', OTHERWISE)}) AS media_text
FROM pages p LEFT JOIN documents d ON d.doc_id = p.page_id AND d.lang = 'fr'
"""

TWO_INPUTS = f"""
  SELECT d.doc_id, d.lang = 'fr' AS is_file, p.url IS NOT NULL AS has_file,
    CASE WHEN d.lang = 'de' THEN '   ' WHEN d.lang <> 'es' THEN d.text END AS typed,
    {_media('p.url', OTHERWISE)} AS media
  FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id
"""


def _modality(case: str) -> str:
    return f"WITH t AS ({TWO_INPUTS}) SELECT doc_id, CASE {case} END AS complaint_text FROM t"


USABLE = _not_blank("typed")
MODALITY_TEXT_FIRST = _modality(f"WHEN {USABLE} THEN typed WHEN has_file THEN media")
MODALITY_FILE_FIRST = _modality(f"WHEN has_file THEN media WHEN {USABLE} THEN typed")
MODALITY_FLAG = _modality("WHEN is_file THEN media ELSE typed")

HISTORY_CLEAN = """
SELECT 'id_' || (row_number() OVER (ORDER BY d.doc_id) - 1) AS id, d.doc_id, d.lang,
  d.n_chars / 1000.0::DOUBLE AS eta_days
FROM documents d JOIN labels l ON l.doc_id = d.doc_id AND l.quality IS NOT NULL
WHERE d.text IS NOT NULL
"""

HISTORY_CSV = """
SELECT 'H' || d.doc_id AS id, d.text AS complaint_text, 'Officer_' || d.lang AS assigned_officer,
  CASE WHEN l.toxic = 1 THEN 'High' WHEN l.quality = 1 THEN 'Medium' ELSE 'Low' END AS priority,
  d.n_chars / 1000.0::DOUBLE AS eta_days
FROM documents d JOIN labels l ON l.doc_id = d.doc_id
"""

HOLDOUT_SPLIT = """
SELECT ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 4 AS bucket, count(*) AS n,
  sum(doc_id)::BIGINT AS id_sum, bucket = 0 AS held_out
FROM documents GROUP BY bucket
"""

INDEX_UPSERT = """
SELECT 'id_' || vec_id AS id,
  CASE WHEN label < 5 THEN 'first ' ELSE 'second ' END || vec_id AS document,
  'Officer_' || label AS officer, label::DOUBLE AS eta_days, len(embedding) AS width
FROM embeddings
"""


def _nearest(k: int, metric: str = "l2sq", id_column: str = "vec_id") -> str:
    distance = {
        "l2sq": "pow(list_distance(a.v, b.v), 2)",
        "cosine": "1 - list_cosine_similarity(a.v, b.v)",
    }[metric]
    return f"""
vectors AS (SELECT *, embedding::DOUBLE[] AS v FROM embeddings),
compared AS (
  SELECT a.vec_id, b.vec_id AS id, b.label, a.label AS own_label,
    round({distance}, 9) AS distance
  FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id),
nearest AS (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, {id_column}) AS rank
  FROM compared QUALIFY rank <= {k})
"""


def _topk(k: int, metric: str = "l2sq") -> str:
    return f"""WITH {_nearest(k, metric, 'id')}
SELECT vec_id, rank, id, label, round(distance, 4) AS distance FROM nearest"""


SIMILAR_TOPK = _topk(2)
SIMILAR_TOPK_COSINE = _topk(3, "cosine")
PREDICT_NAMED_VECTORS = """
SELECT doc_id, 'Officer_' || lang AS officer,
  CASE WHEN lang IN ('en', 'fr') THEN 'High' ELSE 'Low' END AS priority,
  CASE lang WHEN 'en' THEN 1.5 WHEN 'de' THEN 2.25 ELSE 4.0 END::DOUBLE AS eta_days
FROM documents
"""
SIMILAR_TOPK_REPEATED = """
WITH compared AS (
  SELECT q.vec_id AS asked, q.label, e.vec_id AS id,
    round(pow(list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 2), 9) AS d
  FROM embeddings q, embeddings e),
nearest AS (
  SELECT *, row_number() OVER (PARTITION BY asked ORDER BY d, id) AS rank
  FROM compared QUALIFY rank <= 2)
SELECT way, label::BIGINT AS label, rank, id, round(d, 4) AS distance
FROM nearest, (VALUES ('broadcast'), ('cells')) AS t(way)
"""

TRIAGE_GATE = f"""
WITH {_nearest(1, 'l2sq', 'id')},
best AS (
  SELECT e.vec_id, s.looked_in, e.label,
    CASE WHEN s.looked_in = 'history' THEN n.distance ELSE 2.0 END AS d
  FROM embeddings e CROSS JOIN (VALUES ('history'), ('empty')) s(looked_in)
  JOIN nearest n ON n.vec_id = e.vec_id)
SELECT vec_id, looked_in, round(d, 4) AS best_distance,
  CASE WHEN d > {inputs.GATE} AND label <> 0 THEN 'out_of_scope' ELSE 'in_scope' END AS status,
  CASE WHEN d > {inputs.GATE} AND label <> 0 THEN 'Top Match Semantic Distance: '
    || printf('%.4f', d) || ' (Threshold Limit: {inputs.GATE})' END AS reason
FROM best
"""

MATCH_REPORT = f"""
WITH {_nearest(2, 'l2sq', "'id_' || id")}
SELECT 'id_' || vec_id AS complaint_id,
  string_agg('MATCH DISTANCE: ' || printf('%.4f', distance) || chr(10) || 'COMPLAINT: case ' || id
    || chr(10) || 'ROUTING ASSIGNMENT: Officer_' || label || ' | HISTORICAL PRIORITY: '
    || CASE WHEN label < 5 THEN 'High' ELSE 'Low' END || chr(10) || repeat('-', 60) || chr(10),
    '' ORDER BY rank) AS report
FROM nearest GROUP BY vec_id
"""


MATCH_REPORT_LINES = f"""
WITH {_nearest(2, 'l2sq', "'id_' || id")},
lines AS (
  SELECT vec_id, string_agg(' -> [Match Dist: ' || printf('%.4f', distance) || '] case ' || id || chr(10)
    || '    Resolved by: Officer_' || label || ' | Past Priority: '
    || CASE WHEN label < 5 THEN 'High' ELSE 'Low' END || chr(10) || chr(10), '' ORDER BY rank) AS found
  FROM nearest GROUP BY vec_id)
SELECT 'id_' || l.vec_id AS complaint_id,
  repeat('-', 15) || ' ML INFERENCE ENGINE RESULTS ' || repeat('-', 15) || chr(10)
  || ' Assigned Officer : Officer_' || e.label || chr(10)
  || ' Predicted Priority: ' || CASE WHEN e.label < 5 THEN 'High' ELSE 'Low' END || chr(10)
  || ' Estimated ETA     : ' || e.label || '.0 days' || chr(10) || repeat('-', 59) || chr(10) || chr(10)
  || repeat('-', 16) || ' SEMANTIC RETRIEVAL MATCHES ' || repeat('-', 16) || chr(10)
  || found || repeat('=', 50) AS report
FROM lines l JOIN embeddings e ON e.vec_id = l.vec_id
"""


# --- hashed term weights -------------------------------------------------------------
# The vectors are term counts in 384 buckets chosen by 32-bit MurmurHash3 (seed 42),
# weighted by ln((documents + 1) / (documents with the bucket + 1)), at unit length.


def _rotate(x: str, bits: int) -> str:
    return f"(((({x}) << {bits}) | (({x}) >> {32 - bits})) & {MASK})"


def _times(x: str, factor: int) -> str:
    return f"((({x}) * {factor}::UBIGINT) & {MASK})"


def _mix(word: str) -> str:
    return _times(_rotate(_times(word, 0xCC9E2D51), 15), 0x1B873593)


HASHED = f"""
terms AS (SELECT DISTINCT unnest({TOKENS % 'text'}) AS term FROM all_texts),
bytes AS (
  SELECT term, hex(encode(term)) AS h, octet_length(encode(term)) AS n FROM terms),
words AS (
  SELECT term, n, list_transform(range(0, n // 4), lambda i: ('0x' || substr(h, 8 * i + 7, 2)
      || substr(h, 8 * i + 5, 2) || substr(h, 8 * i + 3, 2) || substr(h, 8 * i + 1, 2))::UBIGINT)
      AS blocks,
    CASE n % 4 WHEN 0 THEN 0::UBIGINT
      WHEN 1 THEN ('0x' || substr(h, 2 * n - 1, 2))::UBIGINT
      WHEN 2 THEN ('0x' || substr(h, 2 * n - 1, 2) || substr(h, 2 * n - 3, 2))::UBIGINT
      ELSE ('0x' || substr(h, 2 * n - 1, 2) || substr(h, 2 * n - 3, 2)
        || substr(h, 2 * n - 5, 2))::UBIGINT END AS tail
  FROM bytes),
mixed AS (
  SELECT term, n, xor(list_reduce(
      list_prepend(42::UBIGINT, list_transform(blocks, lambda w: {_mix('w')})),
      lambda s, w: ({_rotate('xor(s, w)', 13)} * 5 + 3864292196::UBIGINT) & {MASK}),
      {_mix('tail')}) AS s0
  FROM words),
final1 AS (SELECT term, xor(s0, n::UBIGINT) AS s1 FROM mixed),
final2 AS (SELECT term, {_times('xor(s1, s1 >> 16)', 0x85EBCA6B)} AS s2 FROM final1),
final3 AS (SELECT term, {_times('xor(s2, s2 >> 13)', 0xC2B2AE35)} AS s3 FROM final2),
buckets AS (
  SELECT term, CASE WHEN h >= 2147483648 THEN (h::BIGINT - 4294967296) ELSE h::BIGINT END AS s,
    ((s % 384) + 384) % 384 AS bucket
  FROM (SELECT term, xor(s3, s3 >> 16) AS h FROM final3)),
counts AS (
  SELECT id, bucket, count(*) AS c
  FROM (SELECT id, unnest({TOKENS % 'text'}) AS term FROM all_texts) JOIN buckets USING (term)
  GROUP BY id, bucket),
idf AS (
  SELECT bucket, ln(((SELECT count(*) FROM fitted) + 1.0) / (count(*) + 1.0)) AS idf
  FROM counts WHERE id IN (SELECT id FROM fitted) GROUP BY bucket),
weights AS (
  SELECT id, bucket, c * coalesce(idf, ln((SELECT count(*) FROM fitted) + 1.0)) AS w
  FROM counts LEFT JOIN idf USING (bucket)),
lengths AS (SELECT id, sqrt(sum(w * w)) AS length FROM weights GROUP BY id),
unit AS (
  SELECT id, bucket, CASE WHEN length > 0 THEN w / length ELSE 0 END AS w
  FROM weights JOIN lengths USING (id)),
dense AS (
  SELECT t.id, list(coalesce(u.w, 0.0)::DOUBLE ORDER BY b.bucket) AS v
  FROM all_texts t CROSS JOIN (SELECT unnest(range(384)) AS bucket) b
  LEFT JOIN unit u ON u.id = t.id AND u.bucket = b.bucket GROUP BY t.id)
"""

DOCUMENT_TEXTS = """
all_texts AS (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL),
fitted AS (SELECT id FROM all_texts)
"""

TEXT_FEATURES = f"""
WITH {DOCUMENT_TEXTS}, {HASHED}
SELECT t.id AS doc_id, count(u.w) FILTER (u.w > 0) AS buckets,
  round(coalesce(sum(u.w), 0), 4) AS weight
FROM all_texts t LEFT JOIN unit u ON u.id = t.id GROUP BY t.id
"""

SIMILAR_TEXT_TOPK = f"""
WITH all_texts AS (
  SELECT 'D' || doc_id AS id, doc_id, NULL AS complaint_id, text FROM documents
  UNION ALL
  SELECT 'C' || conv_id || '-' || turn, NULL, conv_id || '-' || turn, text
  FROM conversations),
fitted AS (SELECT id FROM all_texts WHERE doc_id IS NOT NULL),
{HASHED},
compared AS (
  SELECT qt.complaint_id, dt.doc_id, round(1 - list_inner_product(q.v, d.v), 9) AS distance
  FROM all_texts qt JOIN dense q ON q.id = qt.id,
       all_texts dt JOIN dense d ON d.id = dt.id
  WHERE qt.complaint_id IS NOT NULL AND dt.doc_id IS NOT NULL),
nearest AS (
  SELECT *, row_number() OVER (PARTITION BY complaint_id ORDER BY distance, doc_id) AS rank
  FROM compared QUALIFY rank <= 2)
SELECT complaint_id, rank, doc_id, round(distance, 4) AS distance FROM nearest
"""

DUPLICATES = f"""
{DOCUMENT_TEXTS},
counts AS (
  SELECT id, term, count(*) AS c
  FROM (SELECT id, unnest({TOKENS % 'text'}) AS term FROM all_texts) GROUP BY id, term),
idf AS (
  SELECT term, ln(((SELECT count(*) FROM all_texts) + 1.0) / (count(*) + 1.0)) AS idf
  FROM counts GROUP BY term),
weights AS (SELECT id, term, c * idf AS w FROM counts JOIN idf USING (term) WHERE idf > 0),
lengths AS (SELECT id, sqrt(sum(w * w)) AS length FROM weights GROUP BY id),
firsts AS (
  SELECT id, min(id) OVER (PARTITION BY array_to_string({TOKENS % 'text'}, ' ')) AS first
  FROM all_texts),
reps AS (
  SELECT w.id, term, w / length AS w
  FROM weights w JOIN lengths USING (id) JOIN firsts f ON f.id = w.id AND f.first = f.id),
products AS (
  SELECT x.id AS a, y.id AS b, round(1 - sum(x.w * y.w), 9) AS distance
  FROM reps x JOIN reps y ON x.term = y.term AND x.id < y.id GROUP BY x.id, y.id),
pairs AS (
  SELECT a, b, distance FROM products
  WHERE distance <= round(1 - {inputs.DUPLICATE_COSINE}, 9)
  UNION ALL
  SELECT first, id, 0.0 FROM firsts WHERE first < id)
"""

DUPLICATE_PAIRS = f"""
WITH {DUPLICATES} SELECT a, b, round(1 - distance, 4) AS similarity FROM pairs
"""

DUPLICATE_CLUSTERS = f"""
WITH RECURSIVE {DUPLICATES},
both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (
  SELECT a AS id, a AS other FROM both_ways
  UNION
  SELECT r.id, e.b FROM reach r JOIN both_ways e ON e.a = r.other)
SELECT id AS doc_id, min(other) AS cluster FROM reach GROUP BY id
"""

SCOPE_REPORT = r.OUT_OF_SCOPE_REPORT.replace("\n", "' || chr(10) || '")
TRIAGE_EXPLAINED = f"""
WITH {STAGED},
history AS (
  SELECT 'H' || d.doc_id AS id, d.text, 'Officer_' || d.lang AS officer,
    CASE WHEN l.toxic = 1 THEN 'High' WHEN l.quality = 1 THEN 'Medium' ELSE 'Low' END AS priority
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
all_texts AS (
  SELECT id, text FROM history
  UNION ALL
  SELECT complaint_id, text FROM staged WHERE status IN ('emergency', 'water', 'model')),
fitted AS (SELECT id FROM history),
{HASHED},
single AS (SELECT id, v::FLOAT[]::DOUBLE[] AS v FROM dense),
compared AS (
  SELECT q.id AS complaint_id, h.id, round(pow(list_distance(q.v, h.v), 2), 9) AS distance
  FROM single q, single h WHERE q.id NOT IN (SELECT id FROM fitted)
    AND h.id IN (SELECT id FROM fitted)),
nearest AS (
  SELECT *, row_number() OVER (PARTITION BY complaint_id ORDER BY distance, id) AS rank
  FROM compared QUALIFY rank <= 2),
found AS (
  SELECT n.complaint_id, min(n.distance) AS best_distance,
    string_agg('MATCH DISTANCE: ' || printf('%.4f', distance) || chr(10) || 'COMPLAINT: ' || h.text
      || chr(10) || 'ROUTING ASSIGNMENT: ' || h.officer || ' | HISTORICAL PRIORITY: '
      || h.priority || chr(10) || repeat('-', 60) || chr(10), '' ORDER BY rank) AS blocks
  FROM nearest n JOIN history h USING (id) GROUP BY n.complaint_id),
gated AS (
  SELECT s.complaint_id, f.best_distance, f.blocks, s.status AS ruled,
    CASE WHEN s.status = 'model' AND f.best_distance > {inputs.GATE} THEN 'out_of_scope'
      ELSE s.status END AS status
  FROM staged s LEFT JOIN found f ON f.complaint_id = s.complaint_id)
SELECT complaint_id, status, {FIELDS}, round(best_distance, 4) AS best_distance,
  CASE WHEN status = 'pending' THEN '{r.PENDING_REPORT}' WHEN status = 'failure'
    THEN '{r.FAILURE_REPORT}' WHEN status = 'rejected' THEN '{r.REJECTED_REPORT}'
    WHEN ruled = 'out_of_scope' THEN '{SCOPE_REPORT}' || '{r.KEYWORD_REASON}'
    WHEN status = 'out_of_scope' THEN '{SCOPE_REPORT}' || '{r.DISTANCE_REASON}'
      || printf('%.4f', best_distance) || ' (Threshold Limit: {inputs.GATE})'
    ELSE blocks END AS report
FROM gated
"""

EVAL_METRICS = f"""
WITH {_nearest(1, 'l2sq', 'id')},
scored AS (SELECT own_label AS a, label AS p FROM nearest),
labels_seen AS (SELECT DISTINCT a AS label FROM scored),
per_label AS (
  SELECT label, count(*) FILTER (a = label) AS support,
    2.0 * count(*) FILTER (a = label AND p = label)
      / (count(*) FILTER (a = label) + count(*) FILTER (p = label)) AS f1
  FROM scored CROSS JOIN labels_seen GROUP BY label)
SELECT 'weighted_f1' AS metric, round(sum(f1 * support) / sum(support), 6) AS value FROM per_label
UNION ALL
SELECT 'mae', round(avg(abs(a - p)), 6) FROM scored
"""

CHANCE = "('0x' || substr(md5(vec_id || '-' || r), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
DRAWN = " + ".join(f"(u >= {at})::BIGINT" for at in POISSON)
EVAL_INTERVALS = f"""
WITH {_nearest(1, 'l2sq', 'id')},
drawn AS (
  SELECT r, own_label AS a, label AS p, {CHANCE} AS u
  FROM nearest, (SELECT unnest(range(101)) AS r)),
weighted AS (SELECT r, a, p, CASE WHEN r = 0 THEN 1 ELSE {DRAWN} END AS n FROM drawn),
seen AS (SELECT DISTINCT a AS label FROM weighted UNION SELECT DISTINCT p FROM weighted),
per_label AS (
  SELECT r, label, sum(CASE WHEN a = label THEN n ELSE 0 END) AS support,
    sum(CASE WHEN p = label THEN n ELSE 0 END) AS called,
    sum(CASE WHEN a = label AND p = label THEN n ELSE 0 END) AS hits
  FROM weighted, seen GROUP BY r, label),
scores AS (
  SELECT 'weighted_f1' AS metric, r,
    sum(2.0::DOUBLE * hits / nullif(support + called, 0) * support) / sum(support) AS value
  FROM per_label GROUP BY r
  UNION ALL
  SELECT 'mae', r, sum(abs(a - p) * n)::DOUBLE / sum(n) FROM weighted GROUP BY r)
SELECT metric, round(max(value) FILTER (r = 0), 6) AS value,
  round(quantile_cont(value, 0.025) FILTER (r > 0), 6) AS low,
  round(quantile_cont(value, 0.975) FILTER (r > 0), 6) AS high
FROM scores GROUP BY metric
"""

TRAINING_SAMPLE = f"""
WITH t AS (
  SELECT doc_id, lang, array_to_string({TOKENS % 'text'}, ' ') AS words,
    row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS place,
    count(*) OVER (PARTITION BY lang) AS n
  FROM documents WHERE lang IS NOT NULL)
SELECT doc_id, lang, round(n / least(n, {inputs.QUOTA})::DOUBLE, 6) AS weight,
  ('0x' || substr(md5(CASE WHEN words <> '' THEN sha256(words) ELSE doc_id::VARCHAR END), 1, 8))::BIGINT
    % {inputs.FOLDS} AS fold
FROM t WHERE place <= {inputs.QUOTA}
"""

RECALL_AT_K = f"""
WITH {_nearest(10, 'l2sq', 'id')},
ks AS (SELECT unnest([2, 5, 10])::BIGINT AS k),
hits AS (
  SELECT k, vec_id, max(CASE WHEN label = own_label AND rank <= k THEN 1.0 ELSE 0.0 END) AS hit
  FROM nearest CROSS JOIN ks GROUP BY k, vec_id)
SELECT k, round(avg(hit), 6) AS recall, count(*) AS n FROM hits GROUP BY k
"""

ORACLE_SQL = {
    "triage_rules": TRIAGE_RULES,
    "triage_stream": TRIAGE_RULES,
    "eta_label": ETA_LABEL,
    "media_text": MEDIA_TEXT,
    "media_transcripts": MEDIA_TRANSCRIPTS,
    "modality_text_first": MODALITY_TEXT_FIRST,
    "modality_file_first": MODALITY_FILE_FIRST,
    "modality_flag": MODALITY_FLAG,
    "history_clean": HISTORY_CLEAN,
    "predict_named_vectors": PREDICT_NAMED_VECTORS,
    "index_after_retraining": """
        SELECT 'H' || doc_id AS complaint_id, 0.0::DOUBLE AS distance FROM documents JOIN labels USING (doc_id)
    """,
    "recall_approximate": "SELECT true AS reached, 10 * count(*) AS n FROM embeddings",
    "recall_all_cells": "SELECT 1.0::DOUBLE AS recall, 10 * count(*) AS n FROM embeddings",
    "history_clean_ranges": HISTORY_CLEAN,
    "history_csv": HISTORY_CSV,
    "holdout_split": HOLDOUT_SPLIT,
    "index_upsert": INDEX_UPSERT,
    "similar_topk": SIMILAR_TOPK,
    "similar_topk_cosine": SIMILAR_TOPK_COSINE,
    "similar_topk_cells": SIMILAR_TOPK,
    "similar_topk_repeated": SIMILAR_TOPK_REPEATED,
    "triage_gate": TRIAGE_GATE,
    "match_report": MATCH_REPORT,
    "match_report_lines": MATCH_REPORT_LINES,
    "text_features": TEXT_FEATURES,
    "similar_text_topk": SIMILAR_TEXT_TOPK,
    "triage_explained": TRIAGE_EXPLAINED,
    "stream_awaited": STREAM_AWAITED,
    "triage_rule_table": TRIAGE_RULE_TABLE,
    "duplicate_pairs": DUPLICATE_PAIRS,
    "duplicate_clusters": DUPLICATE_CLUSTERS,
    "eval_metrics": EVAL_METRICS,
    "eval_intervals": EVAL_INTERVALS,
    "training_sample": TRAINING_SAMPLE,
    "recall_at_k": RECALL_AT_K,
}
