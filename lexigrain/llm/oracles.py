"""DuckDB statements for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from lexigrain.llm.licenses import EXACT_BELOW, PHRASES, SLACK, TEMPLATES, THRESHOLD
from lexigrain.llm.linededup import MIN_WORDS

_VALUES = ", ".join(f"('{phrase}', '{label}')" for phrase, label in PHRASES)
_TEMPLATES = ", ".join(
    f"({n}, '{t.words}', '{t.label}', '{t.required}', '{t.without}')" for n, t in enumerate(TEMPLATES)
)

LICENSES = rf"""
WITH phrases(phrase, label) AS (VALUES {_VALUES}),
templates AS (
  SELECT n, label, own, len(sequence) < {EXACT_BELOW} AS exact, sequence,
    CASE WHEN len(sequence) < {EXACT_BELOW} THEN len(own) ELSE ceil(round({THRESHOLD} * len(own), 9)) END AS need,
    CASE WHEN len(sequence) < {EXACT_BELOW} THEN len(sequence) ELSE len(sequence) + ceil(round({SLACK} * len(sequence), 9)) END
      AS size,
    list_filter(string_split(required, ' '), lambda x: x <> '') AS required,
    list_filter(string_split(unwanted, ' '), lambda x: x <> '') AS unwanted
  FROM (
    SELECT *, string_split(body, ' ') AS sequence, list_distinct(string_split(body, ' ')) AS own
    FROM (VALUES {_TEMPLATES}) t(n, body, label, required, unwanted)
  )
),
vocabulary AS (SELECT list_distinct(flatten(list(list_concat(own, required, unwanted)))) AS every FROM templates),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM documents
),
words AS (
  SELECT r, list_filter(regexp_split_to_array(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM docs
),
places AS (
  SELECT r, label, i - 1 AS start
  FROM words, phrases, range(1, len(w) + 1) s(i)
  WHERE array_to_string(w[i : i + len(string_split(phrase, ' ')) - 1], ' ') = phrase
    AND w[i] = string_split(phrase, ' ')[1]
),
base AS (
  SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
    list_sort(list_distinct(list(label))) AS base_labels
  FROM places GROUP BY r
),
-- Texts that hold enough of a template's words anywhere; then all windows that begin with a template word.
likely AS (
  SELECT r, w, t.* FROM words, templates t WHERE len(list_intersect(list_distinct(w), own)) >= need
),
windows AS (
  SELECT r, label, own, need, exact, sequence, required, unwanted, w[s : CAST(s + size - 1 AS BIGINT)] AS block
  FROM likely, vocabulary, range(1, len(w) + 1) p(s) WHERE list_contains(every, w[s])
),
matches AS (
  SELECT r, label, len(list_intersect(list_distinct(block), own)) / len(own) AS containment FROM windows
  WHERE CASE WHEN exact THEN block = sequence ELSE len(list_intersect(list_distinct(block), own)) >= need END
    AND list_has_all(block, required) AND NOT list_has_any(block, unwanted)
),
found AS (
  SELECT r, list_sort(list_distinct(list(label))) AS labels, max(containment) AS containment FROM matches GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(base_labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base_labels, []), coalesce(labels, [])))), ','), '') AS labels,
  greatest(CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, coalesce(containment, 0.0::DOUBLE)) AS score
FROM docs JOIN words USING (r) LEFT JOIN base USING (r) LEFT JOIN found USING (r)
"""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^ 	-
]+') AS w FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, chr(32))]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], chr(32)))) END AS s
  FROM words
),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
),
reached AS (
  SELECT doc_id AS start, doc_id AS node FROM documents
  UNION SELECT start, b FROM reached JOIN links ON node = a
),
components AS (SELECT start AS doc_id, min(node) AS component_id FROM reached GROUP BY start)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN components USING (doc_id)
"""

LINES = rf"""
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
lines AS (
  SELECT doc_id, spot, line, array_to_string(w, ' ') AS norm, len(w) AS n FROM (
    SELECT doc_id, spot, line, regexp_extract_all({_LOWER.format("line")}, '[^\x20\x09-\x0D]+') AS w FROM (
      SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS spot FROM split))
),
summed AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY spot) AS done FROM lines),
bodies AS (SELECT doc_id, list(norm ORDER BY spot) AS norms FROM lines GROUP BY doc_id),
runs AS (
  SELECT a.doc_id, a.spot AS first, min(b.spot) AS last FROM summed a JOIN summed b
    ON a.doc_id = b.doc_id AND b.spot >= a.spot AND b.done - a.done + a.n >= {MIN_WORDS} GROUP BY a.doc_id, a.spot
  UNION
  SELECT b.doc_id, max(a.spot), b.spot FROM summed a JOIN summed b
    ON a.doc_id = b.doc_id AND b.spot >= a.spot AND b.done - a.done + a.n >= {MIN_WORDS} GROUP BY b.doc_id, b.spot
),
placed AS (
  SELECT doc_id, first, last, min((doc_id, first, last)) OVER (PARTITION BY norms[first : last]) AS source
  FROM runs JOIN bodies USING (doc_id)
),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS spot FROM placed
  WHERE source[1] <> doc_id OR first > source[3]
),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY spot) AS text
  FROM lines ANTI JOIN gone USING (doc_id, spot) GROUP BY doc_id
)
SELECT doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text
FROM documents d LEFT JOIN kept USING (doc_id)
"""

_DIGITS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
_BITS = (
    "array_to_string(list_transform(range(1, 41), "
    "lambda i: right(bin(strpos('0123456789abcdef', substr(h, i, 1)) + 15), 4)), '')"
)

WARC = f"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages
),
bits AS (SELECT *, {_BITS} AS bits, min(page_id) OVER (PARTITION BY body) AS first FROM payloads)
SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr({_DIGITS}, ('0b' || substr(bits, 5 * i + 1, 5))::INT + 1, 1)), '')
    AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to,
  NULL::VARCHAR AS error
FROM bits
"""

_VECTORS = """v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)"""

TOP_K = f"""
WITH {_VECTORS},
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INT) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""

HARD_NEGATIVES = f"""
WITH {_VECTORS},
labelled AS (SELECT vec_id, e, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l FROM v WHERE label IS NOT NULL),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other, a.l = c.l AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM labelled a JOIN labelled c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0
),
positives AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS r FROM scored WHERE same
  ) WHERE r <= 5
),
pairs AS (
  SELECT p.anchor_id, p.other AS positive_id, n.other AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other) AS r
  FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
    AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor_id, positive_id, CAST(r AS INT) AS rank, negative_id, positive_score, negative_score FROM pairs WHERE r <= 3
"""

ORACLES: dict[str, str] = {
    "op1_minhash_near_dedup": NEAR_DUPLICATES,
    "op2_warc_round_trip": WARC,
    "op3_license_scan": LICENSES,
    "op9_line_dedup": LINES,
    "op12_hard_negatives": HARD_NEGATIVES,
    "op13_exact_top_k": TOP_K,
}
