"""DuckDB SQL with the rows of the queries of :mod:`wardline.llm.queries`."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"

op3_mixing = rf"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORD})) AS size,
    greatest(0.05::DOUBLE, coalesce(length(regexp_replace(text, '[^A-Za-zÀ-ÿ]+', '', 'g'))::DOUBLE / nullif(length(text), 0), 0)) AS q
  FROM documents
), keyed AS (
  SELECT *, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || size || ':1'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496::DOUBLE) / q AS k FROM base
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::DOUBLE AS lim, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM keyed GROUP BY source
), levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(lim) OVER (ORDER BY lim / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY lim / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER (ORDER BY lim / w, source) AS place FROM sources
), plan AS (
  SELECT source, source_size, least(lim, w * coalesce((SELECT arg_min(level, place) FROM levels WHERE level * w <= lim), 0)) AS target FROM levels
), cut AS (
  SELECT *, floor(target + 0.5)::BIGINT AS words, CASE WHEN source_size > 0 THEN floor(floor(target + 0.5) / source_size)::BIGINT ELSE 0 END AS whole FROM plan
), ordered AS (
  SELECT k.doc_id, k.size, c.source_size, c.target, c.whole, c.words - c.whole * c.source_size
    - coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining
  FROM keyed k JOIN cut c ON k.source IS NOT DISTINCT FROM c.source
)
SELECT doc_id, size, source_size, target, (whole * size + least(greatest(remaining, 0), size))::BIGINT AS taken FROM ordered
"""

op4_lm_scores = rf"""
WITH words AS (
  SELECT doc_id, i, w[i] AS a, CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END AS b, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents))
), counted AS (
  SELECT doc_id, i, count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS n,
    count(*) OVER (PARTITION BY a) - count(*) OVER (PARTITION BY a, doc_id) AS c1,
    CASE WHEN b IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY b) - count(*) OVER (PARTITION BY b, doc_id) END AS c2,
    CASE WHEN c IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY c) - count(*) OVER (PARTITION BY c, doc_id) END AS c3
  FROM words
), scored AS (
  SELECT doc_id, CASE WHEN c3 > 0 THEN c3::DOUBLE / lag(c2) OVER place WHEN c2 > 0 THEN 0.4::DOUBLE * c2 / lag(c1) OVER place
    ELSE 0.4::DOUBLE * 0.4::DOUBLE * (c1 + 1) / (n + 1) END AS s, (c3 > 0)::INT AS seen
  FROM counted WINDOW place AS (PARTITION BY doc_id ORDER BY i)
), means AS (
  SELECT doc_id, count(*) AS n_words, sum(seen)::BIGINT AS n_top, round(avg(ln(s)), 6) AS lm_score FROM scored GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_top, 0) AS n_top, lm_score FROM documents d LEFT JOIN means USING (doc_id)
"""

op5_ngram_jaccard_join = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * o >= 90 * (p.n + q.n - o)
), reach AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles,
  least(d.doc_id, coalesce((SELECT min(y) FROM reach WHERE x = d.doc_id), d.doc_id)) AS component_id,
  (SELECT count(*) FROM links WHERE x = d.doc_id) AS n_links
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""

op7_substring_dedup = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents
), windows AS (
  SELECT doc_id, i AS pos, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words)
), twice AS (
  SELECT doc_id, pos FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 35)) AS i FROM twice
), kept AS (
  SELECT doc_id, len(w) AS n, w, coalesce((SELECT list(i) FROM gone g WHERE g.doc_id = words.doc_id), []) AS g FROM words
)
SELECT doc_id, n::BIGINT AS n_words, len(g)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(g, i)), ' ')) AS kept_sha256 FROM kept
"""

op11_embedding_dedup = r"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
), told AS (
  SELECT vec_id, (SELECT count(*) FROM links WHERE x = vec_id) AS n_links, least(vec_id, coalesce((SELECT min(y) FROM reach WHERE x = vec_id), vec_id)) AS component_id FROM embeddings
)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM told
"""

op12_filter_audit = rf"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents
), firsts AS (
  SELECT t, min(doc_id) AS low FROM texts GROUP BY t
), failing AS (
  SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad,
    (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
      + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * len(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
      + 16 * (low < d.doc_id)::INT AS f
  FROM texts d JOIN firsts USING (t) LEFT JOIN labels l ON l.doc_id = d.doc_id
), counts AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (bad) AS b FROM failing GROUP BY ALL
), steps AS (
  SELECT '' AS filter_order, 0 AS step, 0 AS before, 0 AS bit, 0 AS done
  UNION ALL
  SELECT filter_order || 'ABCDE'[i::INT + 1], step + 1, done, (1 << i)::INT, done + (1 << i)::INT FROM steps, range(5) t(i) WHERE step < 5 AND (done >> i) & 1 = 0
), paths AS (
  SELECT filter_order, unnest(range(1, 6)) AS step FROM steps WHERE step = 5
), placed AS (
  SELECT p.filter_order, p.step, s.before, s.bit FROM paths p JOIN steps s ON s.filter_order = p.filter_order[:p.step]
), told AS (
  SELECT part, before, bit, sum(n) FILTER (f & (before | bit) = 0) AS kept, sum(n) FILTER (f & before = 0 AND f & bit > 0) AS removed,
    sum(n) FILTER (f & before > 0 AND f & bit > 0) AS redundant, sum(n) FILTER (f = bit) AS unique_fails,
    sum(g) FILTER (f & before = 0 AND f & bit > 0) AS good_lost, sum(b) FILTER (f & before = 0 AND f & bit > 0) AS toxic_lost
  FROM counts, (SELECT DISTINCT before, bit FROM placed) GROUP BY ALL
), shares AS (
  SELECT part, bit, sum(removed) AS shapley FROM told JOIN placed USING (before, bit) GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(shapley, 0)::BIGINT AS shapley
FROM placed JOIN told USING (before, bit) JOIN shares USING (part, bit)
"""
