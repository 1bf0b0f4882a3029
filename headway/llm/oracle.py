"""SQL for the corpus queries that SQL can express."""

from __future__ import annotations

OP2 = """
WITH whole AS (
  SELECT vec_id, min([floor(1024 * x::DOUBLE) for x in embedding]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 GROUP BY vec_id),
met AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM whole a JOIN whole b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM met QUALIFY rank <= 10"""

OP8 = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
worded AS (SELECT r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM docs),
counted AS (SELECT r, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars FROM worded GROUP BY r),
windows AS (SELECT r, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS k FROM worded WINDOW o AS (PARTITION BY r ORDER BY i)),
again AS (SELECT r, i FROM windows WHERE k IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
repeated AS (SELECT r, sum(step)::BIGINT AS n_repeat_words FROM (SELECT r, least(3, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 3)) AS step FROM again) GROUP BY r),
lines AS (SELECT r, line, count(*) AS copies, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs) GROUP BY r, line),
judged AS (
  SELECT *, length(regexp_replace(line, '[^#*$%&|<>]+', '', 'g')) > n * 0.5 OR len(regexp_extract_all(line, '[!?]{2,}')) > n * 0.25
    OR n >= 4 AND length(regexp_replace(line, '[^\p{Lu}]+', '', 'g')) > length(regexp_replace(line, '[^\p{L}]+', '', 'g')) * 0.7
    OR regexp_matches(line, '^[\x20\x09-\x0D]*[^|»›•>]{1,40}(?:[\x20\x09-\x0D][|»›•>][\x20\x09-\x0D][^|»›•>]{1,40}){2,}[\x20\x09-\x0D]*[|»›•>]?[\x20\x09-\x0D]*$')
    OR len([p for p in [
      'all rights reserved', 'terms of use', 'terms of service', 'privacy policy', 'cookie policy', 'accept cookies', 'accept all cookies',
      'enable javascript', 'subscribe to our', 'sign up for our newsletter', 'click here', 'share this', 'skip to content', 'skip to main content',
      'alle rechte vorbehalten', 'allgemeine geschäftsbedingungen', 'datenschutzerklärung', 'cookies akzeptieren', 'hier klicken', 'zum inhalt springen', 'tous droits réservés',
      'conditions d''utilisation', 'conditions d’utilisation', 'politique de confidentialité', 'accepter les cookies', 'cliquez ici', 'aller au contenu', 'todos los derechos reservados',
      'términos y condiciones', 'política de privacidad', 'aceptar las cookies', 'haga clic aquí', 'saltar al contenido'] if contains(lower(line), p)]) > 0 AS fails
  FROM lines WHERE n > 0),
kept_lines AS (
  SELECT r, sum(copies - 1)::BIGINT AS n_dup_lines, sum(CASE WHEN fails THEN 0 ELSE length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) END) AS stays FROM judged GROUP BY r),
marks AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(stays, 0) AS stays
  FROM docs LEFT JOIN counted USING (r) LEFT JOIN repeated USING (r) LEFT JOIN kept_lines USING (r))
SELECT * EXCLUDE (stays), n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT base_failed AND stays >= word_chars * 0.7::DOUBLE AS kept FROM marks"""

OP10 = """
WITH docs AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, coalesce(hex(encode(text)), '') AS h FROM documents),
windows AS (SELECT r, unnest(range(0, greatest(length(h) // 2 - 99, 0))) AS s, h FROM docs),
again AS (SELECT r, s FROM (SELECT r, s, md5_number(substr(h, 2 * s + 1, 200)) AS k FROM windows) QUALIFY row_number() OVER (PARTITION BY k ORDER BY r, s) > 1),
steps AS (SELECT r, s, lag(s) OVER (PARTITION BY r ORDER BY s) AS before FROM again),
runs AS (
  SELECT r, min(s) AS a, max(s) + 100 AS b FROM (
    SELECT r, s, sum(CASE WHEN before IS NULL OR s > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY s) AS run FROM steps) GROUP BY r, run),
kept AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS z FROM runs),
parts AS (SELECT r, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, max(b) AS tail, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS front FROM kept JOIN docs USING (r) GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN parts USING (r)"""

OP11 = r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
said AS (
  SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM said GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
langs AS (SELECT lang, coalesce(count(term), 0) AS v, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN kept USING (lang) GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM said JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts USING (lang, source) GROUP BY g.lang, g.source),
shares AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (t.total + 2 * v))::BIGINT AS p,
    (1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * v))::BIGINT AS q
  FROM totals t JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
met AS (SELECT a.lang, a.source, b.source AS item FROM totals a JOIN totals b ON a.lang = b.lang AND a.source <> b.source),
found AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM met LEFT JOIN pairs USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM found QUALIFY part = 'pair' OR rank <= 10"""


def op13(rounds: int = 3) -> str:
    """Each round assigns all vectors and moves the centroids; sums and products are whole numbers below 2^53."""
    sql = """
WITH v0 AS (SELECT vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS v FROM embeddings WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
v AS (SELECT row_number() OVER () AS r, vec_id, v FROM v0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS c, v AS m FROM v ORDER BY c LIMIT 16)"""
    for k in range(rounds + 1):
        sql += f""",
a{k} AS (SELECT r, vec_id, v, c, list_inner_product(v, v) - 2 * list_inner_product(v, m) + list_inner_product(m, m) AS d FROM v CROSS JOIN c{k} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""
        if k < rounds:
            sql += f""",
s{k} AS (SELECT c, i, floor(sum(v[i]) / count(*)) AS x FROM a{k} CROSS JOIN range(1, 65) t(i) GROUP BY c, i),
m{k} AS (SELECT c, list(x ORDER BY i) AS m FROM s{k} GROUP BY c),
c{k + 1} AS (SELECT c, coalesce(m{k}.m, c{k}.m) AS m FROM c{k} LEFT JOIN m{k} USING (c))"""
    return sql + f"""
SELECT vec_id, c::INT AS cluster, d::BIGINT AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string([x::BIGINT for x in m], ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)"""


OP13 = op13()
