"""DuckDB forms of the operators that SQL can express."""

_WORD = r"[^\x20\x09-\x0D]+"

_TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_MIX = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size, md5('0:' || coalesce(doc_id::VARCHAR, '')) AS o FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY source
), t AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(source_size * 2) OVER f, 0)::DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0))::DOUBLE AS time
  FROM s WINDOW f AS (ORDER BY source_size * 2 / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
  SELECT source, source_size, least((source_size * 2)::DOUBLE, weight * max(time) OVER ()) AS target FROM t
), e AS (
  SELECT doc_id, size, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS fin
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, (least(size, greatest(0, floor(target)::BIGINT - fin + size)) + least(size, greatest(0, floor(target)::BIGINT - source_size - fin + size)))::BIGINT AS taken FROM e
"""

_NEAR = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS x FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(x) >= 2 THEN list_transform(range(1, len(x)), lambda i: x[i] || ' ' || x[i + 1]) WHEN len(x) = 1 THEN [x[1]] ELSE [] END) AS t FROM w
), e AS (SELECT doc_id, len(t) AS n, unnest(t) AS g FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, any_value(a.n) AS m, any_value(b.n) AS n
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2
), l AS (SELECT a, b FROM p WHERE 100 * i >= 80 * (m + n - i)
), r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT l.a, r.c FROM r JOIN l ON l.b = r.a)
SELECT doc_id, len(t)::BIGINT AS n_shingles, c AS component_id, c = doc_id AS kept FROM s JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) ON a = doc_id
"""

SQL = {"op1_impact_topk": _TOPK, "op2_fair_mix": _MIX, "op8_setsketch_dedup": _NEAR}
