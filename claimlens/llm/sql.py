"""SQL that other engines run on the same tables for the queries of this package."""

#: Exact counts of sound measurements; the bound must hold for every quantile.
P1_DAYS_JOINED = """
WITH once AS (
  SELECT record_id, arg_max(latency_ms, received_utc) AS latency_ms,
         arg_max(tokens_per_explanation, received_utc) AS tokens, any_value(cell_id) AS cell_id
  FROM cost_metrics GROUP BY record_id),
v AS (
  SELECT generator, 'latency_ms' AS metric, count(*) AS n_values FROM once LEFT JOIN cells USING (cell_id)
  WHERE latency_ms IS NOT NULL AND NOT isnan(latency_ms) AND latency_ms >= 0 GROUP BY 1
  UNION ALL
  SELECT generator, 'tokens_per_explanation', count(*) FROM once LEFT JOIN cells USING (cell_id)
  WHERE tokens IS NOT NULL AND tokens >= 0 GROUP BY 1)
SELECT generator, metric, q, n_values, true AS within_bound
FROM v CROSS JOIN (SELECT unnest([0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999])::DOUBLE AS q)
"""

#: Equal runs of 200 code points through all runs of all texts.
P8_FOUND = """
WITH d AS (SELECT doc_id, text FROM documents WHERE length(text) >= 200),
g AS (SELECT DISTINCT doc_id, hash(substr(text, i::BIGINT, 200)) AS h
      FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM d)),
s AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
k AS (SELECT g.doc_id, g.h FROM g JOIN s ON g.h = s.h)
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM k a JOIN k b ON a.h = b.h AND a.doc_id < b.doc_id
"""

#: Runs of neighbouring places whose 200 code points stand in another text too.
P8_SPANS = """
WITH d AS (SELECT doc_id, text FROM documents WHERE length(text) >= 200),
g AS (SELECT doc_id, i, hash(substr(text, i::BIGINT, 200)) AS h
      FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM d)),
s AS (SELECT h FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
r AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g SEMI JOIN s ON g.h = s.h),
c AS (SELECT d.doc_id, min(d.doc_id) OVER (PARTITION BY d.text) AS class_id FROM d)
SELECT r.doc_id, c.class_id, min(i) - 1 AS "from", max(i) + 199 AS "to"
FROM r JOIN c ON c.doc_id = r.doc_id GROUP BY r.doc_id, c.class_id, run
"""

ORACLES = {"p1_days_joined": P1_DAYS_JOINED, "p8_found": P8_FOUND, "p8_spans": P8_SPANS}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
