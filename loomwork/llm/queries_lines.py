"""The line query, with SQL that follows equal lines along diagonals."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.llm import linededup
from loomwork.llm.registry import query, table

OP9_SQL = """
WITH parts AS (
  SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
every AS (
  SELECT doc_id, unnest(l) AS raw, unnest(range(0, len(l))) AS nr FROM parts),
lines AS (
  SELECT doc_id, nr, trim(raw, ' ' || chr(9) || chr(13)) AS line,
         row_number() OVER (ORDER BY doc_id NULLS LAST, nr)
           + dense_rank() OVER (ORDER BY doc_id NULLS LAST) AS g
  FROM every WHERE trim(raw, ' ' || chr(9) || chr(13)) <> ''),
pairs AS (
  SELECT a.doc_id AS doc_id, a.g AS g, b.g AS h
  FROM lines a JOIN lines b ON a.line = b.line AND b.g < a.g),
islands AS (
  SELECT doc_id, g, g - h AS diagonal,
         g - row_number() OVER (PARTITION BY g - h ORDER BY g) AS island FROM pairs),
longest AS (
  SELECT doc_id, max(n) AS longest FROM (
    SELECT doc_id, count(*) AS n FROM islands GROUP BY doc_id, diagonal, island)
  GROUP BY doc_id),
gone AS (SELECT DISTINCT g FROM islands),
marks AS (
  SELECT doc_id, every.nr AS nr, raw, lines.g IS NOT NULL AS real, gone.g IS NOT NULL AS cut
  FROM every LEFT JOIN lines USING (doc_id, nr) LEFT JOIN gone USING (g)),
done AS (
  SELECT doc_id, sum(real::INT) AS n_lines, sum(cut::INT) AS n_removed,
         coalesce(string_agg(raw, chr(10) ORDER BY nr) FILTER (NOT cut), '') AS rest
  FROM marks GROUP BY doc_id)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed,
       CAST(coalesce(longest, 0) AS BIGINT) AS longest_run,
       sha256(CASE WHEN n_removed = 0 THEN coalesce(text, '')
                   WHEN n_removed = n_lines THEN '' ELSE rest END) AS text_sha256
FROM done JOIN parts USING (doc_id) LEFT JOIN longest USING (doc_id)"""


@query(OP9_SQL)
def op9_line_dedup(spark, d):
    cleaned = linededup.dedup_lines(table(spark, d, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_removed", "longest_run",
                          F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
