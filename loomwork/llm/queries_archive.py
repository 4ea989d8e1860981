"""Queries of archives, vector codes and conversation prefixes, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.llm import prefixtrie, vectorcodes, warc
from loomwork.llm.registry import query, table
from loomwork.session import scratch_path

OP11_SQL = """
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, octet_length(encode(coalesce(html, ''))) AS n,
         sha1(coalesce(html, '')) AS digest
  FROM pages),
tops AS (
  SELECT digest, n, first(r ORDER BY page_id DESC NULLS LAST, r DESC) AS r,
         max(page_id) AS page_id
  FROM p WHERE n >= 1000 GROUP BY digest, n)
SELECT p.page_id AS page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN tops.r IS NULL OR tops.r = p.r THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN tops.r <> p.r THEN tops.page_id END AS refers_to
FROM p LEFT JOIN tops ON p.digest = tops.digest AND p.n = tops.n"""


@query(OP11_SQL)
def op11_capture_index(spark, d):
    pages = table(spark, d, "pages")
    store = warc.archive(pages, scratch_path(spark, "warc"))
    places = warc.lookup(store, pages.select(warc.url_key(F.col("url")).alias("key")))
    return warc.read_records(store, places).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _round(n: int) -> str:
    """Nearest entries of all parts by the codebook of round n, and the next codebook."""
    return f"""
near{n} AS (
  SELECT v, p, e, d FROM (
    SELECT v, parts.p AS p, e, sum((parts.x - b.x) * (parts.x - b.x)) AS d,
           row_number() OVER (PARTITION BY v, parts.p ORDER BY d, e) AS nr
    FROM parts JOIN book{n} b ON parts.p = b.p AND parts.j = b.j
    GROUP BY v, parts.p, e) WHERE nr = 1),
means{n} AS (
  SELECT parts.p AS p, j, e, sum(x) AS s, count(*) AS n
  FROM parts JOIN near{n} USING (v, p) GROUP BY parts.p, j, e),
book{n + 1} AS (
  SELECT b.p AS p, b.j AS j, b.e AS e,
         CASE WHEN n IS NULL THEN b.x ELSE (s - ((s % n) + n) % n) // n END AS x
  FROM book{n} b LEFT JOIN means{n} m ON b.p = m.p AND b.j = m.j AND b.e = m.e)"""


OP12_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS v, vec_id, label, embedding FROM embeddings
  WHERE len(list_filter(embedding, lambda c: NOT isfinite(c) OR c IS NULL)) = 0),
cells AS (
  SELECT v, len(embedding) // 16 AS w, unnest(embedding) AS c,
         unnest(range(len(embedding))) AS i FROM kept),
parts AS (
  SELECT v, i // w AS p, i % w AS j, CAST(floor(CAST(c AS DOUBLE) * 256) AS HUGEINT) AS x
  FROM cells),
book0 AS (SELECT p, j, v AS e, x FROM parts WHERE v < 64),
{_round(0)},{_round(1)},{_round(2)},
coded AS (
  SELECT v, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d) AS error
  FROM near2 GROUP BY v),
book AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, j)) AS digest FROM book2)
SELECT vec_id, code, CAST(error AS BIGINT) AS error,
       CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       digest AS codebooks_sha256
FROM kept JOIN coded USING (v), book"""


@query(OP12_SQL)
def op12_vector_codes(spark, d):
    return vectorcodes.encode(table(spark, d, "embeddings"))


# CRC-32 of the decimal id, a byte and then a bit at a time
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295,
    [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""

OP13_SQL = f"""
WITH said AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS nr
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c.conv_id AS conv_id, h % 6 AS h FROM (
    SELECT conv_id, {CRC} AS h FROM (SELECT DISTINCT conv_id FROM conversations)
    WHERE conv_id IS NOT NULL) c),
turns AS (
  SELECT conv_id, nr, role, text FROM said JOIN convs USING (conv_id) WHERE nr > h
  UNION ALL
  SELECT c.conv_id, nr, role, text FROM convs c
  JOIN said s ON s.conv_id = c.conv_id - c.conv_id % 100 WHERE nr <= h),
placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY nr) AS depth, text,
         sha256(length(role) || ':' || role || text) AS item FROM turns),
prefixes AS (
  SELECT conv_id, depth, length(text) AS tokens, sha256(string_agg(item, '') OVER (
    PARTITION BY conv_id ORDER BY depth)) AS node FROM placed
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
chain AS (
  SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent,
         max(depth) OVER (PARTITION BY conv_id) AS whole FROM prefixes),
nodes AS (
  SELECT node, depth, any_value(parent) AS parent, any_value(tokens) AS tokens,
         min(conv_id) AS conv_id, count(*) AS n_convs,
         string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
           FILTER (depth = whole) AS ends
  FROM chain GROUP BY node, depth),
sons AS (SELECT parent, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent),
known AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes
  LEFT JOIN sons ON sons.parent = nodes.node),
below AS (
  SELECT a.node AS node, sum(k.share) AS saved, sum(k.leaf) AS n_leaves
  FROM (
    SELECT DISTINCT a.node AS node, b.node AS under FROM chain a JOIN chain b
    ON a.conv_id = b.conv_id AND a.depth <= b.depth) a
  JOIN (SELECT node, (n_convs - 1) * tokens AS share, CAST(n_children = 0 AS INT) AS leaf
        FROM known) k ON k.node = a.under
  GROUP BY a.node)
SELECT known.conv_id AS conv_id, known.depth AS depth, p.conv_id AS parent_conv_id,
       known.n_convs AS n_convs, known.n_children AS n_children,
       CAST(below.n_leaves AS BIGINT) AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens,
       sha256(coalesce(known.ends, '')) AS ends_sha256
FROM known JOIN below USING (node) LEFT JOIN known p ON p.node = known.parent"""


@query(OP13_SQL)
def op13_prefix_trie(spark, d):
    return prefixtrie.prefix_trie(table(spark, d, "conversations"))
