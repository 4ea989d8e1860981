"""Queries of decontamination, mixing and chat formatting, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.llm import chat, decontaminate, mixing
from loomwork.llm.registry import query, table

FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = "regexp_extract_all(" + FOLD + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2_SQL = f"""
WITH items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {WORDS.format('text')} AS w
  FROM benchmark WHERE text IS NOT NULL),
cut AS (
  SELECT item, least(len(w), 10) AS width,
         unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS p, w
  FROM items WHERE len(w) > 0),
wins AS (
  SELECT DISTINCT item, width, array_to_string(w[p + 1:p + width], ' ') AS win FROM cut),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, {WORDS.format("coalesce(text, '')")} AS w
  FROM documents),
widths AS (SELECT DISTINCT width FROM wins),
runs AS (
  SELECT r, width, unnest(range(0, len(w) - width + 1)) AS p, w
  FROM docs, widths WHERE len(w) >= width),
hits AS (
  SELECT r, item, p, runs.width AS width FROM runs
  JOIN wins ON wins.width = runs.width
           AND array_to_string(w[p + 1:p + runs.width], ' ') = win),
counts AS (
  SELECT r, count(DISTINCT word) AS n_hit
  FROM (SELECT r, unnest(range(p, p + width)) AS word FROM hits) GROUP BY r),
found AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN counts USING (r) LEFT JOIN found USING (r)"""


@query(OP2_SQL)
def op2_decontaminate(spark, d):
    found = decontaminate.decontaminate(
        table(spark, d, "documents"), table(spark, d, "benchmark"), keep=["doc_id"])
    n_hit = decontaminate.hit_words(F.col("hits"))
    return found.select(
        "doc_id", F.col("hits.n_words").alias("n_words"), n_hit.alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))


OP8_SQL = r"""
WITH docs AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS digest
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM docs GROUP BY source),
caps AS (
  SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size AS cap,
         CAST(sum(source_size) OVER () AS BIGINT) AS budget FROM sources),
levels AS (
  SELECT *, cap / weight AS reach,
         budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY cap / weight, rank
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM caps),
first AS (
  SELECT reach AS r, rank AS k, rest, open FROM levels WHERE weight * rest <= cap * open
  ORDER BY reach, rank LIMIT 1),
targets AS (
  SELECT source, levels.rank, source_size, budget,
         CASE WHEN r IS NULL OR reach < r OR (reach = r AND levels.rank < k)
              THEN CAST(cap AS DOUBLE)
              ELSE CAST(weight * first.rest AS DOUBLE) / CAST(first.open AS DOUBLE) END AS target
  FROM levels LEFT JOIN first ON TRUE),
queued AS (
  SELECT doc_id, size, rank, source_size, target, budget, digest,
         sum(size) OVER (PARTITION BY rank ORDER BY digest, doc_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source),
copies AS (
  SELECT doc_id, size, rank, digest, budget, epoch,
         CAST(epoch * source_size + upto AS DOUBLE) / target AS finish
  FROM queued, (SELECT unnest([0, 1, 2]) AS epoch) WHERE size > 0 AND target > 0),
mixed AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, digest, doc_id, epoch
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM copies),
taken AS (
  SELECT rank, digest, count(*) AS n FROM mixed WHERE running <= budget GROUP BY rank, digest)
SELECT doc_id, size, source_size, target, CAST(size * coalesce(n, 0) AS BIGINT) AS taken
FROM queued LEFT JOIN taken USING (rank, digest)"""


@query(OP8_SQL)
def op8_mix_sources(spark, d):
    return mixing.mix_sources(table(spark, d, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


OP10_SQL = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(text, '') AS content,
         CASE WHEN coalesce(role, '') = '' THEN 'unknown' ELSE role END AS speaker
  FROM conversations),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, speaker, content) - 1 AS position FROM said),
parts AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
seen AS (
  SELECT n.conv_id, perspective, position, content, speaker = perspective AS train,
         CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant'
              ELSE 'user' END AS chat_role,
         CASE WHEN speaker NOT IN ('system', perspective)
              THEN regexp_replace(speaker, '[^A-Za-z0-9_-]', '_', 'g') END AS name
  FROM numbered n JOIN parts ON n.conv_id IS NOT DISTINCT FROM parts.conv_id),
shown AS (
  SELECT *, '<|im_start|>' || chat_role || coalesce(' name=' || name, '') || chr(10) AS header
  FROM seen),
segments AS (
  SELECT *, header || content || '<|im_end|>' || chr(10) AS segment FROM shown),
placed AS (
  SELECT *, sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY position)
            - length(segment) AS begins FROM segments)
SELECT conv_id, perspective, position // {chat.PART} AS part, CAST(count(*) AS INTEGER) AS n_turns,
       CAST(min(begins) AS BIGINT) AS "offset", string_agg(segment, '' ORDER BY position) AS text,
       coalesce(string_agg(
         (begins + length(header)) || ':' || (begins + length(header) + length(content) + 10), ','
         ORDER BY position) FILTER (train), '') AS masks
FROM placed GROUP BY conv_id, perspective, part"""


@query(OP10_SQL)
def op10_perspectives(spark, d):
    parts = chat.dialogues(chat.rotate(table(spark, d, "conversations")))
    spans = F.transform("masks", lambda m: F.concat_ws(":", m["start"], m["end"]))
    return parts.withColumn("masks", F.array_join(spans, ","))
