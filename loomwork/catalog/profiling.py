"""Inclusion dependencies, unique combinations, shared substrings, cells."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from loomwork import functions as fn
from loomwork.catalog.registry import COLUMNS, cells_sql, query, table, tables
from loomwork.operators import aggregates, filters, projections
from loomwork.plans import inclusion, substrings, uniqueness

SEVEN = ["region", "nation", "supplier", "customer", "part", "lineitem", "orders"]


@query(f"""SELECT attribute, count(*) AS cells, count(DISTINCT value) AS distinct_values
           FROM ({cells_sql(SEVEN)}) GROUP BY attribute""")
def unpivot_cells(spark, d):
    """All cells of all tables, counted, since engines write numbers differently."""
    return projections.unpivot_cells(tables(spark, d, SEVEN)).groupBy("attribute").agg(
        F.count("*").alias("cells"), F.countDistinct("value").alias("distinct_values"))


@query(f"""SELECT attributes, count(*) AS "values" FROM (
             SELECT value, string_agg(DISTINCT attribute, ',' ORDER BY attribute) AS attributes
             FROM ({cells_sql(SEVEN)}) GROUP BY value) GROUP BY attributes""")
def value_attr_sets(spark, d):
    found = aggregates.attribute_sets(projections.unpivot_cells(tables(spark, d, SEVEN)))
    return found.groupBy(F.array_join("attributes", ",").alias("attributes")).agg(
        F.count("*").alias("values"))


def _ind_sql(cells: str) -> str:
    return f"""
      WITH cells AS MATERIALIZED (SELECT DISTINCT attribute, value FROM ({cells})),
           own AS (SELECT attribute, COUNT(*) AS n FROM cells GROUP BY attribute),
           shared AS (SELECT a.attribute AS dependent, b.attribute AS referenced, COUNT(*) AS n
                      FROM cells a JOIN cells b ON a.value = b.value
                       AND a.attribute <> b.attribute
                      GROUP BY ALL),
           ind AS (SELECT dependent, referenced FROM shared
                   JOIN own ON own.attribute = dependent AND own.n = shared.n)
      SELECT dependent, string_agg(referenced, ', ' ORDER BY referenced) AS referenced,
             dependent || ' < ' || string_agg(referenced, ', ' ORDER BY referenced) AS line
      FROM ind GROUP BY dependent ORDER BY dependent"""


@query(_ind_sql(cells_sql(SEVEN)))
def inclusion_dependencies(spark, d):
    return inclusion.inclusion_report(tables(spark, d, SEVEN))


@query(f"""SELECT dependent, referenced FROM ({_ind_sql(cells_sql(SEVEN))})""")
def inclusion_by_sets(spark, d):
    """The same result from the distinct attribute sets, whose number the schema bounds."""
    cells = projections.unpivot_cells(tables(spark, d, SEVEN))
    attr_sets = aggregates.attribute_sets(cells).select("attributes").distinct()
    lists = attr_sets.select(F.explode("attributes").alias("dependent"), "attributes")
    candidates = aggregates.group_sets(
        filters.without_own(lists, "dependent", "attributes"), "dependent", "attributes")
    common = candidates.select(
        "dependent", fn.intersect_all(F.col("sets")).alias("referenced"))
    return filters.non_empty(common, "referenced").select(
        "dependent", F.array_join("referenced", ", ").alias("referenced"))


@query(f"""WITH cells AS MATERIALIZED
             (SELECT DISTINCT attribute, value FROM ({cells_sql(SEVEN)}))
           SELECT a.attribute AS dependent, b.attribute AS referenced, COUNT(*) AS shared_values
           FROM cells a JOIN cells b ON a.value = b.value AND a.attribute <> b.attribute
           GROUP BY ALL""")
def attr_overlap(spark, d):
    return inclusion.attribute_overlap(tables(spark, d, SEVEN))


def _counts_sql(name: str) -> str:
    cols = COLUMNS[name]
    widths = range(1, len(cols) + 1)
    return " UNION ALL ".join(
        f"SELECT '{','.join(c)}' AS columns, {w} AS width, "
        f"(SELECT COUNT(*) FROM (SELECT DISTINCT {', '.join(c)} FROM {name})) AS distinct_rows"
        for w in widths for c in combinations(cols, w))


def _ucc_sql(name: str) -> str:
    return f"""
      WITH counts AS MATERIALIZED ({_counts_sql(name)}),
           uniq AS MATERIALIZED (SELECT * FROM counts
                    WHERE distinct_rows = (SELECT COUNT(*) FROM {name}))
      SELECT columns, CAST(width AS INTEGER) AS width, distinct_rows FROM uniq u
      WHERE NOT EXISTS (SELECT 1 FROM uniq v WHERE v.width < u.width
        AND list_has_all(string_split(u.columns, ','), string_split(v.columns, ',')))"""


def _joined(found):
    return found.withColumn("columns", F.array_join("columns", ","))


@query(_ucc_sql("customer"))
def unique_combinations(spark, d):
    return _joined(uniqueness.unique_combinations(table(spark, d, "customer")))


@query(_ucc_sql("orders"))
def unique_combinations_orders(spark, d):
    return _joined(uniqueness.unique_combinations(table(spark, d, "orders")))


def _ucc_levels_sql(name: str) -> str:
    """Level by level, each set from the one without its last column; single rows drop out."""
    cols = COLUMNS[name]
    bits = len(cols)
    codes = ", ".join(f"dense_rank() OVER (ORDER BY {c} NULLS FIRST)" for c in cols)
    names = ", ".join(f"'{c}'" for c in cols)
    levels = [f"""
      held0 AS (SELECT 0 AS mask, -1 AS top, 0 AS cluster, r FROM coded
                WHERE (SELECT count(*) FROM coded) > 1)"""]
    for k in range(1, bits + 1):
        levels.append(f"""
      held{k} AS MATERIALIZED (
        SELECT mask, top, min(r) OVER w AS cluster, r FROM (
          SELECT h.mask + (1 << i) AS mask, i AS top, h.cluster AS c, h.r AS r,
                 codes[i + 1] AS code
          FROM held{k - 1} h JOIN coded ON coded.r = h.r, places WHERE i > h.top)
        WINDOW w AS (PARTITION BY mask, c, code) QUALIFY count(*) OVER w > 1)""")
    every = " UNION ALL ".join(f"SELECT DISTINCT mask FROM held{k}" for k in range(bits + 1))
    return f"""
      WITH coded AS MATERIALIZED (
             SELECT row_number() OVER () AS r, [{codes}] AS codes FROM {name}),
           places AS (SELECT unnest(range({bits})) AS i),{','.join(levels)},
           shared AS (SELECT mask FROM ({every})),
           wider AS (SELECT DISTINCT mask + (1 << i) AS mask FROM shared, places
                     WHERE mask & (1 << i) = 0),
           minimal AS (
             SELECT w.mask AS mask FROM wider w, places
             LEFT JOIN shared s ON s.mask = w.mask - (1 << i)
             WHERE w.mask NOT IN (SELECT mask FROM shared) AND w.mask & (1 << i) > 0
             GROUP BY w.mask HAVING count(*) = count(s.mask))
      SELECT array_to_string(list_filter([{names}],
               lambda c, n: mask & (1 << (n - 1)) > 0), ',') AS columns,
             CAST(bit_count(mask) AS INTEGER) AS width,
             (SELECT count(*) FROM coded) AS distinct_rows FROM minimal"""


@query(_ucc_levels_sql("lineitem"))
def unique_combinations_lineitem(spark, d):
    """All minimal unique sets of any width of an 11-column table."""
    return _joined(uniqueness.unique_combinations(table(spark, d, "lineitem")))


@query("SELECT columns, distinct_rows FROM (" + _counts_sql("supplier") + ")")
def combination_counts(spark, d):
    cols = COLUMNS["supplier"]
    every = [c for w in range(1, len(cols) + 1) for c in combinations(cols, w)]
    return _joined(uniqueness.distinct_counts(table(spark, d, "supplier"), every))


def _lattice_sql(name: str) -> str:
    cols = COLUMNS[name]
    rows = []
    for node in range(1, 2 ** len(cols)):
        bits = bin(node)[3:]
        inside = ",".join(c for c, b in zip(cols, bits) if b == "1")
        outside = ",".join(c for c, b in zip(cols, bits) if b == "0")
        rows.append(f"({node}, {len(bits)}, '{inside}', '{outside}')")
    return f"""
      WITH minimal AS MATERIALIZED ({_ucc_sql(name)}),
           nodes(node, depth, included, excluded) AS (VALUES {', '.join(rows)})
      SELECT CAST(node AS BIGINT) AS node, CAST(depth AS INTEGER) AS depth, included, excluded,
             CASE WHEN EXISTS (SELECT 1 FROM minimal WHERE columns = included) THEN 'MINIMAL'
                  WHEN EXISTS (SELECT 1 FROM minimal WHERE list_has_all(
                      string_split(included, ','), string_split(columns, ','))) THEN 'FALSE'
                  ELSE 'EXTENDABLE' END AS verdict
      FROM nodes"""


@query(_lattice_sql("customer"))
def lattice_verdicts(spark, d):
    return uniqueness.lattice_verdicts(table(spark, d, "customer"))


def _lcs_sql(name: str, id: str, text: str) -> str:
    return f"""
      WITH starts AS (SELECT {id} AS id, {text} AS t, unnest(range(1, length({text}) + 1)) AS i
                      FROM {name}),
           subs AS (SELECT DISTINCT id, substring(t, i, w) AS s
                    FROM (SELECT *, unnest(range(1, length(t) - i + 2)) AS w FROM starts)),
           shared AS (SELECT s FROM subs GROUP BY s HAVING MIN(id) <> MAX(id)),
           best AS (SELECT id, s, row_number() OVER (PARTITION BY id ORDER BY length(s) DESC, s)
                    AS rn FROM subs JOIN shared USING (s))
      SELECT {id}, COALESCE(s, '') AS substring
      FROM (SELECT DISTINCT {id} FROM {name}) LEFT JOIN best ON id = {id} AND rn = 1"""


@query(_lcs_sql("customer", "c_custkey", "c_name"))
def longest_shared_substring(spark, d):
    return substrings.longest_shared_substrings(
        table(spark, d, "customer"), "c_custkey", "c_name")


@query(_lcs_sql("benchmark", "item_id", "text"))
def longest_shared_substring_text(spark, d):
    return substrings.longest_shared_substrings(table(spark, d, "benchmark"), "item_id", "text")


def _suffix_sql(name: str, id: str, text: str, top: int = 17) -> str:
    """Suffixes in order by rank doubling from 16 to 2**top characters; neighbours' common
    prefixes from the ranks; the least of them back to, and on to, the next other ID."""
    ranks = "".join(f"""
      r{k} AS MATERIALIZED (
        SELECT a.g AS g, a.rest AS rest, dense_rank() OVER (ORDER BY a.r, coalesce(b.r, 0)) AS r
        FROM r{k - 1} a LEFT JOIN r{k - 1} b
          ON b.g = a.g + {1 << (k - 1)} AND a.rest > {1 << (k - 1)}),"""
                    for k in range(5, top + 1))
    steps = "".join(f"""
      l{k} AS (
        SELECT p.g AS g, h, p.id AS id, hid, nr,
               len + CASE WHEN a.r = b.r AND least(a.rest, b.rest) >= {1 << k}
                          THEN {1 << k} ELSE 0 END AS len
        FROM l{k + 1} p LEFT JOIN r{k} a ON a.g = p.g + len LEFT JOIN r{k} b ON b.g = h + len),""" for k in range(top - 1, 3, -1))
    same = " + ".join(f"(left(a.w, {j}) = left(b.w, {j}) AND length(a.w) >= {j} "
                      f"AND length(b.w) >= {j})::INT" for j in range(1, 16))
    return f"""
      WITH texts AS MATERIALIZED (
        SELECT {id} AS id, t, CAST(sum(length(t) + 1) OVER (ORDER BY n) AS BIGINT) - length(t) AS g0
        FROM (SELECT {id}, coalesce({text}, '') AS t, row_number() OVER () AS n FROM {name}
              WHERE {id} IS NOT NULL)),
      pieces AS (
        SELECT id, g0 + c * 256 AS g0, substring(t, c * 256 + 1, 271) AS piece,
               length(t) - c * 256 AS rest, least(length(t) - c * 256, 256) AS own
        FROM (SELECT *, unnest(range((length(t) + 255) // 256)) AS c FROM texts)),
      wins AS MATERIALIZED (
        SELECT id, g0 + i AS g, rest - i AS rest, substring(piece, i + 1, 16) AS w
        FROM (SELECT *, unnest(range(own)) AS i FROM pieces)),
      r4 AS MATERIALIZED (SELECT g, rest, dense_rank() OVER (ORDER BY w) AS r FROM wins),{ranks}
      placed AS (SELECT r{top}.g AS g, id, row_number() OVER (ORDER BY r, r{top}.g) AS nr
                 FROM r{top} JOIN wins USING (g)),
      l{top} AS MATERIALIZED (
        SELECT g, lag(g) OVER w AS h, id, lag(id) OVER w AS hid, nr, 0 AS len
        FROM placed WINDOW w AS (ORDER BY nr)),{steps}
      lcp AS MATERIALIZED (
        SELECT l4.g AS g, l4.id AS id, hid, nr,
               CASE WHEN h IS NULL THEN 0 ELSE len + coalesce({same}, 0) END AS lcp
        FROM l4 LEFT JOIN wins a ON a.g = l4.g + len LEFT JOIN wins b ON b.g = h + len),
      runs AS (
        SELECT *, lead(lcp, 1, 0) OVER (ORDER BY nr) AS next_lcp,
               sum((hid IS DISTINCT FROM id)::INT) OVER (ORDER BY nr) AS run FROM lcp),
      best AS (
        SELECT g, id, nr, greatest(
          min(lcp) OVER (PARTITION BY run ORDER BY nr),
          min(next_lcp) OVER (PARTITION BY run ORDER BY nr DESC)) AS len FROM runs),
      chosen AS (
        SELECT id, g, len, row_number() OVER (PARTITION BY id ORDER BY len DESC, nr) AS k
        FROM best WHERE len > 0)
      SELECT o.id AS {id}, coalesce(substring(t, CAST(g - g0 + 1 AS BIGINT), len), '') AS substring
      FROM (SELECT DISTINCT id FROM texts) o LEFT JOIN chosen c ON c.id = o.id AND k = 1
      LEFT JOIN texts x ON x.id = c.id AND g BETWEEN g0 AND g0 + length(t) - 1"""


@query(_suffix_sql("documents", "doc_id", "text"))
def longest_shared_substring_long(spark, d):
    """Whole documents."""
    return substrings.longest_shared_substrings(table(spark, d, "documents"), "doc_id", "text")


@query("""WITH pairs AS (SELECT p_partkey, p_name AS a, lower(p_type) AS b FROM part),
               subs AS (SELECT p_partkey, a, b, i, unnest(range(1, length(a) - i + 2)) AS w
                        FROM (SELECT *, unnest(range(1, length(a) + 1)) AS i FROM pairs)),
               hits AS (SELECT p_partkey, substring(a, i, w) AS s FROM subs
                        WHERE contains(b, substring(a, i, w))),
               best AS (SELECT p_partkey, s, row_number() OVER (
                          PARTITION BY p_partkey ORDER BY length(s) DESC, s) AS rn FROM hits)
          SELECT p.p_partkey, COALESCE(s, '') AS substring
          FROM pairs p LEFT JOIN best b ON p.p_partkey = b.p_partkey AND rn = 1""")
def pair_lcs(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", fn.pair_lcs(F.col("p_name"), F.lower("p_type")).alias("substring"))


@query("""SELECT p_partkey, substring(p_name, 2, 3) AS piece,
                 length(p_name) > length(p_brand) AS longer FROM part""")
def text_slices(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", fn.slice_text(F.col("p_name"), 1, 4).alias("piece"),
        (F.length("p_name") > F.length("p_brand")).alias("longer"))
