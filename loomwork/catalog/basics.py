"""Projections, filters, lookups, aggregates, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork import functions as fn
from loomwork.catalog.registry import query, table
from loomwork.operators import aggregates, filters, joins, ordering, projections, sets
from loomwork.session import scratch_path
from loomwork.sources import inline, sinks

SEGMENTS = ["BUILDING", "MACHINERY", "HOUSEHOLD"]
SEGMENTS_SQL = ", ".join(f"'{s}'" for s in SEGMENTS)


@query("""SELECT 'This is a part: ' || p_partkey AS line FROM part
          WHERE 'This is a part: ' || p_partkey LIKE '%1%' ORDER BY 1""")
def scan_filter_contains(spark, d):
    lines = table(spark, d, "part").select(
        fn.prefixed("This is a part: ", F.col("p_partkey")).alias("line"))
    return ordering.sort_by(lines.where(fn.contains_text(F.col("line"), "1")))


@query("SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) * 2 + 0.5 AS mapped FROM orders")
def arith_map(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", fn.twice_plus_half(F.col("o_orderkey")).alias("mapped"))


@query("SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) * 2 + 0.5 AS mapped FROM orders")
def arith_sql_function(spark, d):
    name = fn.register_twice_plus_half(spark)
    return table(spark, d, "orders").selectExpr(
        "o_orderkey", f"{name}(CAST(o_orderkey AS INT)) AS mapped")


@query("""SELECT o_orderkey, 'nonce' AS word, CAST(3.1415 AS DOUBLE) AS number,
          TRUE AS flag FROM orders""")
def literal_tuple(spark, d):
    return projections.with_literals(
        table(spark, d, "orders"), "o_orderkey", word="nonce", number=3.1415, flag=True)


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS key_text, CAST(o_custkey AS INTEGER) AS cust
          FROM orders""")
def cast_retype(spark, d):
    keys = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    typed = projections.retype(keys, {"o_orderkey": "string", "o_custkey": "int"})
    return projections.rename_all(typed, ["key_text", "cust"])


@query("""SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 9000
          ORDER BY c_acctbal DESC, c_custkey LIMIT 10""")
def sql_filter_topk(spark, d):
    sinks.register(table(spark, d, "customer"), "loomwork_customer")
    rich = spark.sql(
        "SELECT c_custkey, c_name, c_acctbal FROM loomwork_customer WHERE c_acctbal > 9000")
    return ordering.top_k(rich, 10, "c_acctbal", "c_custkey")


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey")
def sort_descending(spark, d):
    return ordering.sort_desc(
        table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", "s_suppkey")


@query("SELECT COUNT(*) AS n FROM (SELECT * FROM orders LIMIT 10)")
def limit_n(spark, d):
    return ordering.first_n(table(spark, d, "orders"), 10).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ({SEGMENTS_SQL})")
def in_list(spark, d):
    return filters.in_list(table(spark, d, "customer").select("c_custkey", "c_mktsegment"),
                           "c_mktsegment", SEGMENTS)


@query(f"""SELECT c_custkey, c_mktsegment FROM customer
           WHERE c_mktsegment IS NULL OR c_mktsegment NOT IN ({SEGMENTS_SQL})""")
def not_in_list(spark, d):
    return filters.not_in_list(table(spark, d, "customer").select("c_custkey", "c_mktsegment"),
                               "c_mktsegment", SEGMENTS)


@query(f"SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = '{SEGMENTS[1]}'")
def eq_list_item(spark, d):
    return filters.equals_item(table(spark, d, "customer").select("c_custkey", "c_mktsegment"),
                               "c_mktsegment", SEGMENTS, 1)


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (
          SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 9000)""")
def broadcast_semi(spark, d):
    rich = table(spark, d, "customer").where("c_acctbal > 9000").select("c_custkey")
    return joins.list_semi(table(spark, d, "orders").select("o_orderkey", "o_custkey"),
                           rich, "o_custkey").select("o_orderkey", "o_custkey")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (
          SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 9000)""")
def broadcast_anti(spark, d):
    rich = table(spark, d, "customer").where("c_acctbal > 9000").select("c_custkey")
    return joins.list_anti(table(spark, d, "orders").select("o_orderkey", "o_custkey"),
                           rich, "o_custkey").select("o_orderkey", "o_custkey")


@query("""SELECT a.s_nationkey, COUNT(*) // COUNT(DISTINCT a.s_suppkey) AS other_rows,
                 CAST(SUM(CAST(b.s_acctbal AS DECIMAL(18, 2))) / COUNT(DISTINCT a.s_suppkey)
                      AS DOUBLE) AS other_sum,
                 CAST(MAX(CAST(b.s_acctbal AS DECIMAL(18, 2))) AS DOUBLE) AS other_max
          FROM supplier a JOIN supplier b ON a.s_nationkey <> b.s_nationkey
          GROUP BY a.s_nationkey""")
def theta_self_join(spark, d):
    cents = table(spark, d, "supplier").select(
        "s_nationkey", F.col("s_acctbal").cast("decimal(18,2)").alias("balance"))
    return joins.summarize_others(cents, "s_nationkey", "balance").select(
        "s_nationkey", "other_rows", F.col("other_sum").cast("double").alias("other_sum"),
        F.col("other_max").cast("double").alias("other_max"))


@query("""SELECT n_regionkey, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS joined
          FROM nation GROUP BY n_regionkey""")
def reduce_concat(spark, d):
    return aggregates.joined_text(table(spark, d, "nation"), "n_name", ["n_regionkey"])


@query("""WITH whole AS (SELECT string_agg(o_orderpriority, '; ' ORDER BY o_orderpriority) AS t
                         FROM orders)
          SELECT i AS piece, i * 4096 AS at, substring(t, i * 4096 + 1, 4096) AS joined
          FROM (SELECT t, unnest(range((length(t) + 4095) // 4096)) AS i FROM whole)""")
def reduce_column(spark, d):
    """A whole column of much repeated values, reduced to one text in pieces."""
    return aggregates.joined_text_pieces(table(spark, d, "orders"), "o_orderpriority", "; ", 4096)


TOP_SQL = """SELECT c_mktsegment, c_name, c_acctbal FROM (
  SELECT *, row_number() OVER (PARTITION BY c_mktsegment
                               ORDER BY c_acctbal DESC NULLS LAST, c_name) AS rn FROM customer)
  WHERE rn = 1 ORDER BY c_acctbal DESC"""


@query(TOP_SQL)
def top_row_per_group(spark, d):
    best = aggregates.top_per_group(
        table(spark, d, "customer"), "c_mktsegment", "c_acctbal", tie="c_name")
    return ordering.sort_desc(best, "c_acctbal", "c_mktsegment")


@query(TOP_SQL)
def top_row_window(spark, d):
    rows = table(spark, d, "customer").select("c_mktsegment", "c_name", "c_acctbal")
    best = aggregates.top_per_group_window(rows, "c_mktsegment", "c_acctbal", tie="c_name")
    return ordering.sort_desc(best, "c_acctbal", "c_mktsegment")


COUNTS_SQL = """SELECT count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS building,
                       count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS machinery
                FROM customer"""


def _segment_conditions():
    return {"building": F.col("c_mktsegment") == "BUILDING",
            "machinery": F.col("c_mktsegment") == "MACHINERY"}


@query(COUNTS_SQL)
def conditional_counts(spark, d):
    return aggregates.conditional_counts(table(spark, d, "customer"), _segment_conditions())


@query(COUNTS_SQL)
def observed_counts(spark, d):
    """The counts fall out of another action, here the write of a copy."""
    rows, seen = aggregates.observe_counts(
        table(spark, d, "customer").select("c_mktsegment"), _segment_conditions())
    rows.write.parquet(scratch_path(spark, "observed"))
    return spark.createDataFrame([seen.get], "building long, machinery long")


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) + 7 AS date_next_week,
                 'no_null_value' AS no_nulls, FALSE AS is_null FROM orders""")
def date_null_fill(spark, d):
    dated = table(spark, d, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("date_today"),
        F.current_timestamp().alias("stamp_now"), fn.typed_null("string").alias("nulls"))
    filled = projections.fill_nulls(dated, "no_null_value", ["date_today", "stamp_now", "nulls"])
    return filled.select(
        "o_orderkey", fn.add_days(F.col("date_today"), 7).alias("date_next_week"),
        F.col("nulls").alias("no_nulls"), F.col("nulls").isNull().alias("is_null"))


@query("SELECT c_name || ' says hello' AS greeting FROM customer")
def inline_records(spark, d):
    people = table(spark, d, "customer").select(
        F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).alias("p"))
    return people.select(fn.says(joins.nested_field("p", "name"), "says hello").alias("greeting"))


@query("""SELECT c_nationkey AS nationkey FROM customer
          UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation""")
def union_distinct(spark, d):
    parts = [table(spark, d, t).select(F.col(c).alias("nationkey"))
             for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"),
                          ("nation", "n_nationkey"))]
    return sets.distinct_union(parts)


@query("""SELECT COALESCE(c, o) AS custkey, c IS NOT NULL AND o IS NOT NULL AS in_and,
                 TRUE AS in_or, c IS NULL OR o IS NULL AS in_xor,
                 c IS NOT NULL AND o IS NULL AS in_and_not
          FROM (SELECT DISTINCT c_custkey AS c FROM customer)
          FULL JOIN (SELECT DISTINCT o_custkey AS o FROM orders WHERE o_totalprice > 400000)
          ON c = o""")
def set_algebra(spark, d):
    left, right = _customer_keys(spark, d)
    return sets.set_algebra(left, right, "custkey")


def _customer_keys(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 400000")
    return (table(spark, d, "customer").select(F.col("c_custkey").alias("custkey")),
            big.select(F.col("o_custkey").alias("custkey")))


_SETS = """(SELECT c_custkey AS custkey FROM customer) {} 
           (SELECT o_custkey AS custkey FROM orders WHERE o_totalprice > 400000)"""


@query(_SETS.format("INTERSECT"))
def set_intersection(spark, d):
    return sets.set_and(*_customer_keys(spark, d))


@query(_SETS.format("UNION"))
def set_union(spark, d):
    return sets.set_or(*_customer_keys(spark, d))


@query(_SETS.format("EXCEPT"))
def set_difference(spark, d):
    return sets.set_and_not(*_customer_keys(spark, d))


@query("""SELECT COALESCE(c, o) AS custkey
          FROM (SELECT DISTINCT c_custkey AS c FROM customer)
          FULL JOIN (SELECT DISTINCT o_custkey AS o FROM orders WHERE o_totalprice > 400000)
          ON c = o WHERE c IS NULL OR o IS NULL""")
def set_symmetric_difference(spark, d):
    return sets.set_xor(*_customer_keys(spark, d), "custkey")


@query("""SELECT COUNT(*) > 0 AS overlap, COUNT(*) AS shared_keys FROM (
          SELECT c_custkey FROM customer INTERSECT
          SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def sets_overlap(spark, d):
    return sets.sets_overlap(*_customer_keys(spark, d), "custkey")


@query("""WITH names AS (SELECT p_partkey, unnest(string_split(p_name, '')) AS ch,
                               string_split(lower(p_type), '') AS kind FROM part)
          SELECT p_partkey, COALESCE(string_agg(DISTINCT ch, '' ORDER BY ch)
                   FILTER (WHERE list_contains(kind, ch)), '') AS common,
                 bool_or(list_contains(kind, ch)) AS overlap
          FROM names GROUP BY p_partkey""")
def array_overlap(spark, d):
    name, kind = fn.characters(F.col("p_name")), fn.characters(F.lower("p_type"))
    return table(spark, d, "part").select(
        "p_partkey", F.array_join(F.array_sort(sets.array_common(name, kind)), "").alias("common"),
        sets.arrays_share(name, kind).alias("overlap"))


@query("""SELECT p_partkey, TRY_CAST(word AS BIGINT) AS number,
                 TRY_CAST(word AS BIGINT) IS NULL AS rejected
          FROM (SELECT p_partkey, CASE WHEN p_size > 25 THEN substring(p_brand, 7)
                                       ELSE p_type END AS word FROM part)""")
def text_to_int_rejects(spark, d):
    word = F.when(F.col("p_size") > 25, F.substring("p_brand", 7, 100)).otherwise(F.col("p_type"))
    read = table(spark, d, "part").select("p_partkey", fn.text_to_int(word).alias("number"))
    return read.withColumn("rejected", F.col("number").isNull())


@query("SELECT COALESCE(MAX(o_orderkey), 0) AS max_value FROM orders WHERE o_totalprice < 0")
def max_default(spark, d):
    return aggregates.max_or(table(spark, d, "orders").where("o_totalprice < 0"), "o_orderkey")


@query("""SELECT l_orderkey AS id, bool_and(l_quantity > 5) AS complete, COUNT(*) AS parts
          FROM lineitem GROUP BY l_orderkey""")
def parts_complete(spark, d):
    """An order is complete once all its lines have a value; small lines have none."""
    parts = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.when(F.col("l_quantity") > 5, F.col("l_returnflag")).alias("value"))
    return aggregates.all_parts_complete(parts, "id", "value")


_URGENCY = [("1-URGENT", 4), ("2-HIGH", 3), ("3-MEDIUM", 2), ("none of these", 9)]


@query("""SELECT o_orderkey, urgency FROM orders JOIN (VALUES
            """ + ", ".join(f"('{p}', {u})" for p, u in _URGENCY) + """) v(priority, urgency)
          ON o_orderpriority = priority""")
def inline_table_join(spark, d):
    """All orders against a table written in the program."""
    scale = inline.from_rows(spark, _URGENCY, "o_orderpriority string, urgency int")
    return table(spark, d, "orders").join(scale, "o_orderpriority").select("o_orderkey", "urgency")


@query("""SELECT k AS value FROM (SELECT unnest(range(lo, hi + 1)) AS k FROM (
            SELECT min(o_custkey) AS lo, max(o_custkey) AS hi FROM orders))
          WHERE k NOT IN (SELECT o_custkey FROM orders)""")
def missing_keys(spark, d):
    """Whole numbers between the first and last customer of all orders that have none."""
    orders = table(spark, d, "orders")
    ends = orders.agg(F.min("o_custkey").alias("lo"), F.max("o_custkey").alias("hi")).first()
    every = inline.number_range(spark, ends.lo, ends.hi)
    return every.join(orders.select(F.col("o_custkey").alias("value")), "value", "left_anti")


@query("""SELECT o_orderkey, o_orderdate < current_date AS before_today,
                 o_orderdate < current_localtimestamp() AS before_now FROM orders""")
def before_now(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_orderdate") < F.current_date()).alias("before_today"),
        (F.col("o_orderdate") < F.localtimestamp()).alias("before_now"))
