"""Bit sets over keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork import functions as fn
from loomwork.catalog.registry import query, table
from loomwork.operators import bitmaps, joins


@query("""SELECT l_returnflag, COUNT(DISTINCT l_orderkey) AS cardinality,
                 COUNT(DISTINCT l_orderkey) = 0 AS is_empty
          FROM lineitem GROUP BY l_returnflag""")
def bitmap_cardinality(spark, d):
    bits = bitmaps.bitmap_build(table(spark, d, "lineitem"), "l_orderkey", ["l_returnflag"])
    return bitmaps.bitmap_cardinality(bits, ["l_returnflag"])


@query("""SELECT COUNT(DISTINCT l_orderkey) AS cardinality,
                 COUNT(DISTINCT l_orderkey) = 0 AS is_empty FROM lineitem""")
def bitmap_union(spark, d):
    partial = bitmaps.bitmap_build(table(spark, d, "lineitem"), "l_orderkey", ["l_returnflag"])
    return bitmaps.bitmap_cardinality(bitmaps.bitmap_union(partial))


@query("""SELECT o_orderkey AS position FROM orders WHERE o_totalprice > 300000
          INTERSECT SELECT l_orderkey FROM lineitem WHERE l_quantity > 45""")
def bitmap_common(spark, d):
    left = table(spark, d, "orders").where("o_totalprice > 300000")
    right = table(spark, d, "lineitem").where("l_quantity > 45")
    both = bitmaps.bitmap_common(bitmaps.bitmap_build(left, "o_orderkey"),
                                 bitmaps.bitmap_build(right, "l_orderkey"))
    return bitmaps.bitmap_positions(both)


@query("""SELECT o_orderkey, o_orderkey IN (
            SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AS member FROM orders""")
def bitmap_membership(spark, d):
    bits = bitmaps.bitmap_build(table(spark, d, "lineitem").where("l_quantity > 45"), "l_orderkey")
    return bitmaps.bitmap_contains(table(spark, d, "orders").select("o_orderkey"),
                                   "o_orderkey", bits)


@query("SELECT COALESCE(MAX(l_orderkey) + 1, 0) AS length FROM lineitem")
def bitmap_length(spark, d):
    return bitmaps.logical_length(table(spark, d, "lineitem"), "l_orderkey")


@query("""SELECT o_orderstatus, COUNT(DISTINCT p) AS cardinality, COUNT(DISTINCT p) = 0 AS is_empty
          FROM (SELECT o_orderstatus, unnest(range(o_orderkey, o_orderkey + o_custkey)) AS p
                FROM orders) GROUP BY o_orderstatus""")
def bitmap_ranges(spark, d):
    ranges = table(spark, d, "orders").select(
        "o_orderstatus", "o_orderkey", (F.col("o_orderkey") + F.col("o_custkey")).alias("end"))
    bits = bitmaps.bitmap_from_ranges(ranges, "o_orderkey", "end", ["o_orderstatus"])
    return bitmaps.bitmap_cardinality(bits, ["o_orderstatus"])


@query("""SELECT p_partkey, (m >> i) & 1 = 1 AS bit, m | b AS with_bit, m & ~b AS without_bit,
                 xor(m, b) AS flipped
          FROM (SELECT p_partkey, p_partkey AS m, p_size % 60 AS i,
                       CAST(1 AS BIGINT) << (p_size % 60) AS b FROM part)""")
def bit_flags(spark, d):
    mask, at = F.col("p_partkey"), F.col("p_size") % 60
    return table(spark, d, "part").select(
        "p_partkey", fn.bit_get(mask, at).alias("bit"), fn.bit_set(mask, at).alias("with_bit"),
        fn.bit_clear(mask, at).alias("without_bit"), fn.bit_flip(mask, at).alias("flipped"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (
          SELECT o_orderkey FROM orders WHERE o_totalprice > 450000)""")
def bloom_semi_join(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    dear = table(spark, d, "orders").where("o_totalprice > 450000").select("o_orderkey")
    return joins.bloom_semi_join(rows, "l_orderkey", dear, "o_orderkey").select(
        "l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
          WHERE l_orderkey % 4096 IN (
            SELECT o_orderkey % 4096 FROM orders WHERE o_totalprice > 450000)""")
def bitmap_prefilter(spark, d):
    """The pre-filter alone, with a position both engines can compute."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    dear = table(spark, d, "orders").where("o_totalprice > 450000").select("o_orderkey")
    return joins.bitmap_prefilter(rows, "l_orderkey", dear, "o_orderkey", bits=4096,
                                  position=lambda c: F.pmod(c, F.lit(4096))).select(
        "l_orderkey", "l_linenumber", "l_partkey")
