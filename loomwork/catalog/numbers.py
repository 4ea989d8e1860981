"""Number ranges, segments and primes; the ranges span the order keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork import functions as fn
from loomwork.catalog.registry import query, table
from loomwork.operators import aggregates
from loomwork.plans import primes

_REQUESTS = """SELECT o_orderstatus AS request, MIN(o_orderkey) AS range_start,
               MAX(o_orderkey) AS range_end FROM orders GROUP BY o_orderstatus"""
_NUMBERS = f"""SELECT request, unnest(range(range_start, range_end + 1)) AS n
               FROM ({_REQUESTS})"""
_PRIMES = f"""
  WITH bound AS (SELECT CAST(sqrt(MAX(o_orderkey)) AS BIGINT) + 1 AS b FROM orders),
       divisors AS MATERIALIZED (SELECT unnest(range(2, b + 1)) AS d FROM bound),
       numbers AS MATERIALIZED (SELECT DISTINCT n FROM ({_NUMBERS})),
       composite AS MATERIALIZED (SELECT DISTINCT n FROM numbers, divisors
                     WHERE d * d <= n AND n % d = 0),
       found AS (SELECT request, n AS prime FROM ({_NUMBERS})
                 WHERE n >= 2 AND n NOT IN (SELECT n FROM composite))
"""


def _requests(spark, d):
    """One range per order status, from its smallest to its largest order key."""
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("request")).agg(
        F.min("o_orderkey").alias("range_start"), F.max("o_orderkey").alias("range_end"))


def _found(spark, d):
    # the small test ranges would be a single default segment
    return primes.primes_in_ranges(_requests(spark, d), segment=1 << 16)


@query(_PRIMES + "SELECT request, prime FROM found")
def primes_in_range(spark, d):
    return _found(spark, d)


@query(_PRIMES + "SELECT COALESCE(MAX(prime), 0) AS max_value FROM found")
def primes_max(spark, d):
    return aggregates.max_or(_found(spark, d), "prime")


@query(_PRIMES + "SELECT CAST(SUM(prime) AS BIGINT) AS total FROM "
                 "(SELECT DISTINCT prime FROM found)")
def primes_sum(spark, d):
    once = primes.primes_of_ranges(_requests(spark, d), segment=1 << 16)
    return aggregates.sum_where(once, "prime", F.lit(True))


@query(_PRIMES + """SELECT prime // 10000 AS piece, CAST(COUNT(*) AS INTEGER) AS items,
                           string_agg(CAST(prime AS VARCHAR), ';' ORDER BY prime) AS joined
                    FROM (SELECT DISTINCT prime FROM found) GROUP BY ALL""")
def primes_list(spark, d):
    return aggregates.number_list_pieces(_found(spark, d), "prime", width=10_000)


@query(_PRIMES + """SELECT o_orderkey, o_orderkey IN (SELECT prime FROM found) AS is_prime
                    FROM orders""")
def prime_keys(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", fn.is_prime(F.col("o_orderkey")).alias("is_prime"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 100 AND o_custkey * 10")
def key_between(spark, d):
    return table(spark, d, "orders").where(
        fn.in_range(F.col("o_orderkey"), 100, F.col("o_custkey") * 10)).select("o_orderkey")


@query(f"""SELECT request, CAST(segment AS INTEGER) AS segment, range_start + segment * n AS lo,
                  CASE WHEN segment = 3 THEN range_end
                       ELSE range_start + (segment + 1) * n - 1 END AS hi
           FROM (SELECT *, (range_end - range_start + 1) // 4 AS n, unnest(range(0, 4)) AS segment
                 FROM ({_REQUESTS}))""")
def range_segments(spark, d):
    return primes.equal_segments(_requests(spark, d), 4)


@query(f"""SELECT request, segment, range_start + segment * 1000 AS lo,
                  LEAST(range_end, range_start + (segment + 1) * 1000 - 1) AS hi
           FROM (SELECT *, unnest(range(0, (range_end - range_start) // 1000 + 1)) AS segment
                 FROM ({_REQUESTS}))""")
def range_segments_fixed(spark, d):
    return primes.fixed_segments(_requests(spark, d), 1000)
