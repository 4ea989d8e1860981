"""Ranges, segments and primes."""

import time

import pytest
from pyspark.sql import functions as F

from loomwork import functions as fn
from loomwork.operators import aggregates, sets
from loomwork.plans import primes
from loomwork.sources import inline


def requests(spark, *ranges):
    return spark.createDataFrame(
        [(i, a, b) for i, (a, b) in enumerate(ranges)],
        "request int, range_start long, range_end long")


def found(spark, start, end, **kwargs):
    return sorted(r["prime"] for r in primes.primes_between(spark, start, end, **kwargs).collect())


@pytest.mark.parametrize("start, end, expected", [
    (1, 10, [2, 3, 5, 7]), (5, 11, [5, 7, 11]), (11, 5, []), (-7, 2, [2]), (4, 4, []),
])
def test_golden_ranges(spark, start, end, expected):
    assert found(spark, start, end) == expected
    both = primes.primes_in_ranges(requests(spark, (start, end))).collect()
    assert sorted(r["prime"] for r in both) == expected


def test_a_million(spark):
    got = primes.primes_between(spark, 1, 10 ** 6, segment=30_011).agg(
        F.count("prime").alias("n"), F.sum("prime").alias("s")).first()
    assert (got["n"], got["s"]) == (78498, 37550402023)


def test_far_out(spark):
    # around squares of primes beyond the dense part of the sieve
    lo = 99_991 ** 2 - 50
    got = set(found(spark, lo, lo + 200, segment=64))
    assert 99_991 ** 2 not in got
    by_rule = inline.number_range(spark, lo, lo + 200).where(fn.is_prime(F.col("value"))).collect()
    assert got == {r["value"] for r in by_rule}


def test_predicate(spark):
    n = inline.number_range(spark, -10, 5000)
    got = {r["value"] for r in n.where(fn.is_prime(F.col("value"))).collect()}
    assert got == set(found(spark, 0, 5000))
    none = spark.createDataFrame([(None,)], "value long").select(
        fn.is_prime(F.col("value")).alias("p")).first()
    assert none["p"] is False


def test_overlapping_requests(spark):
    got = primes.primes_in_ranges(requests(spark, (1, 10), (5, 11)))
    merged = sets.distinct_union([got.where(f"request = {i}").select("prime") for i in (0, 1)])
    assert sorted(r["prime"] for r in merged.collect()) == [2, 3, 5, 7, 11]
    assert aggregates.max_or(got, "prime").first()["max_value"] == 11
    assert aggregates.max_or(got.where("false"), "prime").first()["max_value"] == 0
    pieces = aggregates.number_list_pieces(got, "prime", width=6).orderBy("piece").collect()
    assert ";".join(r["joined"] for r in pieces) == "2;3;5;7;11"


def test_segments(spark):
    req = requests(spark, (0, 10), (5, 4), (7, 8))
    equal = primes.equal_segments(req, 3).orderBy("request", "segment").collect()
    assert [(r["request"], r["lo"], r["hi"]) for r in equal] == [
        (0, 0, 2), (0, 3, 5), (0, 6, 10), (2, 7, 6), (2, 7, 6), (2, 7, 8)]
    fixed = primes.fixed_segments(req, 4).orderBy("request", "segment").collect()
    assert [(r["request"], r["lo"], r["hi"]) for r in fixed] == [
        (0, 0, 3), (0, 4, 7), (0, 8, 10), (2, 7, 8)]


def test_very_long_range(spark):
    some = primes.fixed_segments(requests(spark, (1, 10 ** 15))).limit(3).collect()
    assert all(r["lo"] == 1 + r["segment"] * primes.SEGMENT for r in some) and len(some) == 3
    many = primes.fixed_segments(requests(spark, (3, 10_000)), 7)
    got = many.agg(F.count("*").alias("n"), F.sum(F.col("hi") - F.col("lo") + 1).alias("s")).first()
    assert (got["n"], got["s"]) == (1429, 9998)


def test_range_source(spark):
    assert inline.number_range(spark, 3, 5).count() == 3
    assert inline.number_range(spark, 5, 3).count() == 0


def test_large_numbers(spark):
    def plain(n):
        return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))
    near = [10 ** 12 + i for i in range(2000)]
    start = time.perf_counter()
    rows = spark.createDataFrame([(n,) for n in near], "n long").where(fn.is_prime(F.col("n"))).collect()
    assert time.perf_counter() - start < 5
    sieved = found(spark, near[0], near[-1])
    assert sorted(r.n for r in rows) == sieved
    # squares of primes, strong pseudoprimes to few bases, the largest primes of a long
    some = {211 ** 2: False, 223 * 227: False, 2047: False, 3215031751: False,
            3474749660383: False, 341550071728321: False, 3825123056546413051: False,
            2 ** 61 - 1: True, 9223372036854775783: True, 9223372036854775807: False,
            -7: False, 0: False, 1: False, 2: True, 4_294_967_291: True}
    df = spark.createDataFrame([(n,) for n in some], "n long")
    assert {r.n: r.p for r in df.select("n", fn.is_prime(F.col("n")).alias("p")).collect()} == some
    assert all(plain(n) == p for n, p in some.items() if n < 10 ** 7)


def test_numbers_are_sieved_once(spark, monkeypatch):
    req = requests(spark, (1, 5000), (90, 100), (4000, 9000), (4000, 9000), (8990, 8990), (7, 3), (-9, 2))
    calls = []
    plain = primes._sieve
    monkeypatch.setattr(primes, "_sieve", lambda lo, hi, base: calls.append((lo, hi)) or plain(lo, hi, base))
    pieces = primes.grid_segments(req.where("range_end >= 2"), 1000).orderBy("segment", "lo", "hi").toArrow()
    once = [p for b in primes._sieve_cells(True)(pieces.to_batches()) for p in b.column("prime").to_pylist()]
    assert once == found(spark, 1, 9000)
    spans = sorted(calls)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))  # no number twice
    got = primes.primes_of_ranges(req, 1000)
    assert sorted(r.prime for r in got.collect()) == once
    each = primes.primes_in_ranges(req, 1000).groupBy("request").count().collect()
    assert {r.request: r["count"] for r in each} == {
        0: len(found(spark, 1, 5000)), 1: 1, 2: len(found(spark, 4000, 9000)),
        3: len(found(spark, 4000, 9000)), 6: 1}
