"""Digests, hints and last-writer-wins."""

import hashlib
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomwork.operators import joins
from loomwork.plans import hints, lastwriter

STATE = "key int, value string, counter int, identifier int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def hint_tables(spark):
    known = ["ABC", "ABD", "ACD", "BCD"]
    entities = spark.createDataFrame([
        (1, "ABCD", sha("ABBA"), [sha("ABC"), sha("ABD")]),   # C and D go
        (2, "ABCD", sha("CCDD"), [sha("BCD"), sha("zzz")]),   # one hint unknown
        (3, "ABCD", sha("nope"), [sha("ACD")]),               # value unknown
        (4, "ABCD", sha("AAAA"), []),                         # no hints at all
    ], "id int, alphabet string, digest string, hints array<string>")
    values = spark.createDataFrame([(k,) for k in known], "value string")
    return entities, values


def test_elimination(spark):
    entities, values = hint_tables(spark)
    got = {r["id"]: (r["remaining"], r["solved_hints"], r["complete"]) for r in hints.eliminate(
        entities, hints.solve_hints(entities, values)).collect()}
    assert got == {1: ("AB", 2, True), 2: ("BCD", 1, False), 3: ("ACD", 1, True),
                   4: ("ABCD", 0, False)}


def test_resolution(spark):
    entities, values = hint_tables(spark)
    candidates = spark.createDataFrame([("ABBA",), ("CCDD",), ("AAAA",), ("",)], "value string")
    got = {r["id"]: r["resolved"] for r in hints.resolve_entities(
        entities, values, candidates).collect()}
    assert got == {1: "ABBA", 2: None, 3: None, 4: None}


def test_digest_join_is_one_to_one(spark):
    digests = spark.createDataFrame([(1, sha("a")), (2, sha("a")), (3, sha("c"))], "id int, d string")
    values = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "v string")
    assert joins.digest_join(digests, "d", values, "v").count() == 2
    assert joins.digest_join(digests, "d", values, "v", "left").count() == 3


def merged(spark, rows):
    df = spark.createDataFrame(rows, STATE)
    return {r["key"]: (r["value"], r["counter"], r["identifier"])
            for r in lastwriter.merge_replicas(df).collect()}


def test_merge_cases(spark):
    assert merged(spark, [
        (1, "old", 1, 9), (1, "new", 2, 1),        # larger counter
        (2, "low", 5, 1), (2, "high", 5, 2),       # equal counter, larger identifier
        (3, "same", 4, 4), (3, "same", 4, 4),      # a repeat
    ]) == {1: ("new", 2, 1), 2: ("high", 5, 2), 3: ("same", 4, 4)}


def test_writes(spark):
    state = spark.createDataFrame([
        (1, "s", 5, 5), (2, "s", 5, 5), (3, "s", 5, 5), (4, "s", 5, 5), (5, "s", 5, 5)], STATE)
    writes = spark.createDataFrame([
        (1, "w", 4, 9),                            # older: dropped
        (2, "w", 5, 6), (3, "w", 5, 4),            # equal: by identifier
        (4, "w", 5, 5),                            # exact tie: dropped
        (6, "w", 0, 1),                            # new key
        (5, "a", 6, 1), (5, "b", 7, 1),            # the better of two
    ], STATE)
    after = lastwriter.apply_writes(state, writes)
    got = {r["key"]: (r["value"], r["counter"], r["identifier"]) for r in after.collect()}
    assert got == {1: ("s", 5, 5), 2: ("w", 6, 6), 3: ("s", 5, 5), 4: ("s", 5, 5),
                   5: ("b", 8, 1), 6: ("w", 1, 1)}
    asked = spark.createDataFrame([(2,), (99,)], "key int")
    assert [r["key"] for r in lastwriter.read_keys(after, asked).collect()] == [2]


@settings(max_examples=4, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from("abc"), st.integers(0, 3),
                          st.integers(0, 3)), min_size=1, max_size=12))
def test_merge_ignores_order(spark, rows):
    model = {}
    for k, v, c, i in rows:
        model[k] = max(model.get(k, (-1, -1, "")), (c, i, v))
    shuffled = random.Random(1).sample(rows, len(rows))
    expected = {k: (v, c, i) for k, (c, i, v) in model.items()}
    assert merged(spark, rows) == merged(spark, shuffled) == expected
