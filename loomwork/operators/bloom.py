"""Bloom filters as tables of words: k bits of one 64-bit word per key.

A key's hash picks a word, a second hash k bits in it. Words are combined by ``bit_or``,
which Spark does map-side, and probed by a join on the word's number, with one row on
the filter's side. So a filter may have any size: one below Spark's threshold is
broadcast, a larger one is dealt by word with the rows to be probed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.session import materialize

WORD_BITS = 64


@dataclass(frozen=True)
class Bloom:
    """``words`` has ``__word, __bits``; ``n_words`` words in all, ``hashes`` bits per key."""

    words: DataFrame
    n_words: int
    hashes: int


def expected_rate(keys_per_word: float, hashes: int) -> float:
    """The share of strangers let through, for words that hold a Poisson number of keys."""
    rate, chance = 0.0, math.exp(-keys_per_word)
    for keys in range(int(keys_per_word * 4) + 60):
        filled = 1 - (1 - 1 / WORD_BITS) ** (hashes * keys)
        rate += chance * filled ** hashes
        chance *= keys_per_word / (keys + 1)
    return rate


def sized(keys: int, rate: float) -> tuple[int, int]:
    """Fewest words, and bits per key, that keep the expected rate of strangers."""
    if not 0 < rate < 1:
        raise ValueError("a rate lies between 0 and 1")
    best = (0.0, 1)
    for hashes in range(1, 11):  # six bits of one hash each
        low, high = 1e-6, float(WORD_BITS)
        for _ in range(50):
            mid = (low + high) / 2
            low, high = (mid, high) if expected_rate(mid, hashes) <= rate else (low, mid)
        best = max(best, (low, hashes))
    return max(1, math.ceil(keys / best[0])), best[1]


def _place(key: Column, n_words: int, hashes: int) -> tuple[Column, Column]:
    """A key's word and its bits there."""
    word = F.pmod(F.xxhash64(key), F.lit(n_words).cast("long"))
    second = F.xxhash64(key, F.lit("bits"))
    bits = None
    for i in range(hashes):
        at = F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(WORD_BITS - 1).cast("long"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return word, bits


def build(members: DataFrame, member: str, rate: float = 0.01, keys: int | None = None) -> Bloom:
    """A filter of the non-null members that lets through about ``rate`` of all strangers.

    Sized for ``keys`` distinct members; without a number they are estimated first.
    """
    given = members.select(F.col(member).alias("m")).where("m IS NOT NULL")
    if keys is None:
        keys = given.agg(F.approx_count_distinct("m", 0.02)).first()[0]
    n_words, hashes = sized(max(keys, 1), rate)
    word, bits = _place(F.col("m"), n_words, hashes)
    words = given.select(word.alias("__word"), bits.alias("b")).groupBy("__word").agg(
        F.bit_or("b").alias("__bits"))
    return Bloom(materialize(words, "bloom"), n_words, hashes)


def union(a: Bloom, b: Bloom) -> Bloom:
    """The filter of both sets of members, of filters with the same measures."""
    if (a.n_words, a.hashes) != (b.n_words, b.hashes):
        raise ValueError("filters of different size")
    both = a.words.unionByName(b.words).groupBy("__word").agg(F.bit_or("__bits").alias("__bits"))
    return Bloom(materialize(both, "bloom"), a.n_words, a.hashes)


def passing(df: DataFrame, key: str, built: Bloom) -> DataFrame:
    """Rows whose key may be a member: all true ones and a small share of others."""
    word, bits = _place(F.col(key), built.n_words, built.hashes)
    probe = df.withColumns({"__word": word, "__own": bits})
    found = probe.join(built.words, "__word").where(
        F.col("__bits").bitwiseAND(F.col("__own")) == F.col("__own"))
    return found.where(F.col(key).isNotNull()).select(*df.columns)
