"""Column functions for which Spark has no expression; Arrow batches in, Arrow batches out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _prime_test():
    small = [n for n in range(2, 212) if all(n % d for d in range(2, int(n ** 0.5) + 1))]
    #: below the first number, the bases up to the second leave no composite through
    enough = [(2_047, 2), (1_373_653, 3), (25_326_001, 5), (3_215_031_751, 7),
              (2_152_302_898_747, 11), (3_474_749_660_383, 13), (341_550_071_728_321, 17),
              (3_825_123_056_546_413_051, 23), (1 << 64, 37)]

    def strong(n: int) -> bool:
        """No base shows that the odd number n is composite."""
        last = next(base for bound, base in enough if n < bound)
        odd, twos = n - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for a in small:
            if a > last:
                return True
            x = pow(a, odd, n)
            if x in (1, n - 1):
                continue
            for _ in range(twos - 1):
                x = x * x % n
                if x == n - 1:
                    break
            else:
                return False
        return True

    def test(column: pd.Series) -> pd.Series:
        n = column.fillna(0).to_numpy(np.int64)
        prime = n >= 2
        for p in small:  # by whole batches: few composites get beyond
            prime &= (n % p != 0) | (n == p)
        open_ones = np.flatnonzero(prime & (n >= 211 * 211))
        prime[open_ones] = [strong(int(v)) for v in n[open_ones].tolist()]
        return pd.Series(prime)

    return test


def is_prime(col: Column) -> Column:
    """Whether a whole number is prime; numbers below 2 and null are not.

    For the values of a column: small divisors for whole batches, then strong tests to
    fixed bases that leave no composite below 2**64 through. The work of a number grows
    with its digits, not with its root. Whole ranges are sieved instead, see
    ``loomwork.plans.primes``.
    """
    # counted as text first, so that a null stays a whole number on its way
    return F.pandas_udf(_prime_test(), "boolean")(F.coalesce(col.cast("long"), F.lit(0).cast("long")))


def _longest_common():
    primes = (2_147_483_629, 2_147_483_587)  # products of two residues fit 64 bits
    base = 1_000_003

    def powers(n: int, p: int, b: int) -> np.ndarray:
        out = np.ones(n + 1, np.int64)
        done = 1
        while done <= n:  # double what is known
            step = min(done, n + 1 - done)
            out[done:done + step] = out[:step] * pow(b, done, p) % p
            done += step
        return out

    class Text:
        """Prefix sums of a text, from which any window's hash follows."""

        def __init__(self, text: str):
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
            self.text, self.sums, self.down = text, [], []
            for p in primes:
                up = powers(len(codes), p, base)[:len(codes)]
                self.sums.append(np.concatenate(([0], np.cumsum(codes * up % p))) % p)
                self.down.append(powers(len(codes), p, pow(base, -1, p)))

        def windows(self, width: int) -> np.ndarray:
            parts = []
            for p, s, down in zip(primes, self.sums, self.down):
                last = len(s) - width
                parts.append((s[width:] - s[:last]) % p * down[:last] % p)
            return parts[0] << 31 | parts[1]

    def common(a: Text, b: Text, width: int) -> str | None:
        """The smallest text of this width in both; equal hashes are compared as text."""
        _, left, right = np.intersect1d(a.windows(width), b.windows(width), return_indices=True)
        found = (a.text[i:i + width] for i, j in zip(left.tolist(), right.tolist())
                 if a.text[i:i + width] == b.text[j:j + width])
        return min(found, default=None)

    def pair(left: str | None, right: str | None) -> str | None:
        if left is None or right is None:
            return None
        low, high, best = 0, min(len(left), len(right)) + 1, ""
        if len(left) + len(right) <= 512:  # short windows are their own names
            def share(width):
                mine = {left[i:i + width] for i in range(len(left) - width + 1)}
                return min((right[i:i + width] for i in range(len(right) - width + 1)
                            if right[i:i + width] in mine), default=None)
        else:
            a, b = Text(left), Text(right)

            def share(width):
                return common(a, b, width)
        while high - low > 1:  # sharing a width means sharing all below
            width = (low + high) // 2
            found = share(width)
            low, high, best = (width, high, found) if found is not None else (low, width, best)
        return best

    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([pair(a, b) for a, b in zip(left, right)], dtype=object)

    return run


def pair_lcs(left: Column, right: Column) -> Column:
    """Longest common substring of two texts in the same row.

    Row-local, so a table of pairs needs no shuffle. Prefix sums give the hash of any
    window at once, so a width costs one pass over both texts, and about log2 of the
    length are tried; what hashes say is compared as text. Ties give the smallest
    string, nothing shared gives ``""``, null with anything gives null. A whole column
    against itself goes through ``loomwork.plans.substrings``.
    """
    return F.pandas_udf(_longest_common(), "string")(left, right)
