"""Language identification with bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.words import mix
from loomwork.llm.steps import bound_batches, materialize

SIZES = (3, 4)
PROBES = 3
SAMPLE_PER_LANGUAGE = 4000  # documents a language is learned from, about
GRAMS_PER_LANGUAGE = 200_000
CHUNK_CHARS = 1 << 18
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-gram hashes of texts, where each text's begin (texts + 1), and letters per text.

    Texts are lower-cased, all but letters is space, and n-grams with two spaces
    in a row are left out, so none spans two texts.
    """
    low = [t.lower() for t in texts]
    ends = np.cumsum([len(t) + 2 for t in low])
    starts = np.concatenate(([0], ends[:-1])) + 1
    points = np.frombuffer(
        "".join(f" {t} " for t in low).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[points]
    upto = np.concatenate(([0], np.cumsum(letter)))
    codes = np.where(letter, points, 0x20).astype(np.uint64)
    pair = ~(letter[:-1] | letter[1:])  # two spaces here and next
    hashes, at = [], []
    for size in SIZES:
        n = len(codes) - size + 1
        if n < 1:
            continue
        out = np.full(n, size, np.uint64)
        bad = np.zeros(n, bool)
        for i in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + codes[i:i + n]
            if i < size - 1:
                bad |= pair[i:i + n]
        keep = np.flatnonzero(~bad)
        hashes.append(mix(out[keep]))
        at.append(keep)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64), np.zeros(len(texts))
    where = np.concatenate(at)
    text_of = np.searchsorted(ends, where, "right")
    order = np.argsort(text_of, kind="stable")
    offsets = np.searchsorted(text_of[order], np.arange(len(texts) + 1))
    return np.concatenate(hashes)[order], offsets, upto[ends] - upto[starts - 1]


def _groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    first, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= CHUNK_CHARS:
            yield first, texts[first:i + 1]
            first, chars = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


@dataclass
class Model:
    """One Bloom filter per language, side by side: bit ``l`` of an entry is language ``l``."""

    languages: list[str]
    table: np.ndarray  # unsigned numbers, length a power of two
    false_rates: np.ndarray  # chance that a filter returns an n-gram it does not hold
    common: int  # the language with most documents

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """Bitmask of all languages that hold each n-gram."""
        last = np.uint64(len(self.table) - 1)
        found = self.table[(hashes & last).astype(np.int64)]
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        for k in range(1, PROBES):
            found = found & self.table[((hashes + np.uint64(k) * step) & last).astype(np.int64)]
        return found

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and share of the n-grams that the language holds."""
        names, scores, shares = [], [], []
        for _, part in _groups(texts):
            hashes, offsets, letters = grams(part)
            masks = self.masks(hashes)
            n = np.diff(offsets)
            hits = np.zeros((len(self.languages), len(part)))
            for k in range(len(self.languages)):
                bits = ((masks >> masks.dtype.type(k)) & masks.dtype.type(1)).astype(np.int64)
                hits[k] = np.diff(np.concatenate(([0], np.cumsum(bits)))[offsets])
            # of n lookups, n * rate return a language by chance
            rate = self.false_rates[:, None]
            right = np.clip((hits - n * rate) / (1 - rate), 0, None)
            for i in range(len(part)):
                if not letters[i] or not self.languages:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    shares.append(0.0)
                    continue
                best = int(np.argmax(right[:, i]))
                first = right[best, i]
                if first <= 0:
                    best, second = self.common, 0.0
                else:
                    second = max((right[k, i] for k in range(len(right)) if k != best),
                                 default=0.0)
                names.append(self.languages[best])
                scores.append(float(first / (first + second)) if first > 0 else 0.0)
                shares.append(float(min(1.0, first / n[i])) if n[i] else 0.0)
        return names, scores, shares


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        texts = batch.column("text").to_pylist()
        for lang in sorted(set(langs)):
            own = [texts[i] for i in np.flatnonzero(langs == lang)]
            for _, part in _groups(own):
                found, n = np.unique(grams(part)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)),
                     pa.array(n.astype(np.int64))],
                    ["lang", "gram", "n"])


def fit(docs: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE,
        grams_per_language: int = GRAMS_PER_LANGUAGE, least_share: float = 0.125) -> Model:
    """Learn the languages of ``docs (doc_id, text, lang)``; null text or lang is left out.

    A language is learned from about ``sample_per_language`` documents, those with
    the smallest digests of their identifiers. An n-gram belongs to every language
    in which it is at least ``least_share`` times as frequent as where it is most
    frequent, so passages in another language do not spoil a filter. A filter holds
    the ``grams_per_language`` most frequent ones.
    """
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return Model([], np.zeros(1, np.uint8), np.zeros(0), 0)
    languages = sorted(counts)
    if len(languages) > 64:
        raise ValueError("at most 64 languages fit one bitmask")
    limits = F.create_map(*[x for k in languages for x in (
        F.lit(k), F.lit(min(1.0, sample_per_language / counts[k])))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rows = known.where(draw < limits[F.col("lang")]).select("text", "lang")
    found = materialize(
        rows.mapInArrow(_count_grams, "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    total = found.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = found.join(total, "lang").withColumn("rate", F.col("n") / F.col("total"))
    top = F.max("rate").over(Window.partitionBy("gram"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("rate"), "gram"))
    held = (rates.withColumn("top", top).where((F.col("rate") >= least_share * F.col("top"))
                                               & (F.col("n") > 1))
            .withColumn("rank", rank).where(F.col("rank") <= grams_per_language))
    chosen = held.select("lang", "gram").toArrow()  # at most grams_per_language each
    gram = chosen.column("gram").to_numpy().view(np.uint64)
    code = np.array([languages.index(x) for x in chosen.column("lang").to_pylist()], np.int64)
    most = int(np.bincount(code, minlength=1).max()) if len(code) else 0
    size = 1 << max(10, (16 * max(most, 1) - 1).bit_length())
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64)
                if np.dtype(k).itemsize * 8 >= len(languages))
    slices = np.zeros(size, kind)
    step = (gram >> np.uint64(32)) | np.uint64(1)
    for k in range(PROBES):
        at = ((gram + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64)
        np.bitwise_or.at(slices, at, (np.uint64(1) << code.astype(np.uint64)).astype(kind))
    fill = np.array([np.mean((slices >> kind(i)) & kind(1)) for i in range(len(languages))])
    return Model(languages, slices, fill ** PROBES,
                 languages.index(max(languages, key=lambda x: counts[x])))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``known_share`` to every row of ``docs``.

    Only ``text`` is looked at, all of it. ``lang_pred`` is a learned language, or
    ``und`` if the text is null or has no letter (score 0). ``score`` is the best
    language's corrected hits over those of the best two, 0 if no n-gram is known
    (then the most common language is named); equal languages go by name.
    ``known_share`` is the part of the n-grams that the language holds. The model
    that each task gets is bounded by its two parameters. Columns of ``docs`` may
    have any names but these three.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.StructType.fromDDL("lang_pred string, score double, known_share double"))
    def predict(texts: pd.Series) -> pd.DataFrame:
        named = shared.value.predict([t or "" for t in texts])
        return pd.DataFrame(dict(zip(("lang_pred", "score", "known_share"), named)))

    bound_batches(docs.sparkSession)
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(columns.alias("row"), predict("text").alias("found")).select(
        "row.*", "found.*")


def held_out(doc_id) -> F.Column:
    """One document in five, by the checksum of its identifier; null is empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0
