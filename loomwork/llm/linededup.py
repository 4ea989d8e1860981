"""Delete repeated runs of lines with a suffix array over line identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.steps import materialize

COUNTS = ("n_lines", "n_removed", "longest_run")
_LINE = "struct<at:int,h1:bigint,h2:bigint>"


def _keyed(docs: DataFrame) -> DataFrame:
    """A document is its identifier and the hash of its text."""
    return docs.withColumn("_th", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))


def _lines(text) -> F.Column:
    """The lines that are not blank: number, 128 bits of hash; ends trimmed."""
    every = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n"),
        lambda x, i: F.struct(i.alias("at"), F.btrim(x, F.lit(" \t\r")).alias("line")))
    return F.transform(
        F.filter(every, lambda x: x["line"] != ""),
        lambda x: F.struct(
            x["at"].alias("at"), F.xxhash64(x["line"]).alias("h1"),
            F.xxhash64(F.lit(7), x["line"], F.lit(7)).alias("h2")))


def _ranks(groups: DataFrame, *order: str) -> DataFrame:
    """Number rows in order; numbers grow with the order but leave gaps."""
    return groups.orderBy(*order).withColumn("rank_", F.monotonically_increasing_id())


def _double(level: DataFrame, length: int) -> DataFrame:
    """Ranks of the runs of ``2 * length`` lines from those of ``length``.

    Runs that occur once drop out. Only one row per distinct pair of ranks is
    sorted, so a run that occurs very often costs one row there.
    """
    pairs = level.join(level.select((F.col("g") - length).alias("g"),
                                    F.col("rank").alias("rank2")), "g")
    groups = pairs.groupBy("rank", "rank2").agg(F.count("*").alias("n")).where("n > 1")
    ranked = _ranks(groups.select("rank", "rank2"), "rank", "rank2")
    return materialize(pairs.join(ranked, ["rank", "rank2"]).select(
        "g", F.col("rank_").alias("rank")), "ranks")


def _earlier(levels: list[DataFrame]) -> DataFrame:
    """``(g, lines, first)``: the longest run at ``g`` that also begins before ``g``.

    Suffixes that share a prefix are an interval of the suffix array. From the
    longest power of two down, intervals are split by the ranks of the next lines:
    all but the first suffix of a part follow it into the longer prefix; the first
    one stays to be compared by less, and leaves a mark in the part it heads.
    """
    state = levels[0].select(
        F.lit(-1).cast("long").alias("first"), F.lit(0).cast("long").alias("lines"), "g",
        F.lit(False).alias("mark"))
    for k in reversed(range(len(levels))):
        step = 1 << k
        ranks = levels[k].select(F.col("g").alias("_at"), F.col("rank").alias("next"))
        looked = state.join(ranks, F.col("g") + F.col("lines") == F.col("_at"), "left").drop("_at")
        # where no repeated run goes on, a number of its own keeps rows apart in the join
        looked = looked.withColumn("next", F.coalesce("next", -1 - F.col("g")))
        parts = (looked.where("next >= 0").groupBy("first", "lines", "next")
                 .agg(F.min("g").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n"))
        longer = (F.col("lines") + step).alias("lines")
        stay = F.struct("first", "lines", "g", "mark")
        go = F.struct(F.col("low").alias("first"), longer, "g", "mark")
        head = F.struct(F.col("low").alias("first"), longer, "g", F.lit(True).alias("mark"))
        kept = (F.when(F.col("g") > F.col("low"), F.array(go))
                .when(F.col("g") == F.col("low"), F.array(stay, head)).otherwise(F.array(stay)))
        state = materialize(
            looked.join(parts, ["first", "lines", "next"], "left")
            .select(F.explode(kept).alias("s")).select("s.*"), "intervals")
    return state.where("NOT mark AND lines > 0").select("g", "lines", "first")


def repeated_runs(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Copies of whole documents, lines to delete from others, and repeated rows.

    The first table is ``(doc_id, _th, longest)`` of documents whose lines, all of
    them, are those of an earlier document; the second ``(doc_id, _th, removed,
    longest)`` with the numbers of the lines, from 0, that later copies of repeated
    runs hold, and the lines of the longest such run; the third ``(doc_id, _th)`` of
    rows with lines that repeat another row's identifier and text.
    """
    base = materialize(
        _keyed(docs.select("doc_id", "text")).select("doc_id", "_th", _lines(F.col("text")).alias(
            "lines")).withColumns({
                "n": F.size("lines"), "s1": F.xxhash64(F.col("lines.h1")),
                "s2": F.xxhash64(F.col("lines.h2"))}).where("n > 0"), "lines")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_th")
    heads = base.groupBy("s1", "s2", "n").agg(F.min(key).alias("head"))
    joined = base.join(heads, ["s1", "s2", "n"])
    copies = joined.where(key != F.col("head")).select(
        "doc_id", "_th", F.col("n").cast("long").alias("longest")).distinct()
    repeats = materialize(base.groupBy("doc_id", "_th").agg(F.count("*").alias("n")).where("n > 1")
                          .select("doc_id", "_th"), "repeats")
    order = [F.col("doc_id").asc_nulls_last(), F.col("_th")]
    # one more line of no identifier ends every document
    ended = F.concat("lines", F.array(F.lit(None).cast(_LINE)))
    text = materialize(
        joined.where(key == F.col("head")).dropDuplicates(["doc_id", "_th"])
        .select("doc_id", "_th", ended.alias("lines")).orderBy(*order)
        .select("doc_id", "_th", F.posexplode("lines").alias("pos", "line"))
        .select("doc_id", "_th", "line.*")
        .withColumn("g", F.monotonically_increasing_id()), "positions")

    names = text.where("at IS NOT NULL").groupBy("h1", "h2").agg(F.count("*").alias("n")).where(
        "n > 1")
    ranked = _ranks(names.select("h1", "h2"), "h1", "h2")
    repeated = materialize(
        text.where("at IS NOT NULL").join(ranked, ["h1", "h2"])
        .select("g", "at", "doc_id", "_th", F.col("rank_").alias("rank")), "repeated")
    levels = [repeated.select("g", "rank")]
    while not levels[-1].isEmpty():
        levels.append(_double(levels[-1], 1 << (len(levels) - 1)))
    runs = _earlier(levels[:-1]) if len(levels) > 1 else repeated.select(
        "g", F.lit(0).cast("long").alias("lines"), F.col("g").alias("first")).where("lines > 0")
    # every line of a later copy begins the rest of that copy, so all of them are here
    removed = (repeated.join(runs, "g").groupBy("doc_id", "_th")
               .agg(F.array_sort(F.collect_list("at")).alias("removed"),
                    F.max("lines").alias("longest")))
    return copies, removed, repeats


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Delete every later copy of a run of lines that occurs more than once.

    Lines are compared without blanks at their ends; blank lines are no part of
    runs. Documents stand in order of ``doc_id`` (null last), then of the hash of
    their text. A run at some line is deleted if the same lines in a row begin
    anywhere earlier, also in the same document, whatever its length; so the first
    copy of everything stays.

    Documents with the same lines as an earlier one are deleted whole before
    anything else: every run in them is in the first one too. All other lines in
    order are one text. Runs of 1, 2, 4, … lines get ranks from pairs of ranks of
    half the length, which sorts the suffixes by ever longer prefixes; what is
    unique drops out. Going down again gives each suffix the longest prefix that it
    shares with an earlier one.

    ``docs`` needs ``doc_id, text``. Returns all rows and columns, ``text`` without
    the deleted lines, and the longs ``n_lines`` (not blank), ``n_removed``,
    ``longest_run`` (lines of the longest run deleted that is repeated as a whole; 0
    if none). A text that is left without lines is empty; texts that lose nothing
    stay as they are, also null and empty ones. Of rows with lines that repeat
    identifier (or its absence) and text, one is kept or cut as one document, the
    others are copies of it. No rows give no rows. Other columns may have any name;
    those named as a result give way to it.
    """
    copies, removed, repeats = repeated_runs(docs)
    none = F.lit(None).cast("array<int>")
    plan = copies.select("doc_id", "_th", F.lit(True).alias("whole"), none.alias("removed"),
                         "longest").unionByName(removed.select(
                             "doc_id", "_th", F.lit(False).alias("whole"), "removed", "longest"))
    # names of the caller stay within a struct
    others = [c for c in docs.columns if c not in ("text", *COUNTS)]
    rows = _keyed(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in others])
                              .alias("others"))).withColumn("again", F.lit(False))
    on = lambda side: (F.col("doc_id").eqNullSafe(side["id"])
                       & (F.col("_th") == side["h"]))
    named = lambda side: side.withColumnsRenamed({"doc_id": "id", "_th": "h"})
    if not repeats.isEmpty():
        twice = named(repeats)
        many = materialize(rows.join(twice, on(twice), "left_semi").withColumn(
            "row", F.monotonically_increasing_id()), "repeated-rows")
        kept = named(many.groupBy("doc_id", "_th").agg(F.min("row").alias("kept")))
        again = many.join(kept, on(kept)).withColumn("again", F.col("row") != F.col("kept"))
        rows = rows.join(twice, on(twice), "left_anti").unionByName(
            again.select(*rows.columns))
    side = named(plan)
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"),
                        lambda x: F.btrim(x, F.lit(" \t\r")) != "")).cast("long")
    both = rows.join(side, on(side), "left").withColumn("n", n)
    whole = F.col("again") | F.coalesce("whole", F.lit(False))
    counted = both.withColumn("cut", F.when(whole, F.col("n")).otherwise(
        F.coalesce(F.size("removed"), F.lit(0)).cast("long"))).withColumn(
        "longest", F.when(F.col("again"), F.col("n")).otherwise(F.coalesce("longest", F.lit(0))))
    lines = F.split("text", "\n")
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "removed"),
                       lambda i: F.get(lines, i))
    text = (F.when(F.col("cut") == 0, F.col("text"))
            .when(F.col("cut") == F.col("n"), F.lit("")).otherwise(F.array_join(left, "\n")))
    return counted.select(
        *[text.alias("text") if c == "text" else F.col("others").getField(c).alias(c)
          for c in docs.columns if c not in COUNTS],
        *[F.col(c).alias(name) for c, name in zip(("n", "cut", "longest"), COUNTS)])
