"""Mix sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.steps import materialize

BUCKETS = 4096


def word_count(text) -> F.Column:
    """Number of runs of characters other than ASCII spaces; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cycle: int = 3, most: int = 3) -> DataFrame:
    """Target words per source from ``(source, source_size)``, one row per source.

    Sources in code point order, null last, weigh 1 to ``cycle``, repeating. All
    sizes together are the budget; a target stops at ``most`` times its source's
    size and what is above is shared again by weight. That is filling to one level:
    sources in order of cap by weight stop one after another, and the level follows
    from the sums before and after. Works on one row per source.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    fills = Window.orderBy("reach", "rank")
    before = fills.rowsBetween(Window.unboundedPreceding, -1)
    rest = fills.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    weighed = (
        sizes.withColumn("rank", F.row_number().over(ordered))
        .withColumn("weight", (F.col("rank") - 1) % cycle + 1)
        .withColumn("cap", F.lit(most) * F.col("source_size"))
        .withColumn("reach", F.col("cap") / F.col("weight")))
    levels = (
        weighed.withColumn("budget", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(rest))
        .withColumn("left", F.col("budget") - F.col("full")))
    # a source is open if an equal share by weight of what is left stays within its cap
    is_open = F.col("weight") * F.col("left") <= F.col("cap") * F.col("open")
    first = F.min(F.when(is_open, F.struct("reach", "rank", "left", "open"))).over(
        Window.partitionBy())
    share = F.col("weight") * F.col("first.left") / F.col("first.open")
    return levels.withColumn("first", first).select(
        "source", "rank", "source_size", "budget",
        F.when(F.col("first").isNull()
               | (F.struct("reach", "rank") < F.struct("first.reach", "first.rank")),
               F.col("cap").cast("double")).otherwise(share).alias("target"))


def _running(rows: DataFrame, group: list[str], bucket: str, order: list[str],
             value: str, out: str) -> DataFrame:
    """Running sum of ``value`` per group in ``order``, in two levels.

    ``bucket`` is ordered like ``order``: sums per bucket give every bucket its
    start, so no task holds more than one bucket of a group.
    """
    sums = rows.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    upto = Window.partitionBy(*group).orderBy(bucket).rowsBetween(
        Window.unboundedPreceding, -1)
    starts = sums.select(*group, bucket, F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias(
        "_start"))
    inner = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0)
    return rows.join(starts, [*group, bucket]).withColumn(
        out, F.col("_start") + F.sum(value).over(inner)).drop("_start")


def mix_sources(docs: DataFrame, cycle: int = 3, most: int = 3) -> DataFrame:
    """How many words of every document the mix takes.

    Documents of a source stand in a shuffled queue (by a digest of identifier and
    text), repeated up to ``most`` times. A document's virtual finish time is the
    queue's words up to and including it, divided by the source's target. All
    queues together are ordered by finish time, and the mix ends with the last
    document that keeps the words so far within the budget, which is the number of
    words of all documents. The end is found by narrowing finish times twice to one
    of 4096 ranges and ordering only the last range.

    ``docs`` needs ``doc_id``, ``text``, ``source``; other columns are ignored.
    Returns one row per row: ``doc_id, source, size, source_size, target, copies,
    taken, digest``. Null or empty text has size 0 and takes nothing; a null source
    is a source of its own, the last one; a null ``doc_id`` is like an empty one;
    rows that repeat identifier and text share a place in the queue one after
    another; no rows give no rows.
    """
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"),
                            F.md5(F.coalesce(F.col("text"), F.lit("")))))
    rows = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                                   digest.alias("digest")), "mix-sizes")
    targets = materialize(source_targets(
        rows.groupBy("source").agg(F.sum("size").alias("source_size")), cycle, most),
        "mix-targets")
    ranked = rows.join(
        targets.select("source", "rank", "source_size", "target", "budget"),
        rows["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    placed = ranked.withColumn("bucket", F.conv(F.substring("digest", 1, 3), 16, 10).cast("int"))
    queued = materialize(_running(placed, ["rank"], "bucket", ["digest", "doc_id"], "size", "upto")
                         .drop("bucket"), "mix-queue")

    live = queued.where("size > 0 AND target > 0")
    times = [((F.lit(e) * F.col("source_size") + F.col("upto")) / F.col("target"))
             for e in range(most)]
    copies = live.select("rank", "digest", "doc_id", "size", "budget", F.posexplode(
        F.array(*times)).alias("epoch", "finish"))
    # narrow twice to the range in which the budget ends
    low, width = F.lit(0.0), most * 4.0 / BUCKETS
    ends = copies.withColumn("_before", F.lit(0).cast("long"))
    for _ in range(2):
        ends = ends.withColumn("range", F.floor((F.col("finish") - low) / width))
        sums = ends.groupBy("range").agg(
            F.sum("size").alias("_sum"), F.max("budget").alias("budget"),
            F.max("_before").alias("_before"))
        upto = F.col("_before") + F.sum("_sum").over(Window.orderBy("range"))
        cut = sums.select("range", (upto - F.col("_sum")).alias("_start"), upto.alias("_end"),
                          "budget").where("_end > budget").orderBy("range").limit(1)
        found = cut.first()  # one row at most: range and words before it
        if found is None:
            break
        ends = ends.where(F.col("range") == found["range"]).withColumn(
            "_before", F.lit(found["_start"]))
        low, width = low + F.lit(width) * F.lit(found["range"]), width / BUCKETS
    order = ["finish", "rank", "digest", "doc_id", "epoch"]
    if live.isEmpty() or found is None:
        last = None
    else:
        run = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        last = (ends.withColumn("_upto", F.col("_before") + F.sum("size").over(run))
                .where(F.col("_upto") > F.col("budget")).orderBy(*order).limit(1).first())
    if last is None:
        taken = F.lit(most)  # the budget covers every copy
    else:
        bound = F.struct(F.lit(last["finish"]), F.lit(last["rank"]), F.lit(last["digest"]))
        taken = sum(
            (F.when(F.struct(t, F.col("rank"), F.col("digest")) < bound, 1).otherwise(0)
             for t in times), F.lit(0))
    counted = F.when((F.col("size") > 0) & (F.col("target") > 0), taken).otherwise(0)
    return queued.select(
        "doc_id", "source", "size", "source_size", "target", counted.cast("long").alias("copies"),
        (F.col("size") * counted).cast("long").alias("taken"), "digest")
