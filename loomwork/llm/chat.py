"""Multi-party perspective rotation of conversations, native."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.steps import materialize

PART = 64  # turns of a rendered part
SPAN = 1024  # parts whose lengths are summed in one window
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _name(speaker) -> F.Column:
    """A speaker as the name of a user: letters, digits, ``_`` and ``-`` only."""
    return F.regexp_replace(speaker, "[^A-Za-z0-9_-]", "_")


def _numbered(said: DataFrame) -> DataFrame:
    """``position``: the number of each row within its conversation, from 0.

    One sort of all rows, so a long conversation is spread over many tasks; what
    stands in a task is numbered there, and begins after what stands in the tasks before.
    """
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "speaker", "content")]
    rows = materialize(
        said.withColumn("_tie", F.monotonically_increasing_id()).orderBy(*order, "_tie")
        .drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "turns")
    task = F.shiftright("_at", 33)
    pieces = rows.groupBy(F.col("conv_id").alias("_conv"), task.alias("_task")).agg(
        F.count("*").alias("_n"), F.min("_at").alias("_low"))
    before = Window.partitionBy("_conv").orderBy("_task").rowsBetween(
        Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return rows.join(pieces, F.col("conv_id").eqNullSafe(F.col("_conv")) & (
        task == F.col("_task"))).select(
        *said.columns, (F.col("_before") + F.col("_at") - F.col("_low")).alias("position"))


def rotate(turns: DataFrame, speaker: str = "role", system: str = "system") -> DataFrame:
    """Every turn as every participant of its conversation sees it.

    The speakers of a conversation other than ``system`` are its participants. For
    each of them the whole dialogue is rendered once with that speaker as
    ``assistant`` and all others as ``user`` with their name; system turns stay
    system turns. Only the participant's own turns are trained on; the mask covers
    their text and the closing mark, not the header.

    ``turns`` needs ``conv_id, turn, text`` and the ``speaker`` column; other columns
    are ignored, whatever their names. One row per turn and participant: ``conv_id,
    perspective, turn, position, chat_role, name, content, segment, train, mask_start,
    mask_end`` (code points within the segment, end exclusive; equal if nothing is
    trained on). Segments in order of ``position`` are the rendered dialogue: turns
    in order (null first), equal ones by speaker and text. No conversation is ever
    collected, so its length does not matter. A null or empty speaker is the
    participant ``unknown``; null text is empty; a conversation of system turns only
    has no participant and gives no rows; repeated rows all stay; null ``conv_id`` is
    a conversation like others; no rows give no rows.
    """
    said = _numbered(turns.select(
        "conv_id", "turn", F.coalesce("text", F.lit("")).alias("content"),
        F.when(F.coalesce(F.col(speaker).cast("string"), F.lit("")) == "", "unknown").otherwise(
            F.col(speaker).cast("string")).alias("speaker")))
    parts = (said.where(F.col("speaker") != system)
             .select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective"))
             .distinct())
    seen = said.join(parts, said["conv_id"].eqNullSafe(parts["_conv"])).drop("_conv")
    own = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("speaker") == system, "system").when(own, "assistant").otherwise("user")
    shown = seen.withColumn("chat_role", role).withColumn(
        "name", F.when(role == "user", _name(F.col("speaker"))))
    header = F.concat(F.lit(OPEN), "chat_role", F.coalesce(
        F.concat(F.lit(" name="), "name"), F.lit("")), F.lit("\n"))
    whole = shown.withColumn("_header", header).withColumn(
        "segment", F.concat("_header", "content", F.lit(CLOSE)))
    start = F.length("_header")
    return whole.select(
        "conv_id", "perspective", "turn", "position", "chat_role", "name", "content", "segment",
        own.alias("train"), start.alias("mask_start"),
        F.when(own, start + F.length("content") + len(CLOSE) - 1).otherwise(start)
        .alias("mask_end"))


def dialogues(rotated: DataFrame, turns_per_part: int = PART) -> DataFrame:
    """The rotated turns joined into texts of ``turns_per_part`` turns each.

    Returns ``conv_id, perspective, part, n_turns, offset, text, masks``. Parts in
    order, joined, are the dialogue; ``offset`` is where a part begins in it, and
    ``masks`` are the spans trained on, also in code points of the whole dialogue,
    end exclusive. Parts are cut by position, so equal or missing turn numbers do
    not make one larger, and a row holds ``turns_per_part`` texts at most.
    """
    part = F.floor(F.col("position") / turns_per_part)
    rows = F.array_sort(F.collect_list(
        F.struct("position", "segment", "mask_start", "mask_end")))
    joined = (rotated.groupBy("conv_id", "perspective", part.alias("part")).agg(rows.alias("rows"))
              .withColumns({"text": F.array_join("rows.segment", ""),
                            "size": F.aggregate("rows", F.lit(0).cast("long"),
                                                lambda n, r: n + F.length(r["segment"]))}))
    made = materialize(joined, "parts")

    # running lengths in two levels: whole spans of parts, then parts within their span
    key, span = ["conv_id", "perspective"], F.floor(F.col("part") / SPAN)
    earlier = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1)
    total = lambda w: F.coalesce(F.sum("size").over(w), F.lit(0))
    spans = made.groupBy(*key, span.alias("span")).agg(F.sum("size").alias("size")).select(
        F.col("conv_id").alias("_conv"), F.col("perspective").alias("_who"),
        F.col("span").alias("_span"), total(earlier(key, "span")).alias("_before"))
    within = made.select(*key, "part", "size", span.alias("span")).withColumn(
        "within", total(earlier([*key, "span"], "part")))
    offsets = within.join(spans, F.col("conv_id").eqNullSafe(F.col("_conv")) & (
        F.col("perspective") == F.col("_who")) & (F.col("span") == F.col("_span"))).select(
        F.col("conv_id").alias("_conv"), F.col("perspective").alias("_who"),
        F.col("part").alias("_part"), (F.col("_before") + F.col("within")).alias("offset"))
    placed = made.join(offsets, F.col("conv_id").eqNullSafe(F.col("_conv")) & (
        F.col("perspective") == F.col("_who")) & (F.col("part") == F.col("_part")))
    add = lambda done, r: F.struct(
        (done["at"] + F.length(r["segment"])).alias("at"),
        F.when(r["mask_end"] > r["mask_start"], F.concat(done["masks"], F.array(F.struct(
            (done["at"] + r["mask_start"]).alias("start"),
            (done["at"] + r["mask_end"]).alias("end"))))).otherwise(done["masks"]).alias("masks"))
    zero = F.struct(F.col("offset").alias("at"),
                    F.array().cast("array<struct<start:bigint,end:bigint>>").alias("masks"))
    return placed.select(*key, "part", F.size("rows").alias("n_turns"), "offset", "text",
                         F.aggregate("rows", zero, add)["masks"].alias("masks"))
