"""Records of delimited files whose quoted fields hold line breaks, read in parallel.

A task sees a piece of a file from some line on, and cannot know whether it starts inside
quotes. So every piece first tells the parity of its quotes, and how many records begin in
it for either answer. Sums over the pieces before give the true state at each border, and
the second pass cuts records there. Only records that cross a border are put together by
a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.session import materialize


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """Every line with the piece of the file it is in; lines of a piece are in order."""
    if encoding.lower().replace("_", "-").startswith(("utf-16", "utf-32", "ucs")):
        raise ValueError(f"line breaks inside quotes need an encoding that keeps ASCII, not {encoding}")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), "value")
    if encoding.lower() in ("utf-8", "utf8"):
        return lines
    return lines.withColumn("value", F.decode(F.col("value").cast("binary"), encoding))


def _odd(values: pa.Array, quote: str, escape: str) -> np.ndarray:
    """Whether a line has an odd number of quotes that count."""
    if escape != quote:
        values = pc.replace_substring_regex(values, rf"(?s)\x{ord(escape):02x}.", "")
    return pc.count_substring(values, quote).to_numpy(zero_copy_only=False) % 2 == 1


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
    """Runs of lines of one piece: the piece, first and last row."""
    file, block = batch.column("file").to_numpy(zero_copy_only=False), batch.column("block").to_numpy()
    if not len(block):
        return
    border = np.flatnonzero((block[1:] != block[:-1]) | (file[1:] != file[:-1])) + 1
    for a, b in zip([0, *border.tolist()], [*border.tolist(), len(block)]):
        yield (file[a], int(block[a])), a, b


def _counter(quote: str, escape: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, state, begun = None, 0, [0, 0]

        def row():
            return pa.RecordBatch.from_pydict({
                "file": [piece[0]], "block": [piece[1]], "odd": [state],
                "outside": [begun[0]], "inside": [begun[1]]}, schema=pa.schema([
                    ("file", pa.string()), ("block", pa.int64()), ("odd", pa.int32()),
                    ("outside", pa.int64()), ("inside", pa.int64())]))

        for batch in batches:
            odd = _odd(batch.column("value"), quote, escape)
            for now, a, b in _pieces(batch):
                if now != piece:
                    if piece is not None:
                        yield row()
                    piece, state, begun = now, 0, [0, 0]
                after = (state + np.cumsum(odd[a:b])) % 2
                before = (after + odd[a:b]) % 2  # lines that begin where quotes are closed
                begun = [begun[0] + int((before == 0).sum()), begun[1] + int((before == 1).sum())]
                state = int(after[-1])
        if piece is not None:
            yield row()
    return count


_CUT = "file string, record long, block long, line long, value string, whole boolean"


def _cutter(quote: str, escape: str):
    """Records of each piece; whole ones, and the parts of those that cross its borders."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, inside, record, line, held, cut_off = None, False, 0, 0, [], False
        out: list = []

        def close(whole: bool) -> None:
            nonlocal held
            if held:
                out.append((*piece[:1], record, piece[1], line, "\n".join(held), whole))
            held = []

        for batch in batches:
            odd = _odd(batch.column("value"), quote, escape)
            for now, a, b in _pieces(batch):
                if now != piece:
                    close(whole=not inside and not cut_off)
                    piece, line = now, 0
                    inside = cut_off = bool(batch.column("state")[a].as_py())
                    record = batch.column("records")[a].as_py()
                values = batch.column("value").slice(a, b - a).to_pylist()
                for value, flips in zip(values, odd[a:b].tolist()):
                    if not inside:
                        close(whole=not cut_off)
                        cut_off, record = False, record + 1
                    line += 1
                    held.append(value)
                    inside ^= flips
                    if not inside:
                        close(whole=not cut_off)
                        cut_off = False
            if out:
                yield _batch(out)
                out = []
        # what is open at the end goes on in the next piece, or is cut by the end of the file
        close(whole=False)
        if out:
            yield _batch(out)
    return cut


def _batch(rows: list) -> pa.RecordBatch:
    names = ["file", "record", "block", "line", "value", "whole"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def read_records(spark: SparkSession, path: str, quote: str = '"', escape: str = "\\",
                 encoding: str = "UTF-8") -> DataFrame:
    """``file, record, value``: the records of all files, numbered from 1 in each.

    A line break between quotes belongs to the record. Quotes count unless escaped;
    doubled ones cancel out. Files are cut as Spark cuts text files, at lines; two reads
    of them, three if a record crosses a border. A quote that is never closed makes one
    record of the rest of the file, as it does for any reader.
    """
    lines = _lines(spark, path, encoding)
    counted = materialize(lines.mapInArrow(
        _counter(quote, escape), "file string, block long, odd int, outside long, inside long"),
        "pieces")
    # one row for each piece
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    state = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2
    begun = F.when(F.col("state") == 0, F.col("outside")).otherwise(F.col("inside"))
    starts = materialize(counted.withColumn("state", state).withColumn(
        "records", F.coalesce(F.sum(begun).over(before), F.lit(0))).select(
        "file", "block", "state", "records", ((F.col("state") + F.col("odd")) % 2 == 1).alias(
            "open")), "starts")
    # a row of about 150 bytes for each piece of a file, 128 MB by default: 100 MB for 100 TB
    cut = lines.join(F.broadcast(starts.drop("open")), ["file", "block"]).mapInArrow(
        _cutter(quote, escape), _CUT)
    whole = cut.where("whole").select("file", "record", "value")
    if starts.where("open").isEmpty():
        return whole
    parts = cut.where("NOT whole").groupBy("file", "record").agg(F.array_sort(F.collect_list(
        F.struct("block", "line", "value"))).alias("parts")).select(
        "file", "record", F.array_join("parts.value", "\n").alias("value"))
    return whole.unionByName(parts)
