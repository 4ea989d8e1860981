"""A table as a stream of batches bounded by records.

Offsets are numbers of records in the order of the files' names, so a batch holds so many
records whatever the files hold, and a batch that is run again holds the same ones. The
reader on the driver knows one row per file; tasks read their ranges of row groups.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from loomwork.session import scratch_path

FORMAT = "loomwork_records"
PARTITIONS = "spark.sql.shuffle.partitions"
RECORDS_PER_BATCH = 50
RECORDS_PER_TASK = 100_000
PIECE = 1 << 14  # records decoded at once
LARGE = 1 << 16  # records of a row group that is cut into such pieces before the stream begins
LOCAL_FILES = {  # plain renames; the default starts a process or two for every file it writes
    "spark.sql.streaming.checkpointFileManagerClass":
        "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager",
}


def _source():
    """The source's class; made here so that workers need not import this package."""
    from pyarrow import fs as pafs

    class Part(InputPartition):
        def __init__(self, file: str, first: int, rows: int):
            self.file, self.first, self.rows = file, first, rows

    class Reader(DataSourceStreamReader):
        def __init__(self, options, schema):
            self.names = schema.names
            self.bound = int(options["records"])
            self.per_task = int(options["pertask"])
            self.mark = options["mark"]
            fs, root = pafs.FileSystem.from_uri(options["index"])
            with fs.open_input_stream(root) as f:
                self.files = json.loads(f.read())  # [name, records before it, records]
            self.total = sum(f[2] for f in self.files)
            self.planned = self._last_planned()

        def _last_planned(self) -> int:
            fs, root = pafs.FileSystem.from_uri(self.mark)
            if fs.get_file_info(root).type == pafs.FileType.NotFound:
                return 0
            with fs.open_input_stream(root) as f:
                return int(f.read())

        def initialOffset(self):
            return {"records": 0}

        def latestOffset(self):
            # as far beyond the last planned batch as one batch may go; its end, at the end
            return {"records": min(self.planned + self.bound, self.total)}

        def partitions(self, start, end):
            a, b = start["records"], end["records"]
            if b > self.planned:  # kept beside the checkpoint, for the next start
                self.planned = b
                fs, root = pafs.FileSystem.from_uri(self.mark)
                with fs.open_output_stream(root) as f:
                    f.write(str(b).encode())
            parts = []
            for name, before, rows in self.files:
                first, last = max(a, before), min(b, before + rows)
                for at in range(first, last, self.per_task):
                    parts.append(Part(name, at - before, min(self.per_task, last - at)))
            return parts

        def read(self, partition):
            import gc

            import pyarrow.parquet as pq

            if not gc.get_freeze_count():
                gc.freeze()  # a worker looks for garbage after each task, in all modules otherwise
            fs, root = pafs.FileSystem.from_uri(partition.file)
            file = pq.ParquetFile(root, filesystem=fs)
            first, left = partition.first, partition.rows
            for group in range(file.num_row_groups):
                rows = file.metadata.row_group(group).num_rows
                if first >= rows:
                    first -= rows
                    continue
                if left <= 0:
                    return
                # piece by piece, as the rest of a row group is for other batches
                for piece in file.iter_batches(PIECE, [group], self.names):
                    wanted = piece.select(self.names).slice(first, left)
                    first = max(0, first - piece.num_rows)
                    left -= wanted.num_rows
                    if wanted.num_rows:
                        yield wanted
                    if left <= 0:
                        return

    class Records(DataSource):
        @classmethod
        def name(cls):
            return FORMAT

        def streamReader(self, schema):
            return Reader(self.options, schema)

    return Records


def record_feed(spark: SparkSession, folder: str, checkpoint: str,
                per_batch: int = RECORDS_PER_BATCH, per_task: int = RECORDS_PER_TASK,
                columns: list[str] | None = None) -> DataFrame:
    """Parquet files as a stream of at most ``per_batch`` records a batch.

    Records come in the order of the files' names. The files are those found now; after
    a restart with the same ``checkpoint`` folder the stream goes on where it stopped,
    so the files must be the same ones then. Columns are those inside the files, not those of
    folder names, or those of them in ``columns``. Needs files that ``pyarrow.fs`` can open.

    A batch reads a row group from its beginning, so files with row groups of over ``LARGE``
    records are first copied to the shared folder, in row groups of ``PIECE`` records.
    """
    if per_batch < 1 or per_task < 1:
        raise ValueError("a batch and a task hold one record at least")
    table = spark.read.option("recursiveFileLookup", "true").parquet(folder)
    if columns is not None:
        table = table.select(*columns)
    before = F.sum("rows").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    files = table.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count("*").alias("rows")).select("file", F.coalesce(before, F.lit(0)).alias("before"), "rows")
    index = f"{scratch_path(spark, 'feed')}.json"
    listed = [[r.file, r.before, r.rows] for r in files.orderBy("file").collect()]  # one per file
    _write(index, json.dumps(_cut(spark, listed, table.columns)))
    spark.dataSource.register(_source())
    return (spark.readStream.format(FORMAT).schema(table.schema).option("records", per_batch)
            .option("pertask", per_task).option("index", index)
            .option("mark", f"{checkpoint.rstrip('/')}/planned").load())


def _cut(spark: SparkSession, listed: list[list], names: list[str]) -> list[list]:
    """The same records in the same order, a file for each row group where one is large."""
    most, piece = LARGE, PIECE
    large = [(n, file) for n, (file, _, rows) in enumerate(listed) if rows > most]
    if not large:
        return listed
    folder = scratch_path(spark, "cut")

    def groups(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs as pafs

        for batch in batches:
            for n, file in zip(*(c.to_pylist() for c in batch.columns)):
                fs, root = pafs.FileSystem.from_uri(file)
                held = pq.ParquetFile(root, filesystem=fs).metadata
                rows = [held.row_group(g).num_rows for g in range(held.num_row_groups)]
                if max(rows) > most:
                    yield pa.RecordBatch.from_pylist(
                        [{"n": n, "file": file, "nr": g, "rows": r} for g, r in enumerate(rows)])

    def copied(batches):
        import uuid

        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs as pafs

        for batch in batches:
            for row in batch.to_pylist():
                fs, root = pafs.FileSystem.from_uri(row["file"])
                file = pq.ParquetFile(root, filesystem=fs)
                # a name of its own for every attempt; what no task returned is not read
                name = f"{folder}/{row['n']}-{row['nr']}-{uuid.uuid4().hex}.parquet"
                to, at = pafs.FileSystem.from_uri(name)
                to.create_dir(at.rsplit("/", 1)[0], recursive=True)
                pieces = file.iter_batches(piece, [row["nr"]], names)
                first = next(pieces, None)
                if first is None:
                    continue
                with pq.ParquetWriter(at, first.schema, filesystem=to) as out:
                    out.write_batch(first)
                    for more in pieces:
                        out.write_batch(more)
                yield pa.RecordBatch.from_pylist(
                    [{"n": row["n"], "file": name, "nr": row["nr"], "rows": row["rows"]}])

    kind = "n long, file string, nr long, rows long"
    tasks = spark.createDataFrame(large, "n long, file string").repartition(len(large)).mapInArrow(
        groups, kind).collect()  # one for each row group
    if not tasks:
        return listed
    parts: dict[int, list] = {}
    todo = spark.createDataFrame(tasks, kind).repartitionByRange(len(tasks), "n", "nr")
    for r in todo.mapInArrow(copied, kind).collect():
        parts.setdefault(r.n, []).append((r.nr, r.file, r.rows))
    out, before = [], 0
    for n, (file, _, rows) in enumerate(listed):
        for _, name, size in sorted(parts[n]) if n in parts else [(0, file, rows)]:
            out.append([name, before, size])
            before += size
    return out


def _write(path: str, text: str) -> None:
    from pyarrow import fs as pafs

    fs, root = pafs.FileSystem.from_uri(path)
    fs.create_dir(root.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(root) as f:
        f.write(text.encode())


def run_records(stream: DataFrame, sink: Callable[[DataFrame, int], None] | str,
                checkpoint: str, mode: str = "append", timers: bool = False) -> StreamingQuery:
    """Feed batch after batch to ``sink(batch, batch_id)`` up to the last record, then stop.

    ``sink`` may also be the name of a format that needs no options.

    The source has nothing beyond what was planned, so that no more data is the end. A
    stream with ``timers`` goes on without data: its first empty batch is the end.

    State is kept in as many partitions as there are cores, or fewer if the session has
    fewer: every batch opens and commits all of them, however few records it has. A
    checkpoint keeps the number it began with.
    """
    from pyarrow import fs as pafs

    fs, root = pafs.FileSystem.from_uri(checkpoint)
    fs.create_dir(root, recursive=True)
    spark = stream.sparkSession
    wanted = {PARTITIONS: str(min(int(spark.conf.get(PARTITIONS)),
                                  spark.sparkContext.defaultParallelism))}
    if fs.type_name == "local" and all(spark.conf.get(k, None) is None for k in LOCAL_FILES):
        wanted |= LOCAL_FILES
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:  # a stream has a copy of the settings at its start
        writer = stream.writeStream.outputMode(mode)
        writer = writer.format(sink) if isinstance(sink, str) else writer.foreachBatch(sink)
        query = (writer.option("checkpointLocation", checkpoint)
                 .trigger(processingTime="0 seconds").start())
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    try:
        if not timers:
            query.processAllAvailable()
        while timers and not any(p["numInputRows"] == 0 for p in query.recentProgress):
            if query.awaitTermination(0.1):  # raises what stopped it
                break
    finally:
        query.stop()
    return query
