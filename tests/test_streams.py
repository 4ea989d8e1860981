"""Streams in several batches give what the whole table gives."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomwork.plans import lastwriter
from loomwork.streaming import feeds, progress, records, writes

COLS = ["key", "value", "counter", "identifier"]


def events(spark, n=300):
    return spark.range(n).select(
        (F.col("id") % 7).alias("key"), F.col("id").cast("string").alias("value"),
        ((F.col("id") * 37) % 23).alias("counter"), F.col("id").alias("identifier"),
        F.timestamp_seconds(F.col("id")).alias("ts"))


def feed(spark, tmp_path, files=5):
    folder = str(tmp_path / "in")
    events(spark).repartition(files).write.parquet(folder)
    return feeds.batch_feed(spark, folder, events(spark).schema)


def test_batches(spark, tmp_path):
    stream = feed(spark, tmp_path)
    out = str(tmp_path / "out")
    query = feeds.run_to_end(stream.select("key"), feeds.progress_sink(out))
    assert not query.isActive
    got = feeds.collected(spark, out, "records long").collect()
    assert len(got) == 5 and sum(r["records"] for r in got) == 300


def test_last_writer(spark, tmp_path):
    stream = feeds.last_writer_stream(feed(spark, tmp_path), *COLS)
    out = str(tmp_path / "out")
    feeds.run_to_end(stream, feeds.latest_by_key_sink(out), "update")
    got = feeds.current_of_updates(feeds.collected(spark, out, stream.schema), "key")
    whole = lastwriter.latest_versions(events(spark), *COLS)
    assert sorted(got.select(*COLS).collect()) == sorted(whole.select(*COLS).collect())


def test_distinct_and_max(spark, tmp_path):
    stream = feed(spark, tmp_path)
    out = str(tmp_path / "out")
    feeds.run_to_end(feeds.distinct_numbers(stream, "key"), feeds.append_sink(out))
    got = feeds.collected(spark, out, "key long").collect()
    assert sorted(r["key"] for r in got) == list(range(7))
    out = str(tmp_path / "max")
    feeds.run_to_end(feeds.running_max(stream, "identifier"), feeds.append_sink(out), "complete")
    last = feeds.collected(spark, out, "max_value long").orderBy(F.desc("batch")).first()
    assert last["max_value"] == 299


def test_distinct_with_bounded_state(spark, tmp_path):
    stream = feeds.distinct_numbers(feed(spark, tmp_path), "key", "ts", "1 hour")
    out = str(tmp_path / "out")
    feeds.run_to_end(stream, feeds.append_sink(out))
    got = feeds.collected(spark, out, stream.schema).collect()
    assert sorted(r["key"] for r in got) == list(range(7))


def test_restart_does_not_repeat(spark, tmp_path):
    stream = feed(spark, tmp_path)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for _ in range(2):
        feeds.run_to_end(stream.select("identifier"), feeds.append_sink(out), checkpoint=check)
    assert feeds.collected(spark, out, "identifier long").count() == 300


def three_files(spark, tmp_path, n=230):
    """Numbered records in files of differing sizes."""
    folder = tmp_path / "numbered"
    for i, (a, b) in enumerate([(0, 20), (20, 133), (133, n)]):
        spark.range(a, b).coalesce(1).write.option("parquet.block.size", 1024).parquet(
            str(folder / f"part={i}"))
    return str(folder)


@pytest.fixture()
def listened(spark, tmp_path):
    """Runs a stream of numbered records while one listener keeps its progress."""
    listener = progress.ProgressTable(spark, str(tmp_path / "out"))
    spark.streams.addListener(listener)

    def run(folder, sink):
        check = str(tmp_path / "check")
        feed = records.record_feed(spark, folder, check, 50, per_task=30)
        listener.wait(records.run_records(
            progress.observed(feed.select("id"), top=F.max("id")), sink, check))
        return {r.batch: (r.records, r.top) for r in progress.batches(spark, listener.path).collect()}

    yield run
    spark.streams.removeListener(listener)


REPORTED = {0: (50, 49), 1: (50, 99), 2: (50, 149), 3: (50, 199), 4: (30, 229)}


def test_batches_of_records(spark, tmp_path, listened):
    folder, seen = three_files(spark, tmp_path), {}

    def keep(batch, number):
        seen[number] = sorted(r.id for r in batch.collect())

    assert listened(folder, keep) == REPORTED
    assert seen == {n: list(range(50 * n, min(50 * n + 50, 230))) for n in range(5)}


def test_progress_of_many_short_batches(spark, tmp_path):
    folder, check = str(tmp_path / "in"), str(tmp_path / "check")
    spark.range(120).coalesce(1).write.parquet(folder)
    listener = progress.ProgressTable(spark, str(tmp_path / "out"))
    spark.streams.addListener(listener)
    try:
        feed = records.record_feed(spark, folder, check, 2)
        done = records.run_records(progress.observed(feed), lambda b, n: b.collect(), check)
        listener.wait(done, 3)  # a job for each of 60 batches took longer
    finally:
        spark.streams.removeListener(listener)
    got = {r.batch: r.records for r in progress.batches(spark, listener.path).collect()}
    assert got == dict.fromkeys(range(60), 2)


def test_a_batch_run_again_replaces_its_row(spark, tmp_path):
    path = str(tmp_path / "out")
    spark.createDataFrame([(0, 1, 5), (1, 2, 5), (1, 3, 4)], "batch long, nr long, records long"
                          ).write.parquet(path)
    assert {r.batch: r.records for r in progress.batches(spark, path).collect()} == {0: 5, 1: 4}


def test_state_in_as_many_partitions_as_cores(spark, tmp_path):
    folder, check, out = (str(tmp_path / n) for n in ("in", "check", "out"))
    spark.createDataFrame([(i, "v", 1, i, i) for i in range(9)],
                          "key long, value string, counter long, identifier int, arrival long"
                          ).coalesce(1).write.parquet(folder)
    before = spark.conf.get(records.PARTITIONS)
    spark.conf.set(records.PARTITIONS, "64")
    try:
        answers = writes.write_stream(records.record_feed(spark, folder, check, 9))
        query = records.run_records(answers, feeds.append_sink(out), check, "update")
        assert spark.conf.get(records.PARTITIONS) == "64"
    finally:
        spark.conf.set(records.PARTITIONS, before)
    assert feeds.collected(spark, out, answers.schema).count() == 9
    parts = query.recentProgress[0]["stateOperators"][0]["numShufflePartitions"]
    assert parts == spark.sparkContext.defaultParallelism


def test_records_within_a_row_group(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "PIECE", 16)
    folder, check, out = (str(tmp_path / n) for n in ("in", "check", "out"))
    spark.range(100).coalesce(1).write.parquet(folder)
    feed = records.record_feed(spark, folder, check, 45, per_task=30)
    records.run_records(feed, feeds.append_sink(out), check)
    got = feeds.collected(spark, out, feed.schema).collect()
    assert sorted((r.batch, r.id) for r in got) == [(i // 45, i) for i in range(100)]


def test_large_row_groups_are_cut(spark, tmp_path, monkeypatch):
    """Batches of a large row group read pieces of it; records and their order stay."""
    monkeypatch.setattr(records, "LARGE", 50, raising=False)
    monkeypatch.setattr(records, "PIECE", 16)
    folder, check, out = (str(tmp_path / n) for n in ("in", "check", "out"))
    ids, at = pa.array(range(300)), 0
    (tmp_path / "in").mkdir()
    for name, rows, group in (("a", 200, 200), ("b", 20, 20), ("c", 80, 60)):
        pq.write_table(pa.table({"id": ids.slice(at, rows), "other": ids.slice(at, rows)}),
                       f"{folder}/{name}.parquet", row_group_size=group)
        at += rows
    indexes = []
    plain = records._write
    monkeypatch.setattr(records, "_write", lambda path, text: (indexes.append(text), plain(path, text)))
    feed = records.record_feed(spark, folder, check, 45, per_task=30)
    records.run_records(feed, feeds.append_sink(out), check)
    got = feeds.collected(spark, out, feed.schema).collect()
    assert sorted((r.batch, r.id, r.other) for r in got) == [(i // 45, i, i) for i in range(300)]
    for name, _, rows in json.loads(indexes[0]):
        held = pq.ParquetFile(name.removeprefix("file:")).metadata
        assert held.num_rows == rows
        assert max(held.row_group(g).num_rows for g in range(held.num_row_groups)) <= 20


def test_columns_of_a_feed(spark, tmp_path):
    folder, check = str(tmp_path / "in"), str(tmp_path / "check")
    spark.range(10).selectExpr("id", "id + 1 AS other").coalesce(1).write.parquet(folder)
    assert records.record_feed(spark, folder, check, 5, columns=["other"]).columns == ["other"]


def test_batches_write_changes_of_the_state(spark, tmp_path):
    """Not whole states; and the settings of the session stay as they were."""
    folder, check, out = (str(tmp_path / n) for n in ("in", "check", "out"))
    spark.createDataFrame([(i % 3, "v", 1, i, i) for i in range(9)],
                          "key long, value string, counter long, identifier int, arrival long"
                          ).coalesce(1).write.parquet(folder)
    answers = writes.write_stream(records.record_feed(spark, folder, check, 3))
    before = {k: spark.conf.get(k, None) for k in (records.PARTITIONS, *records.LOCAL_FILES)}
    records.run_records(answers, feeds.append_sink(out), check, "update")
    assert {k: spark.conf.get(k, None) for k in before} == before
    assert list((tmp_path / "check" / "state").rglob("*.changelog"))


def test_records_go_on_after_a_failure(spark, tmp_path, listened):
    folder, seen = three_files(spark, tmp_path), {}

    def keep(batch, number, fail=True):
        if fail and number == 2:
            raise RuntimeError("lost")
        seen.setdefault(number, []).append(sorted(r.id for r in batch.collect()))

    with pytest.raises(Exception):
        listened(folder, keep)
    assert sorted(seen) == [0, 1]
    for _ in range(2):  # the second run has nothing left to do
        assert listened(folder, lambda b, n: keep(b, n, fail=False)) == REPORTED
    assert {n: len(v) for n, v in seen.items()} == {n: 1 for n in range(5)}
    assert sorted(x for v in seen.values() for x in v[0]) == list(range(230))


def plain_writes(rows):
    """{arrival: (accepted, stored version)} one write after another."""
    held, out = {}, {}
    for key, value, counter, identifier, arrival in sorted(rows, key=lambda r: r[4]):
        ok = key not in held or held[key][1:] < (counter, identifier)
        if ok:
            held[key] = (value, counter + 1, identifier)
        out[arrival] = (ok, *held[key])
    return out


@pytest.mark.parametrize("per_batch", [7, 60])
def test_write_stream(spark, tmp_path, per_batch):
    rows = [(i % 4 if i % 9 else None, None if i % 5 == 0 else f"v{i}", (i * 7) % 11, (i * 5) % 3, i)
            for i in range(60)]
    schema = "key long, value string, counter long, identifier int, arrival long"
    folder, check, out = (str(tmp_path / n) for n in ("in", "check", "out"))
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)
    answers = writes.write_stream(records.record_feed(spark, folder, check, per_batch))
    records.run_records(answers, feeds.append_sink(out), check, "update")
    got = feeds.collected(spark, out, answers.schema).collect()
    assert len({r.batch for r in got}) == -(-60 // per_batch)
    assert {r.arrival: (r.accepted, r.value, r.counter, r.identifier) for r in got} == plain_writes(rows)
    # the same as single writes applied to a table, one after another
    state = spark.createDataFrame([], "key long, value string, counter long, identifier int")
    few = [r for r in rows if r[0] == 1][:6]
    for r in few:
        write = spark.createDataFrame([r[:4]], state.schema)
        state = spark.createDataFrame(lastwriter.apply_writes(state, write).collect(), state.schema)
    assert [tuple(r) for r in state.collect()] == [(1, *plain_writes(few)[few[-1][4]][1:])]


def test_write_stream_forgets(spark, tmp_path):
    folder, check, out = (str(tmp_path / n) for n in ("in", "check", "out"))
    spark.createDataFrame([(1, "a", 5, 1, 0), (1, "b", 1, 1, 1), (2, "x", None, 1, 2)],
                          "key long, value string, counter long, identifier int, arrival long"
                          ).coalesce(1).write.parquet(folder)
    answers = writes.write_stream(records.record_feed(spark, folder, check, 1), ttl_ms=1)
    records.run_records(answers, feeds.append_sink(out), check, "update", timers=True)
    got = {r.arrival: r.accepted for r in feeds.collected(spark, out, answers.schema).collect()}
    assert got == {0: True, 1: True}  # the version was gone when the older write came
