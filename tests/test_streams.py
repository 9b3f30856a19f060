"""Streaming queries leave their rows in files, not on the driver."""

import datetime
from unittest import mock

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from inkspark.plans import stream_queries as S
from inkspark.streaming import incremental as I
from inkspark.streaming import queues as Q


@pytest.mark.parametrize("query", [S.stream_debounced_position, S.stream_dedup, S.stream_progress])
def test_rows_are_read_from_files(spark, query):
    assert query(spark, "/root/testdata/sf0.001").inputFiles()


def test_a_table_may_be_a_folder_of_files(spark, tmp_path):
    spark.createDataFrame([(c, t, "a b") for c in range(3) for t in range(4)], "conv_id long, turn long, text string").repartition(2).write.parquet(f"{tmp_path}/conversations.parquet")
    rows = S.stream_in_turn(spark, str(tmp_path)).collect()
    assert sorted((r.conv_id, r.turn, r.delivered_s) for r in rows) == [(c, t, 1 + max((c * 37 + u * 61) % 101 for u in range(t + 1))) for c in range(3) for t in range(4)]


@pytest.mark.parametrize("mode", ["complete", "append", "update"])
def test_several_batches(spark, tmp_path, mode):
    folder = str(tmp_path / "in")
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(folder)
    if mode == "update":
        rows = I.run_to_end(stream.groupBy((stream.id % 7).alias("k")).count(), mode, "several_update").groupBy("k").agg(F.max_by("count", "batch").alias("n"))
        assert sorted(tuple(r) for r in rows.collect()) == [(k, len(range(k, 30, 7))) for k in range(7)]
    elif mode == "complete":
        rows = I.run_to_end(stream.groupBy((stream.id % 7).alias("k")).count(), mode, "several_complete").collect()
        assert sorted(tuple(r) for r in rows) == [(k, len(range(k, 30, 7))) for k in range(7)]
    else:
        assert sorted(r.id for r in I.run_to_end(stream, mode, "several_append").collect()) == list(range(30))


def test_windows_over_several_batches_close_at_the_end(spark, tmp_path):
    folder = str(tmp_path / "in")
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).selectExpr("id AS event_id", "id % 2 AS user_id", "timestamp_seconds(id * 3600) AS ts").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("event_id long, user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
    events, end = I.with_ending(stream)
    rows = I.run_to_end(I.throttled(events, "user_id", "6 hours", "24 hours"), "append", "closing", ending=(events.schema, end)).where("user_id IS NOT NULL").collect()
    assert sorted((r.user_id, r.n) for r in rows) == sorted((u, 3) for u in (0, 1) for _ in range(5))


def _write(spark, folder, rows):
    spark.createDataFrame(rows, "k long, ts timestamp, seq long, kind string").coalesce(1).write.mode("append").parquet(folder)


def _at(seconds):
    return datetime.datetime.fromtimestamp(1_000_000 + seconds, datetime.timezone.utc)


def _run(spark, folder, processor, out, checkpoint, last):
    """One run from the checkpoint, as after a restart; the last one with the row that moves the watermark to the end."""
    stream = spark.readStream.schema("k long, ts timestamp, seq long, kind string").option("maxFilesPerTrigger", 1).parquet(folder)
    if last:
        _write(spark, folder, [(None, datetime.datetime(2200, 1, 1), None, None)])
    with Q.state_store(spark):
        rows = I.run_to_end(Q.in_order(stream, "k", processor, "100 seconds", out), "append", f"again_{last}", checkpoint=checkpoint)
        return [tuple(r)[1:] for r in rows.where("k >= 0").collect()]


@pytest.mark.parametrize(
    ("processor", "out", "rows", "want"),
    [
        (Q.Retired(), "job long, retired_us long", [[(5, 1, "first"), (50, 3, "speak")], [(20, 2, "finish"), (60, 4, "load")], [(139, 5, "finish"), (400, 6, "first")]], [(6, 430)]),
        (Q.Retired(), "job long, retired_us long", [[(5, 1, "first"), (50, 3, "speak")], [(36, 2, "finish"), (60, 4, "load")], [(141, 5, "finish"), (400, 6, "first")]], [(1, 35), (3, 140), (6, 430)]),
        (Q.Shared(10**9), "seq long, job long", [[(5, 1, "request"), (50, 3, "request")], [(20, 2, "fail"), (60, 4, "request")], [(70, 5, "fail"), (400, 6, "request")]], [(1, 1), (3, 3), (4, 3), (6, 6)]),
        (Q.InTurn(10**9), "seq long, at_us long", [[(5, 2, "r"), (50, 0, "r")], [(20, 1, "r"), (60, 4, "r")], [(70, 3, "r"), (90, 6, "r")]], [(0, 50), (1, 50), (2, 50), (3, 70), (4, 70)]),
    ],
)
def test_queues_go_on_after_a_restart(spark, tmp_path, processor, out, rows, want):
    """Rows of a key come out of order and in three batches; the query is stopped and started again between them."""
    folder, checkpoint, got = str(tmp_path / "in"), str(tmp_path / "checkpoint"), []
    for i, batch in enumerate(rows):
        _write(spark, folder, [(9, _at(s), seq, kind) for s, seq, kind in batch])
        got += _run(spark, folder, processor, out, checkpoint, last=i == 2)
    if want and want[0][1] > 30 or "at_us" in out:
        got = [(a, b // 1_000_000 - 1_000_000) for a, b in got]
    assert sorted(got) == want


def test_a_keys_rows_of_a_batch_are_one_call_of_the_state():
    """Each call of the state is a round trip between processes: they do not grow with a key's rows."""
    calls = mock.MagicMock()
    calls.getListState.return_value.get.return_value, calls.getValueState.return_value.get.return_value, calls.listTimers.return_value = [], None, []
    made, clock = Q.Shared(10), mock.Mock()
    made.columns, clock.getCurrentWatermarkInMs.return_value = ("k", "seq", "job"), 0
    made.init(calls)
    rows = [Row(ts_us=i * 1000, seq=i, kind="request") for i in range(500)]
    calls.reset_mock()
    assert not list(made.handleInputRows((1,), iter(rows), clock)) and len(calls.mock_calls) < 10
    assert made.waiting.appendList.call_args[0][0] == [(i * 1000, i, "request") for i in range(500)]


def test_what_a_key_remembers_is_bounded():
    shared, turn, retired = Q.Shared(10), Q.InTurn(10), Q.Retired(1)
    assert shared.overdue((7, 100), 111)[0] == Q.Shared.MEMO[1] and shared.overdue((7, 100), 110)[0] == (7, 100)
    assert turn.overdue((3, 100, [5]), 111)[0] == Q.InTurn.MEMO[1]
    assert retired.overdue(([(5, 1), (9, 2)],), 9) == (([(9, 2)],), [(1, 5)])
    assert [x.due(x.MEMO[1]) for x in (shared, turn, retired)] == [None] * 3
