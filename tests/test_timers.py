"""Timers of streams, by the watermark as a clock that the test moves, and by the real one."""

from __future__ import annotations

import datetime as dt
import time

from docflow.streaming import assembly, timers

START = dt.datetime(2026, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def run(spark, make, parts, path, mode):
    """Each part of the input in a run of its own: the stream goes on from its checkpoint."""
    out = []

    def keep(df, _):
        out.extend(tuple(r) for r in df.collect())

    for rows in parts:
        spark.createDataFrame(rows, "worker string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{path}/in")
        with assembly.with_state(spark):
            q = make(spark.readStream.schema("worker string, ts timestamp").parquet(f"{path}/in")).writeStream.foreachBatch(keep).outputMode(mode)
            q.option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    return out


def test_batches_by_the_watermark(spark, tmp_path):
    parts = [[("a", at(0)), ("a", at(20)), ("b", at(5))], [("a", at(45)), ("c", at(46))], [("c", at(100))], [("c", at(400))]]
    got = run(spark, lambda s: timers.work_batches(s, time="EventTime"), parts, str(tmp_path), "append")
    assert sorted(got) == [("a", at(0), at(45), 3), ("b", at(5), at(5), 1), ("c", at(46), at(46), 1), ("c", at(100), at(100), 1)]


def test_beats_by_the_watermark(spark, tmp_path):
    parts = [[("a", at(0)), ("a", at(2))], [("a", at(4))], [("a", at(6)), ("a", at(7))], [("z", at(30))], [("a", at(31)), ("z", at(60))]]
    got = [r for r in run(spark, lambda s: timers.heartbeats(s, time="EventTime"), parts, str(tmp_path), "append") if r[0] == "a"]
    # the timer of second 5 goes off once the watermark is there, with the last sign that has come by then; that of second 10 finds none
    assert got == [("a", at(0), 1), ("a", at(7), 2), ("a", at(31), 3)]


def test_silence_of_the_real_clock(spark, tmp_path):
    """Nothing is taken up while arrivals come; some time after the last one, all of them are."""
    out = []
    spark.createDataFrame([("a", at(0)), ("a", at(900))], "worker string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    with assembly.with_state(spark):
        q = timers.work_batches(spark.readStream.schema("worker string, ts timestamp").parquet(f"{tmp_path}/in"), idle=1000).writeStream.foreachBatch(lambda df, _: out.extend(tuple(r) for r in df.collect())).outputMode("update")
        q = q.option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="1 second").start()
    try:
        end = time.time() + 90
        while not out and time.time() < end:
            time.sleep(0.5)
    finally:
        q.stop()
    assert out == [("a", at(0), at(900), 2)]
