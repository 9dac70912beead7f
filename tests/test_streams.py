"""Streams that meet lateness: several files, one to a batch, in order of time."""

import os

import pytest

from pyspark.sql import functions as F
from tremorlens.streaming import jobs

SCHEMA = "ts timestamp, kind string"


@pytest.fixture
def arrivals(spark, tmp_path):
    """Writes batches as files with rising times and reads them as a stream, one file to a batch."""

    def build(batches, schema=SCHEMA, convert=True):
        folder = tmp_path / "in"
        folder.mkdir()
        for k, rows in enumerate(batches):
            df = spark.createDataFrame(rows, schema.replace("ts timestamp", "ts string") if convert else schema)
            if convert:
                df = df.withColumn("ts", F.to_timestamp("ts"))
            df.coalesce(1).write.parquet(str(tmp_path / f"batch{k}"))
            part = next((tmp_path / f"batch{k}").glob("part-*.parquet"))
            target = folder / f"{k}.parquet"
            part.rename(target)
            os.utime(target, (1_700_000_000 + k, 1_700_000_000 + k))
        return jobs.file_stream(spark, schema, str(folder), files=1)

    return build


def test_late_rows_count_until_the_watermark_and_not_after(arrivals, tmp_path):
    """Two days are waited for; what comes later changes nothing."""
    stream = arrivals([
        [("2026-08-01 10:00:00", "a"), ("2026-08-02 09:00:00", "a")],
        [("2026-08-01 11:00:00", "a"), ("2026-08-03 08:00:00", "a")],  # in time: the first day is open
        [("2026-08-06 08:00:00", "a")],  # closes the first days
        [("2026-08-06 09:00:00", "a")],  # the watermark of one batch holds for the rows of the next but one
        [("2026-08-01 12:00:00", "a"), ("2026-08-12 08:00:00", "b")],  # too late
        [("2026-08-13 08:00:00", "b")],
    ])
    got = jobs.run_once(jobs.daily_counts(stream, "ts", ["kind"]), str(tmp_path / "out"))
    assert sorted((str(r["day"]), r["kind"], r["n"]) for r in got.collect()) == [("2026-08-01", "a", 2), ("2026-08-02", "a", 1), ("2026-08-03", "a", 1), ("2026-08-06", "a", 2)]


def test_repeats_are_suppressed_within_the_horizon_and_come_back_after(arrivals, tmp_path):
    """A key seen again inside seven days is silent; after them it counts as new."""
    stream = arrivals([
        [("2026-08-01 10:00:00", "a")],
        [("2026-08-05 10:00:00", "a"), ("2026-08-05 10:00:00", "b")],
        [("2026-08-20 10:00:00", "c")],
        [("2026-08-20 11:00:00", "c")],
        [("2026-08-21 10:00:00", "a")],
        [("2026-08-02 10:00:00", "d")],  # behind the watermark
    ])
    got = jobs.run_once(jobs.suppress_repeats(stream, "ts", ["kind"]), str(tmp_path / "out"))
    assert sorted((str(r["ts"])[:10], r["kind"]) for r in got.collect()) == [("2026-08-01", "a"), ("2026-08-05", "b"), ("2026-08-20", "c"), ("2026-08-21", "a")]


def test_running_maximum_over_several_batches(arrivals, tmp_path):
    """Each batch goes on from the state before; an earlier day is too late, a second value of a day stays out."""
    schema = "event_key string, metric string, day string, rank string, value bigint, outlet string"
    stream = arrivals([
        [("e", "m", "2026-08-10", "2", 12, "y"), ("e", "m", "2026-08-10", "1", 10, "x")],
        [("e", "m", "2026-08-10", "0", 11, "z"), ("e", "m", "2026-08-11", "1", 90, "w"), ("e", "m", "2026-08-12", "1", 20, "v")],
        [("e", "m", "2026-08-09", "0", 15, "u"), ("e", "m", "2026-08-13", "1", 19, "t"), ("f", "m", "2026-08-01", "1", 3, "s")],
    ], schema, convert=False)
    got = jobs.run_once(jobs.running_maximum(stream), str(tmp_path / "out"))
    assert sorted(tuple(r) for r in got.collect()) == [("e", "m", "2026-08-10", 10, "x"), ("e", "m", "2026-08-12", 20, "v"), ("f", "m", "2026-08-01", 3, "s")]


def test_running_maximum_of_a_key_over_several_frames(spark, arrivals, tmp_path):
    """Edges of Arrow frames inside a trigger change nothing: days and ranks of all its frames are folded together."""
    schema = "event_key string, metric string, day string, rank string, value bigint, outlet string"
    rows = [("e", "m", f"2026-08-{day:02}", str(rank), 10 * day + rank, f"o{rank}") for day in range(20, 9, -1) for rank in range(5, 0, -1)]
    stream = arrivals([rows], schema, convert=False)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        got = jobs.run_once(jobs.running_maximum(stream), str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(tuple(r) for r in got.collect()) == [("e", "m", f"2026-08-{day}", 10 * day + 1, "o1") for day in range(10, 21)]
