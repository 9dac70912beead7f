"""Streaming jobs run once over the tables as they stand."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import CAPTURES_SQL, captures, query, scratch, table
from tremorlens.operators import consensus
from tremorlens.streaming import jobs


def _stream(spark, d):
    """The events table as a file stream."""
    return jobs.file_stream(spark, table(spark, d, "events").schema, f"{d}/events.parquet*")


@query(
    "T01",
    """SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2
    HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)""",
)
def t01(spark, d):
    events = _stream(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return jobs.run_once(jobs.daily_counts(events, "ts", ["event_type"]), scratch(spark, "t01"))


@query("T02", "SELECT DISTINCT CAST(ts AS DATE) AS day, event_type FROM events")
def t02(spark, d):
    events = _stream(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), F.to_date("ts").alias("day"), "event_type")
    return jobs.run_once(jobs.suppress_repeats(events, "ts", ["day", "event_type"]).select("day", "event_type"), scratch(spark, "t02"))


@query(
    "T03",
    f"WITH {CAPTURES_SQL} SELECT a.event_key, a.metric, CAST(a.day AS VARCHAR) AS day, a.value, r.outlet FROM accepted a JOIN ranked r ON r.event_key = a.event_key AND r.day = a.day AND r.rk = a.rk",
)
def t03(spark, d):
    rows = consensus.candidates(consensus.with_order(captures(spark, d))).filter("attributed AND NOT quarantined")
    path = scratch(spark, "t03-in")
    parts = F.concat_ws("|", *[F.lpad((F.col(f"rank_key.{c}") + 10**16).cast("string"), 18, "0") for c in ("regress", "no_anchor", "incoherent", "source", "live", "national", "filled", "recency", "item_id")])
    rows.select("event_key", "metric", F.col("day").cast("string").alias("day"), parts.alias("rank"), "value", "outlet").write.parquet(path)
    schema = "event_key string, metric string, day string, rank string, value bigint, outlet string"
    stream = jobs.file_stream(spark, schema, path)
    return jobs.run_once(jobs.running_maximum(stream), scratch(spark, "t03"))


@query(
    "T04",
    """SELECT CAST(user_id AS VARCHAR) AS source, max(ts) AS last_seen FROM events GROUP BY user_id
    HAVING max(ts) + INTERVAL 24 HOUR < (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
)
def t04(spark, d):
    events = _stream(spark, d).select(F.col("user_id"), F.col("ts").cast("timestamp").alias("ts"))
    silent = jobs.run_once(jobs.silent_sources(events, "user_id", "ts", hours=24), scratch(spark, "t04"))
    return silent.withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz"))
