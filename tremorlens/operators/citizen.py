"""Citizen reports: duplicates, score, daily counts, media manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlens.functions.web import AV_SUFFIXES
from tremorlens.plans.joins import derived_join, skew_join

# Fixed values.
FELT_THRESHOLD = 5
COHERENT_SCORE = 3
REVIEWED_STATES = ["validado", "publicado"]


def duplicate_media(reports: DataFrame, key: str, sha: str, order: str) -> DataFrame:
    """Adds ``duplicate_of``: the first report that holds the same media.

    One row per shared hash is found by aggregation and joined back, so a file sent a
    million times never sorts in one task.
    """
    first = (
        reports.filter(F.col(sha).isNotNull()).groupBy(sha)
        .agg(F.min_by(key, F.struct(order, key)).alias("_first"), F.count("*").alias("_n"))
        .filter("_n > 1").drop("_n")
    )
    joined = derived_join(reports, first, [sha], "left")
    return joined.withColumn("duplicate_of", F.when(F.col("_first") != F.col(key), F.col("_first"))).drop("_first")


def score_reports(reports: DataFrame, quake_ts: Column) -> DataFrame:
    """0-5 score and state; a reviewed state sticks.

    Needs intensity, zone, ts, sha, duplicate_of, state.
    """
    after = F.coalesce(F.col("ts") >= quake_ts, F.lit(False))
    has_media = F.col("sha").isNotNull()
    parts = [
        F.coalesce(F.col("intensity") >= FELT_THRESHOLD, F.lit(False)), F.col("zone").isNotNull(), after,
        has_media & F.col("duplicate_of").isNull(), has_media & F.col("duplicate_of").isNull(),
    ]
    score = sum((p.cast("int") for p in parts), F.lit(0))
    decided = F.when(score >= COHERENT_SCORE, "coherente").otherwise("recibido")
    return reports.withColumn("score", score).withColumn("after_quake", after).withColumn(
        "state", F.when(F.col("state").isin(REVIEWED_STATES), F.col("state")).otherwise(decided)
    )


def daily_reports(reports: DataFrame, day: Column, event_day: str, capture_day: str) -> DataFrame:
    """Reports per day; closed days without any are an observed zero.

    The capture day itself stays open: it appears only when something arrived.
    """
    counted = reports.select(day.alias("day")).filter("day IS NOT NULL").groupBy("day").agg(F.count("*").alias("_n"))
    spark = reports.sparkSession
    calendar = spark.range(1).select(
        F.explode(F.sequence(F.lit(event_day).cast("date"), F.date_sub(F.lit(capture_day).cast("date"), 1))).alias("day")
    )
    closed = calendar.join(counted, "day", "left").select("day", F.coalesce("_n", F.lit(0)).alias("n"))
    other = counted.join(calendar, "day", "left_anti").select("day", F.col("_n").alias("n"))
    return closed.unionByName(other)


def citizen_totals(scored: DataFrame) -> DataFrame:
    """Reports, inside a zone, duplicates."""
    return scored.agg(
        F.count("*").alias("reports"), F.count("zone").alias("in_zone"), F.count("duplicate_of").alias("duplicates")
    )


def media_manifest(reports: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Object, hash and size of audio and video; ``stored``: object, bytes."""
    name = F.element_at(F.split("media_url", "/"), -1)
    rows = reports.filter(F.col("sha").isNotNull()).select(name.alias("object"), "sha").filter(
        F.lower("object").rlike(AV_SUFFIXES)
    )
    if stored is None:
        return rows.withColumn("bytes", F.lit(None).cast("bigint"))
    return skew_join(rows, stored.select("object", "bytes"), ["object"], "left")
