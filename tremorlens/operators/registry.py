"""Daily registry, official silence, exposure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorlens.functions.numbers import rate_pct
from tremorlens.plans.joins import skew_join


def registry_series(daily: DataFrame, rebuilt: DataFrame | None = None) -> DataFrame:
    """A10: totals per captured day; rebuilt days only where nothing was captured, flagged."""
    totals = daily.groupBy("event_key", "day").agg(
        F.count("*").alias("municipalities"), F.sum("families").alias("families"), F.sum("persons").alias("persons")
    ).withColumn("rebuilt", F.lit(False))
    if rebuilt is None:
        return totals
    gaps = rebuilt.join(totals, ["event_key", "day"], "left_anti").withColumn("rebuilt", F.lit(True))
    return totals.unionByName(gaps.select(*totals.columns))


def registry_detail(daily: DataFrame, series: DataFrame, population: DataFrame) -> DataFrame:
    """Rows of the last day against the previous captured day, with rate and new flag."""
    # one row per event; a day is one value however many rows it has
    days = series.groupBy("event_key").agg(F.slice(F.sort_array(F.collect_set("day"), False), 1, 2).alias("_d")).select(
        "event_key", F.get("_d", F.lit(0)).alias("last"), F.get("_d", F.lit(1)).alias("prior")
    )
    rows = skew_join(daily, days, ["event_key"]).filter(F.col("day").isin(F.col("last"), F.col("prior")))
    now = rows.filter(F.col("day") == F.col("last"))
    keys = ["event_key", "department", "municipality"]
    before = rows.filter(F.col("day") == F.col("prior")).select(*keys, F.col("families").alias("_before"), F.lit(True).alias("_had"))
    joined = now.join(before, keys, "left")
    joined = skew_join(joined, population.select("department", "municipality", "population"), ["department", "municipality"], "left")
    has_prior = F.col("prior").isNotNull()
    delta = F.when(
        has_prior & F.col("_before").isNotNull(), F.coalesce(F.col("families"), F.lit(0)) - F.col("_before")
    )
    return joined.select(
        *keys, "day", "families", "persons", "population",
        rate_pct(F.col("persons"), F.col("population")).alias("rate_pct"), delta.alias("delta_families"),
        F.when(has_prior, F.col("_had").isNull()).alias("is_new"),
    )


def increments(series: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """Change between captures; NULL at the first or a missing side, decreases kept."""
    order = Window.partitionBy(*keys).orderBy(day)
    return series.withColumn("increment", F.col(value) - F.lag(value).over(order))


def since_event(series: DataFrame, day: str, event_day: str | None) -> DataFrame:
    """The part of a series that belongs to the event."""
    return series if not event_day else series.filter(F.col(day) >= F.lit(event_day).cast("date"))


def lost_days(series: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Calendar days between the first and last capture that have none."""
    order = Window.partitionBy(*keys).orderBy(day)
    gaps = series.select(*keys, day).distinct().withColumn("_next", F.lead(day).over(order)).filter(
        F.datediff("_next", day) > 1
    )
    return gaps.select(*keys, F.explode(F.sequence(F.date_add(day, 1), F.date_sub("_next", 1))).alias("lost_day"))


def source_silence(events: DataFrame, source: str, day: str, reference: str) -> DataFrame:
    """Records, first and last date per source and days of silence; no date, no count."""
    per = events.groupBy(source).agg(F.count("*").alias("records"), F.min(day).alias("since"), F.max(day).alias("until"))
    return per.withColumn("silent_days", F.datediff(F.lit(reference).cast("date"), F.col("until")))


def exposure_gap(exposure: DataFrame, covered: DataFrame, threshold: float = 6) -> DataFrame:
    """People exposed at or above the threshold, covered by zones, and the gap.

    ``exposure``: event_key, intensity, people; ``covered``: event_key, population.
    """
    exposed = exposure.groupBy("event_key").agg(
        F.sum(F.when(F.col("intensity") >= threshold, F.col("people")).otherwise(0)).alias("exposed")
    ).filter("exposed > 0")
    inside = covered.groupBy("event_key").agg(F.sum("population").alias("covered"))
    joined = exposed.join(inside, "event_key", "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return joined.withColumn("uncovered", F.greatest(F.col("exposed") - F.col("covered"), F.lit(0))).withColumn(
        "covered_pct", F.round(100 * F.col("covered") / F.col("exposed"), 1)
    )


def historic_events(events: DataFrame, kind: str, needle: str = "SISMO") -> DataFrame:
    """Located records whose type contains the needle."""
    return events.filter(F.upper(kind).contains(needle) & F.col("lat").isNotNull() & F.col("lon").isNotNull())


def timeline(marks: DataFrame, captures: DataFrame, registry: DataFrame, volume: DataFrame) -> DataFrame:
    """Given marks plus those the data imply.

    First report capture, first registry day, and the day after the last non-NULL value
    of a series that later stops (``volume``: event_key, day, value).
    """
    first_report = captures.groupBy("event_key").agg(F.min("day").alias("day")).withColumn("kind", F.lit("first_report"))
    first_registry = registry.groupBy("event_key").agg(F.min("day").alias("day")).withColumn("kind", F.lit("first_registry"))
    last = volume.groupBy("event_key").agg(F.max(F.when(F.col("value").isNotNull(), F.col("day"))).alias("_last"))
    purge = skew_join(volume, last, ["event_key"]).filter(F.col("day") > F.col("_last")).groupBy("event_key").agg(
        F.min("day").alias("day")
    ).withColumn("kind", F.lit("series_stopped"))
    columns = ["event_key", "day", "kind"]
    out = marks.select(*columns)
    for part in (first_report, first_registry, purge):
        out = out.unionByName(part.select(*columns))
    return out.filter("day IS NOT NULL")


def pct_change(first: Column, last: Column) -> Column:
    """Share of growth from the first to the last capture, NULL from zero or nothing."""
    return F.when(first != 0, (last - first) / first * 100)
