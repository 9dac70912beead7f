"""What changed since yesterday."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
ALWAYS_NOTIFIED = ["rud_actualizado", "balance_en_medios"]
_EVENT_CODE = r"^[A-Z]{2}(\d{4})(\d{2})(\d{2})[A-Z]{3}$"


def impossible_codes(points: DataFrame, today: str) -> DataFrame:
    """Event codes whose embedded date cannot be true, per code and layer.

    A code off the pattern is absence of a date, not an error.
    """
    groups = points.filter(F.col("event_code").isNotNull()).groupBy("event_code", "layer").agg(
        F.min("sensor_date").alias("_sensor"), F.count("*").alias("n")
    )
    code = F.upper("event_code")
    day = F.concat_ws("-", *[F.regexp_extract(code, _EVENT_CODE, i) for i in (1, 2, 3)])
    image = F.when(
        F.length("_sensor") == 8, F.concat_ws("-", F.substring("_sensor", 1, 4), F.substring("_sensor", 5, 2), F.substring("_sensor", 7, 2))
    )
    rows = groups.filter(code.rlike(_EVENT_CODE)).withColumn("code_day", day).withColumn("image_day", image)
    reason = F.when(F.col("code_day") > today, "future").when(F.col("code_day") > F.col("image_day"), "after_image")
    return rows.withColumn("reason", reason).filter("reason IS NOT NULL").drop("_sensor")


def count_alert(rows: DataFrame, condition: Column, kind: str, level: str) -> DataFrame:
    """One alert row when any row meets the condition, carrying how many."""
    return (
        rows.agg(F.count_if(condition).alias("n")).filter("n > 0")
        .select(F.lit(kind).alias("kind"), F.lit(level).alias("level"), "n")
    )


def registry_alert(now: DataFrame, before: DataFrame) -> DataFrame:
    """Registry growth against the previous capture; both sides (municipality, families)."""
    sides = now.select("families", F.lit(True).alias("_now")).unionByName(before.select("families", F.lit(False).alias("_now")))
    families = F.coalesce("families", F.lit(0))
    both = sides.agg(
        F.count_if("_now").alias("now_m"), F.count_if(~F.col("_now")).alias("old_m"),
        F.sum(F.when(F.col("_now"), families).otherwise(0)).alias("now_f"),
        F.sum(F.when(F.col("_now"), 0).otherwise(families)).alias("old_f"),
    )
    changed = (F.col("now_m") != F.col("old_m")) | (F.col("now_f") != F.col("old_f"))
    kind = F.when(F.col("old_m") == 0, "rud_activo").when(changed, "rud_actualizado")
    return both.filter("now_m > 0").select(
        kind.alias("kind"), F.when(F.col("old_m") == 0, "alta").otherwise("info").alias("level"),
        (F.col("now_m") - F.col("old_m")).alias("d_municipalities"), (F.col("now_f") - F.col("old_f")).alias("d_families"),
    ).filter("kind IS NOT NULL")


def awakened_source(events: DataFrame, day: str, stalled: str) -> DataFrame:
    """An official source that moved past the date where it had stopped."""
    return events.agg(F.max(day).alias("max_day")).filter(F.col("max_day") > F.lit(stalled).cast("date")).select(
        F.lit("fuente_oficial_actualizada").alias("kind"), F.lit("alta").alias("level"), "max_day"
    )


def new_activations(before: DataFrame, after: DataFrame, country: str) -> DataFrame:
    """Codes that became public and belong to the country (``countries`` is an array)."""
    known = before.filter("exists_public").select("code")
    return after.filter(F.col("exists_public") & F.array_contains("countries", country)).join(known, "code", "left_anti")


def public_index(index: DataFrame) -> DataFrame:
    """The codes the service shows."""
    return index.filter("exists_public")


def missing_codes(codes: DataFrame, keys: list[str], number: str, span: int = 4096) -> DataFrame:
    """Runs of absent numbers between known ones, with their length.

    Each gap is read off two neighbours, so nothing enumerates the whole range.  Neighbours are
    found inside spans of the range first, and then between the ends of spans, so that a key with
    very many numbers is never sorted in one piece.
    """
    known = codes.select(*keys, number).distinct().withColumn("_span", F.floor(F.col(number) / span))
    inside = known.withColumn("_next", F.lead(number).over(Window.partitionBy(*keys, "_span").orderBy(number)))
    ends = known.groupBy(*keys, "_span").agg(F.max(number).alias(number), F.min(number).alias("_first"))
    between = ends.withColumn("_next", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_span"))).select(*keys, number, "_next")
    pairs = inside.select(*keys, number, "_next").unionByName(between)
    return pairs.filter(F.col("_next") - F.col(number) > 1).select(
        *keys, (F.col(number) + 1).alias("first_missing"), (F.col("_next") - 1).alias("last_missing"),
        (F.col("_next") - F.col(number) - 1).alias("run_length"),
    )


def notifiable(alerts: DataFrame) -> DataFrame:
    """High-level alerts plus the daily pulse."""
    return alerts.filter((F.col("level") == "alta") | F.col("kind").isin(ALWAYS_NOTIFIED))


def digest(alerts: DataFrame, day: str, lines: int = 3) -> DataFrame:
    """Payload hash, first lines and how many more, one row per day.

    ``alerts``: the day, position, kind, level, text.  The alerts of one day are a short
    list by nature: one row per rule that fired.
    """
    rows = notifiable(alerts)
    mark = F.concat(F.when(F.col("level") == "alta", "⚠️ ").otherwise(""), F.col("text"))
    packed = rows.groupBy(day).agg(
        F.sort_array(F.collect_list(F.struct("position", "kind", "text", mark.alias("line")))).alias("_a"), F.count("*").alias("n_alerts")
    )
    payload = F.to_json(F.transform("_a", lambda a: F.array(a["kind"], a["text"])))
    shown = F.array_join(F.slice(F.transform("_a", lambda a: a["line"]), 1, lines), "\n")
    more = F.when(F.col("n_alerts") > lines, F.concat(F.lit("\n… y "), (F.col("n_alerts") - lines).cast("string"), F.lit(" más"))).otherwise("")
    return packed.select(
        day, "n_alerts", F.sha2(payload, 256).alias("payload_sha"), F.substring(F.concat(shown, more), 1, 500).alias("body")
    )
