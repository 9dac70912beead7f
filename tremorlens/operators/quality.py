"""Expectations over the finished tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlens.plans.joins import derived_join, with_scalar

# Fixed values.
DECAY_FACTOR = 2
LATE_SHARE = 0.5


def _row(name: str, df: DataFrame, holds) -> DataFrame:
    return df.select(F.lit(name).alias("hypothesis"), holds.alias("holds"))


def attention_decays(volume: DataFrame, factor: float = DECAY_FACTOR) -> DataFrame:
    """The first day's attention is more than ``factor`` times the last day's."""
    ends = volume.filter("press IS NOT NULL").agg(
        F.min_by("press", "day").alias("first"), F.max_by("press", "day").alias("last"), F.count("*").alias("n")
    )
    return _row("attention_decays", ends, F.when(F.col("n") >= 3, F.col("first") > F.col("last") * factor))


def citizen_peak_later(volume: DataFrame) -> DataFrame:
    """The citizen peak comes after the press peak (first of equal peaks)."""
    both = volume.filter("press IS NOT NULL AND citizen IS NOT NULL")
    peaks = both.agg(
        F.min_by("day", F.struct(-F.col("press"), F.col("day"))).alias("press_day"),
        F.min_by("day", F.struct(-F.col("citizen"), F.col("day"))).alias("citizen_day"), F.count("*").alias("n"),
    )
    return _row("citizen_peak_later", peaks, F.when(F.col("n") >= 4, F.col("citizen_day") > F.col("press_day")))


def deliveries_in_low_attention(volume: DataFrame, delivered: DataFrame, share: float = LATE_SHARE) -> DataFrame:
    """Some delivery fell on a day under ``share`` of the press peak."""
    peak = volume.agg(F.max("press").alias("peak"))
    days = with_scalar(delivered.join(volume.select("day", "press"), "day"), peak)
    return _row("deliveries_in_low_attention", days.agg(F.count_if(F.col("press") < F.col("peak") * share).alias("n")), F.col("n") > 0)


def no_match_without_official(states: DataFrame, evidence: DataFrame) -> DataFrame:
    """No zone coincides without official evidence."""
    official = evidence.filter("kind = 'oficial'").select("zone").distinct()
    bad = states.filter("state = 'coincide'").join(official, "zone", "left_anti")
    return _row("no_match_without_official", bad.agg(F.count("*").alias("n")), F.col("n") == 0)


def hashes_present(log: DataFrame) -> DataFrame:
    """Every successful request left a hash."""
    return _row("hashes_present", log.agg(F.count_if((F.col("status") == 200) & F.col("sha256").isNull()).alias("n")), F.col("n") == 0)


def no_exact_coordinate(reports: DataFrame, published: DataFrame) -> DataFrame:
    """No coordinate finer than the published precision got out."""
    exact = reports.filter(F.abs(F.col("lat") - F.round("lat", 3)) > 1e-9).select("lat", "lon").distinct()
    leaked = published.select("lat", "lon").distinct().join(exact, ["lat", "lon"], "left_semi")
    return _row("no_exact_coordinate", leaked.agg(F.count("*").alias("n")), F.col("n") == 0)


def coverage_within_bounds(exposure: DataFrame) -> DataFrame:
    """Nothing covers more than everyone exposed."""
    return _row("coverage_within_bounds", exposure.agg(F.count_if(F.col("covered_pct") > 100).alias("n")), F.col("n") == 0)


def log_integrity(log: DataFrame, bodies: DataFrame, exempt_notes: list[str] = ()) -> DataFrame:
    """Log rows whose stored body is missing or does not match its hash.

    ``log``: path, sha256, status, bytes, note; ``bodies``: path, body_sha.
    """
    checked = log.filter((F.col("status") == 200) & (F.col("bytes") > 0))
    if exempt_notes:
        checked = checked.filter(F.col("note").isNull() | ~F.col("note").isin(list(exempt_notes)))
    joined = derived_join(checked, bodies, ["path"], "left")
    problem = (
        F.when(F.col("path").isNull(), "missing_path").when(F.col("body_sha").isNull(), "missing_body")
        .when(F.col("body_sha") != F.col("sha256"), "hash_mismatch")
    )
    return joined.withColumn("problem", problem).filter("problem IS NOT NULL").select("path", "sha256", "problem")


def body_hashes(spark, path: str) -> DataFrame:
    """Stored bodies with their hash, read as binary files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("body_sha"), F.col("length").alias("body_bytes"))
