"""Raw landing and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlens.plans.joins import derived_join


def landing_plan(arrivals: DataFrame) -> DataFrame:
    """Where each arriving body is stored.

    ``arrivals``: day, name, sha256, seq.  The first body of a day keeps the name, a
    different one gets the first eight characters of its hash, the same body again is
    logged but not stored (``stored`` marks the one arrival that writes).
    """
    first = arrivals.groupBy("day", "name").agg(F.min_by("sha256", "seq").alias("_first"))
    writer = arrivals.groupBy("day", "name", "sha256").agg(F.min("seq").alias("_writer"))
    joined = derived_join(arrivals, first, ["day", "name"], "left")
    joined = derived_join(joined, writer, ["day", "name", "sha256"], "left")
    mark = F.substring("sha256", 1, 8)
    beside = F.when(
        F.col("name").contains("."), F.concat(F.regexp_extract("name", r"^(.*)\.[^.]*$", 1), F.lit("_"), mark, F.lit("."), F.element_at(F.split("name", r"\."), -1))
    ).otherwise(F.concat("name", F.lit("_"), mark))
    file = F.when(F.col("sha256") == F.col("_first"), F.col("name")).otherwise(beside)
    return joined.withColumn("path", F.concat_ws("/", F.col("day").cast("string"), file)).withColumn(
        "stored", F.col("seq") == F.col("_writer")
    ).drop("_first", "_writer")


def derivation_log(counts: DataFrame, url: str, note: str, stamp: Column) -> DataFrame:
    """Log rows for data derived from the archive: no request, no status, no hash."""
    null = F.lit(None)
    return counts.select(
        stamp.alias("ts"), F.lit(url).alias("url"), null.cast("int").alias("http_status"), null.cast("string").alias("sha256"),
        null.cast("bigint").alias("bytes"), null.cast("string").alias("snapshot_path"),
        F.concat(F.lit(note + ": "), F.col("n").cast("string")).alias("note"),
    )


def with_lineage(mart: DataFrame, snapshot: Column, items: Column, rule_text: str) -> DataFrame:
    """Which input, how many items and which rule stand behind a derived figure."""
    lineage = F.struct(snapshot.alias("snapshot"), items.alias("items"), F.sha2(F.lit(rule_text), 256).alias("rule_sha256"))
    return mart.withColumn("derived_from", lineage)


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrite only the partitions present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
