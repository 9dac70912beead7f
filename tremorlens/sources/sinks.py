"""Published files: nested JSON, GeoJSON, CSV and feed items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlens.operators.coverage import state_label

# Columns of the published cross-check and the attribution line.
CROSSCHECK_COLUMNS = [
    "aoi", "estado", "etiqueta", "poblacion", "edificios_afectados", "vias_afectadas_km", "interrupciones_viales",
    "n_prensa", "n_ciudadano", "n_oficial", "entrega_producto", "fuente",
]
FEED_ITEMS = 80


def zone_documents(zones: DataFrame, examples: DataFrame, detections: DataFrame, keys: list[str]) -> DataFrame:
    """One nested document per zone: summary, at most three examples, counts by grade.

    The nested lists are bounded by construction (three examples, a handful of grades).
    """
    shown = examples.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", "title", "url"))).alias("examples"))
    by_grade = detections.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("grade", "n")))).alias("detections"))
    rest = [c for c in zones.columns if c not in keys]
    return zones.join(shown, keys, "left").join(by_grade, keys, "left").select(*keys, F.struct(*rest).alias("summary"), "examples", "detections")


def write_documents(df: DataFrame, path: str, by: list[str] = ()) -> None:
    """JSON lines, one document per row; NULL fields stay out."""
    writer = df.write.mode("overwrite").option("ignoreNullFields", "true")
    (writer.partitionBy(*by) if by else writer).json(path)


def point_features(df: DataFrame, lon: str, lat: str, properties: list[str]) -> DataFrame:
    """One GeoJSON feature per line; absent properties do not travel.

    Pass published (rounded) coordinates: this is the only way out for them.
    """
    values = [F.nullif(F.col(c), F.lit("")).alias(c) if dict(df.dtypes)[c] == "string" else F.col(c) for c in properties]
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*values).alias("properties"))
    return df.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(F.to_json(feature, {"ignoreNullFields": "true"}).alias("value"))


def write_features(features: DataFrame, path: str) -> None:
    features.write.mode("overwrite").text(path)


def crosscheck_rows(cross: DataFrame, summary: DataFrame, delivered: DataFrame, attribution: str) -> DataFrame:
    """The twelve published columns.

    ``cross``: zone, state and counts; ``summary``: zone and figures; ``delivered``: zone, delivery_time.
    """
    rows = cross.join(summary, "zone", "left").join(delivered, "zone", "left")
    values: list[Column] = [
        F.col("zone"), F.col("state"), state_label(F.col("state")), F.col("population"), F.col("affected_buildings"), F.col("affected_roads_km"),
        F.col("road_interruptions"), F.col("n_press"), F.col("n_citizen"), F.col("n_official"), F.col("delivery_time"), F.lit(attribution),
    ]
    return rows.select(*[v.alias(n) for v, n in zip(values, CROSSCHECK_COLUMNS, strict=True)])


def write_crosscheck(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def alert_items(alerts: DataFrame, day: str, link: str) -> DataFrame:
    """Alerts as feed items: marked title, description, stable guid."""
    mark = F.when(F.col("level") == "alta", "⚠️ ").otherwise("")
    return alerts.select(
        F.concat(mark, F.replace("kind", F.lit("_"), F.lit(" "))).alias("title"), F.coalesce("text", F.lit("")).alias("description"),
        F.lit(link).alias("link"), F.concat_ws("-", F.lit(day), F.coalesce("kind", F.lit("")), F.col("position").cast("string")).alias("guid"),
    )


def recent_items(items: DataFrame, order: list[Column], n: int = FEED_ITEMS) -> DataFrame:
    """A feed shows its newest ``n`` items (top-k by feature)."""
    return items.orderBy(*order).limit(n)


def write_items(items: DataFrame, path: str) -> None:
    items.write.mode("overwrite").format("xml").option("rootTag", "channel").option("rowTag", "item").save(path)
