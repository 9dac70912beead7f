"""One row per place that shows any signal, with the state its best signal allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlens.functions.numbers import rate_pct

# Place states in order of precedence.
STATES = [
    "en_aoi", "evaluado_unosat", "evaluado_satelite", "intensidad_alta", "mencion_prensa", "solo_rud", "fuera_aoi",
]
HIGH_INTENSITY = 6


def place_state(in_zone: Column, vendor_a: Column, vendor_b: Column, felt: Column, press: Column, registry: Column) -> Column:
    high = F.coalesce(felt >= HIGH_INTENSITY, F.lit(False))
    out = F.when(in_zone, STATES[0])
    for flag, state in zip((vendor_a, vendor_b, high, press, registry), STATES[1:-1], strict=True):
        out = out.when(flag, state)
    return out.otherwise(STATES[-1])


def influence_layer(
    places: DataFrame, news: DataFrame, felt: DataFrame, registry: DataFrame, vendor_a: DataFrame, vendor_b: DataFrame,
    in_zone: DataFrame, searched: DataFrame,
) -> DataFrame:
    """Places joined with pre-aggregated signals; rows without any signal drop out.

    ``places``: municipality, department, population, homonym, needs_department, lat, lon.
    ``news``: municipality, n_news; ``felt``: municipality, felt_max_cdi, felt_responses,
    felt_cells; ``registry``: municipality, families, persons; vendors: municipality,
    buildings; ``in_zone`` and ``searched``: municipality.
    """
    flagged = in_zone.select("municipality").distinct().withColumn("_zone", F.lit(True))
    asked = searched.select("municipality").distinct().withColumn("_asked", F.lit(True))
    a = vendor_a.select("municipality", F.col("buildings").alias("vendor_a_buildings"))
    b = vendor_b.select("municipality", F.col("buildings").alias("vendor_b_buildings"))
    rows = places
    for part in (news, felt, registry.withColumn("_reg", F.lit(True)), a, b, flagged, asked):
        rows = rows.join(part, "municipality", "left")
    has = {
        "prensa": F.coalesce(F.col("n_news") > 0, F.lit(False)), "dyfi": F.col("felt_max_cdi").isNotNull(),
        "rud": F.col("_reg").isNotNull(), "unosat": F.coalesce(F.col("vendor_a_buildings") > 0, F.lit(False)),
        "sertit": F.coalesce(F.col("vendor_b_buildings") > 0, F.lit(False)),
    }
    any_signal = F.lit(False)
    for flag in has.values():
        any_signal = any_signal | flag
    zone = F.coalesce("_zone", F.lit(False))
    state = place_state(zone, has["unosat"], has["sertit"], F.col("felt_max_cdi"), has["prensa"], has["rud"])
    sources = F.filter(F.array(*[F.when(flag, F.lit(name)) for name, flag in has.items()]), lambda s: s.isNotNull())
    return rows.filter(any_signal).select(
        "municipality", "department", "lat", "lon", "population", "needs_department", "homonym",
        F.when(F.col("homonym"), F.lit(None)).otherwise(F.coalesce("n_news", F.lit(0))).cast("bigint").alias("n_news"),
        "felt_max_cdi", F.when(F.col("felt_cells") > 0, F.col("felt_responses")).alias("felt_responses"), "families", "persons",
        F.when(has["unosat"], F.col("vendor_a_buildings")).alias("vendor_a_buildings"),
        F.when(has["sertit"], F.col("vendor_b_buildings")).alias("vendor_b_buildings"),
        zone.alias("in_zone"), state.alias("state"), F.coalesce("_asked", F.lit(False)).alias("own_search"),
        sources.alias("sources"), rate_pct(F.col("persons"), F.col("population")).alias("rate_pct"),
    )


def display_order(layer: DataFrame) -> DataFrame:
    """Zone first, then buildings, intensity, headlines, name."""
    zero = F.lit(0)
    return layer.orderBy(
        F.col("in_zone").desc(), F.coalesce("vendor_a_buildings", zero).desc(), F.coalesce("felt_max_cdi", zero).desc(),
        F.coalesce("n_news", zero).desc(), "municipality",
    )
