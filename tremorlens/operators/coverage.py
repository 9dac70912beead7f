"""Cross-check and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorlens.operators.buildings import grade_bucket
from tremorlens.plans.joins import skew_join

# Published labels of the cross-check states.
STATE_LABELS = {
    "coincide": "Coincide cualitativamente",
    "prensa": "Reportado en prensa, sin validación oficial",
    "ciudadano": "Reportado por ciudadanos, sin eco oficial ni satelital validado",
    "pendiente": "Pendiente de validar",
    "no_comparable": "No comparable 1:1",
}
COUNTED_STATES = ["coherente", "validado", "publicado"]
# Statistic categories of a zone summary.
POPULATION, BUILT_UP = "Estimated population", "Built-up"
TRANSPORT, BLOCKED = "Transportation", "Blocked road / interruption"
NO_GRADE, CRISIS, ROADS = "Sin grado", "Interrupciones/crisis", "Vías dañadas"


def cross_state(has_stats: Column, official: Column, press: Column, citizen: Column) -> Column:
    """Without a satellite product nothing compares; only official evidence coincides."""
    return (
        F.when(~has_stats, "no_comparable").when(official > 0, "coincide").when(press > 0, "prensa")
        .when(citizen > 0, "ciudadano").otherwise("pendiente")
    )


def cross_check(zones: DataFrame, stats: DataFrame, evidence: DataFrame, press: DataFrame, citizens: DataFrame) -> DataFrame:
    """A01 + A02: counts per zone and the decided state.

    ``stats``: zone, affected; ``evidence``: zone, kind; ``press``: zone (one row per
    matched headline); ``citizens``: zone, state.  Every input is aggregated before it
    meets the zones, so the joins run on one row per zone.
    """
    parts = [
        stats.filter(F.col("affected").isNotNull()).groupBy("zone").agg(F.lit(True).alias("has_stats")),
        evidence.filter(F.col("kind") == "oficial").groupBy("zone").agg(F.count("*").alias("n_official")),
        press.groupBy("zone").agg(F.count("*").alias("n_press")),
        citizens.filter(F.col("state").isin(COUNTED_STATES)).groupBy("zone").agg(F.count("*").alias("n_citizen")),
    ]
    out = zones.select("zone").distinct()
    for part in parts:
        out = out.join(part, "zone", "left")
    counts = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_official", "n_press", "n_citizen")}
    filled = out.withColumns({"has_stats": F.coalesce("has_stats", F.lit(False)), **counts})
    state = cross_state(F.col("has_stats"), F.col("n_official"), F.col("n_press"), F.col("n_citizen"))
    return filled.withColumn("state", state)


def state_label(state: Column) -> Column:
    names = F.create_map(*[F.lit(v) for pair in STATE_LABELS.items() for v in pair])
    return F.coalesce(F.try_element_at(names, state), state)


def zone_summary(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Key figures per zone; a sum over nothing stays NULL."""

    def affected(category: str) -> Column:
        return F.sum(F.when(F.col("category") == category, F.col("affected")))

    return stats.groupBy(*keys).agg(
        F.max(F.when(F.col("category") == POPULATION, F.col("total"))).alias("population"),
        affected(BUILT_UP).alias("affected_buildings"), F.round(affected(TRANSPORT), 2).alias("affected_roads_km"),
        affected(BLOCKED).alias("road_interruptions"),
    )


def detections(points: DataFrame, lines: DataFrame) -> DataFrame:
    """Detections per zone and grade; ``points``: zone, layer, grade; ``lines``: zone."""
    grade = F.when(F.col("layer") == "builtUpP", F.coalesce(F.nullif("grade", F.lit("")), F.lit(NO_GRADE))).otherwise(CRISIS)
    both = points.select("zone", grade.alias("grade")).unionByName(lines.select("zone", F.lit(ROADS).alias("grade")))
    return both.groupBy("zone", "grade").agg(F.count("*").alias("n"))


def vendor_by_place(points: DataFrame, event_code: str) -> DataFrame:
    """Buildings, observed, possible, inconsistent codes, last image per place."""
    bucket = grade_bucket(F.col("grade"))
    return points.filter(F.col("place").isNotNull()).groupBy("place").agg(
        F.count("*").alias("buildings"), F.count_if(bucket == "observed").alias("observed"),
        F.count_if(bucket == "possible").alias("possible"),
        F.count_if(F.upper(F.coalesce("event_code", F.lit(""))) != event_code).alias("inconsistent_code"),
        F.max("sensor_date").alias("last_image"),
    )


def graded_by_place(points: DataFrame, products: DataFrame) -> DataFrame:
    """Graded buildings, those marked without a grade apart, and the analysed area."""
    apart = F.coalesce(F.lower("grade").startswith("not applicable"), F.lit(False))
    counts = points.filter(F.col("place").isNotNull()).groupBy("place").agg(
        F.count_if(~apart).alias("buildings"), F.count_if(apart).alias("without_grade"),
        F.count_if(F.col("grade") == "Destroyed").alias("destroyed"), F.count_if(F.col("grade") == "Damaged").alias("damaged"),
        F.count_if(F.col("grade") == "Possibly damaged").alias("possible"),
    )
    area = products.filter(F.col("place").isNotNull()).groupBy("place").agg(F.max("area_km2").alias("area_km2"))
    return counts.join(area, "place", "left")


def press_silence(places: DataFrame) -> DataFrame:
    """Registered victims without one headline, in three tiers of certainty.

    ``places``: municipality, persons, n_news, needs_department, homonym, own_search,
    rate_pct.  Only an unambiguous name that was really searched for is certain.  The top place
    is the one with the highest rate, then the most persons, then the first name.
    """
    flag = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("needs_department", "homonym", "own_search")}
    mute = F.coalesce(F.col("n_news") == 0, F.lit(False))
    certain = mute & ~flag["needs_department"] & ~flag["homonym"] & flag["own_search"]
    doubtful = mute & ~certain
    lost = F.col("n_news").isNull() & flag["homonym"]

    def people(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("persons"))), F.lit(0))

    return places.filter(F.col("persons") > 0).agg(
        F.count_if(mute).alias("mute"), people(mute).alias("people"), F.count_if(certain).alias("certain"),
        people(certain).alias("people_certain"), F.count_if(doubtful).alias("doubtful"),
        F.count_if(doubtful & (F.col("own_search") == False)).alias("unsearched"),  # noqa: E712
        F.count_if(lost).alias("unattributable"), people(lost).alias("people_unattributable"),
        F.min_by("municipality", F.when(certain, F.struct(-F.col("rate_pct"), -F.col("persons"), "municipality"))).alias("top_place"),
        F.max(F.when(certain, F.col("rate_pct"))).alias("top_rate_pct"),
    ).filter("mute > 0")


def point_evidence(satellite: DataFrame, citizen: DataFrame, vendor_a: DataFrame, vendor_b: DataFrame, units: DataFrame) -> DataFrame:
    """Places with located evidence from any side, by unique buildings plus reports.

    Counts come as (place, n); ``units`` as (place, units).
    """
    names = {"n_satellite": satellite, "n_citizen": citizen, "n_vendor_a": vendor_a, "n_vendor_b": vendor_b}
    out = None
    for column, frame in names.items():
        part = frame.select("place", F.col("n").alias(column))
        out = part if out is None else out.join(part, "place", "full")
    filled = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in names}).join(units, "place", "left")
    evaluated = F.when(F.col("units") > 0, F.col("units")).otherwise(F.greatest("n_satellite", "n_vendor_a", "n_vendor_b"))
    return filled.withColumn("n_evaluated", evaluated).drop("units").orderBy(
        (F.col("n_evaluated") + F.col("n_citizen")).desc(), "place"
    )


def looked_at(evidence: DataFrame) -> DataFrame:
    """How many places each side has looked at."""
    return evidence.agg(
        F.count_if(F.col("n_evaluated") > 0).alias("by_satellite"), F.count_if(F.col("n_citizen") > 0).alias("by_citizens")
    )


def unregistered_zones(summary: DataFrame) -> DataFrame:
    """Zones with satellite damage and no official evidence."""
    return summary.filter(
        (F.coalesce("affected_buildings", F.lit(0)) > 0) & (F.coalesce("n_official", F.lit(0)) == 0)
    ).select("zone").distinct()


def place_profile(series: DataFrame, reports: DataFrame, news: DataFrame, near_zones: DataFrame) -> DataFrame:
    """Per place the registry's first and last value, reports, outlets and nearest zone.

    ``series``: place, day, families; ``reports``: place, has_media; ``news``: place,
    outlet; ``near_zones``: place, zone, km.
    """
    from tremorlens.operators.registry import pct_change

    ends = series.groupBy("place").agg(
        F.count("*").alias("n_days"), F.min_by("families", "day").alias("first_families"), F.max_by("families", "day").alias("last_families")
    )
    grown = F.col("n_days") > 1
    growth = ends.withColumn("delta", F.when(grown & (F.col("first_families") != 0), F.col("last_families") - F.col("first_families"))).withColumn(
        "delta_pct", F.when(grown, F.round(pct_change(F.col("first_families"), F.col("last_families")), 4))
    )
    seen = reports.groupBy("place").agg(F.count("*").alias("n_reports"), F.count_if("has_media").alias("n_with_media"))
    press = news.groupBy("place").agg(F.count("*").alias("n_news"), F.count_distinct("outlet").alias("n_outlets"))
    nearest = near_zones.groupBy("place").agg(F.min_by("zone", F.struct("km", "zone")).alias("nearest_zone"), F.min("km").alias("nearest_km"))
    out = growth
    for part in (seen, press, nearest):
        out = out.join(part, "place", "full")
    return out


def evidence_layers(layers: dict[str, DataFrame]) -> DataFrame:
    """Every point of every layer as one long table, keyed by place.

    The bundle of one place is a partition of this table; it is written partitioned by
    place rather than gathered in one row.
    """
    out = None
    for name, layer in layers.items():
        part = layer.select("place", F.lit(name).alias("layer"), "zone", "lon", "lat")
        out = part if out is None else out.unionByName(part)
    return out


def evidence_counts(bundle: DataFrame, layers: list[str]) -> DataFrame:
    """Points per place and layer, totals, and the zones the place's points touch."""
    counts = [F.count_if(F.col("layer") == n).alias(n) for n in layers]
    satellite = F.count_if(F.col("layer") != "citizen")
    return bundle.filter(F.col("place").isNotNull()).groupBy("place").agg(
        *counts, satellite.alias("satellite"), F.count("*").alias("total"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("layer") == layers[0], F.col("zone")))), ",").alias("zones"),
    )


def services(points: DataFrame, place: str, source: str) -> DataFrame:
    """Distinct services behind the total (a handful of names)."""
    return points.filter(F.col(place).isNotNull()).select(source).distinct().agg(
        F.array_join(F.array_sort(F.collect_list(source)), ",").alias("services"), F.count("*").alias("n_services")
    )


def deliveries(products: DataFrame, day: str = "snapshot_date") -> DataFrame:
    """Delivered products of the latest snapshot."""
    from tremorlens.operators.snapshots import latest_snapshot

    return latest_snapshot(products, day).filter(F.col("delivery_time").isNotNull()).select(
        "zone", F.to_date("delivery_time").alias("delivered"), "ptype", "version"
    )


def has_signal(*signals: Column) -> Column:
    """At least one signal of any kind; a zero count is no signal."""
    out = F.lit(False)
    for s in signals:
        out = out | F.coalesce(s, F.lit(False))
    return out


def evidence_outlets(evidence: DataFrame, news: DataFrame, url_host: Column) -> DataFrame:
    """Evidence rows with the outlet of their headline, or their own signature.

    Of several headlines at one address the least (outlet, domain) counts, a missing outlet last; evidence rows are never multiplied.
    """
    signed = F.struct(F.col("outlet").isNull(), "outlet", F.col("outlet_domain").isNull(), "outlet_domain")
    side = news.filter(F.col("url").isNotNull()).groupBy("url").agg(F.min(signed).alias("_n")).select(
        "url", F.col("_n.outlet").alias("_outlet"), F.col("_n.outlet_domain").alias("_domain"), F.lit(True).alias("_own")
    )
    own = F.coalesce("_own", F.lit(False))
    return (
        skew_join(evidence, side, ["url"], "left")
        .withColumn("outlet", F.when(own, F.col("_outlet")).otherwise(F.col("signature")))
        .withColumn("outlet_domain", F.when(own, F.col("_domain")).otherwise(url_host)).drop("_outlet", "_domain", "_own")
    )


def activation_details(index: DataFrame, activations: DataFrame, products: DataFrame) -> DataFrame:
    """Every known code with its latest detail: closed, zones, products."""
    newest = activations.groupBy("code").agg(F.max_by(F.struct("snapshot_date", "closed"), "snapshot_date").alias("_a")).select("code", "_a.*")
    counts = products.groupBy("code", "snapshot_date").agg(
        F.count_distinct("zone").alias("n_zones"), F.count("*").alias("n_products")
    )
    return (
        index.join(newest, "code", "left").join(counts, ["code", "snapshot_date"], "left")
        .withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_zones", "n_products")})
    )


def package_product(packages: DataFrame, catalog: DataFrame) -> DataFrame:
    """Package to catalogue by base name, else by place (lowest product id)."""
    by_name = catalog.filter(F.col("base").isNotNull()).groupBy("base").agg(F.min("product_id").alias("_p1"))
    by_place = catalog.filter(F.col("place").isNotNull()).groupBy("place").agg(F.min("product_id").alias("_p2"))
    joined = skew_join(skew_join(packages, by_name, ["base"], "left"), by_place, ["place"], "left")
    return joined.withColumn("product_id", F.coalesce("_p1", "_p2")).drop("_p1", "_p2")


def examples(rows: DataFrame, keys: list[str], order: list[str], n: int = 3) -> DataFrame:
    """The first ``n`` rows per key; pruned before the shuffle by the group limit."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
