"""Aggregations, cascades, alerts and quality rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import (
    CAPTURES_SQL, CENTRES_SQL, POINTS_SQL, REGISTRY_SQL, captures, centres, haversine_sql, points, positioned, query, registry, table,
)
from checks.spatial_checks import LOCATED_SQL, TOWN_SQL, UNITS_SQL, resolved_units
from tremorlens.operators import alerts, citizen, consensus, coverage, influence, media, quality, snapshots, spatial
from tremorlens.operators import registry as reg
from tremorlens.sources import sinks

# ---------------------------------------------------------------- cross-check: priorities are zones
CROSS_SQL = """stats AS (SELECT DISTINCT o_orderpriority AS zone FROM orders WHERE o_orderpriority <> '5-LOW'),
evidence AS (SELECT o_orderpriority AS zone, CASE WHEN o_orderkey % 2 = 0 THEN 'oficial' ELSE 'prensa' END AS kind FROM (SELECT * REPLACE (CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN o_orderpriority END AS o_orderpriority) FROM orders)),
press AS (SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'O' THEN o_orderpriority END AS zone FROM orders),
citizens AS (SELECT nullif(o_orderpriority, '4-NOT SPECIFIED') AS zone, CASE WHEN o_orderkey % 3 = 0 THEN 'coherente' ELSE 'recibido' END AS state FROM orders),
cross_check AS (
  SELECT z.zone, z.zone IN (SELECT zone FROM stats) AS has_stats, (SELECT count(*) FROM evidence e WHERE e.zone = z.zone AND kind = 'oficial') AS n_official,
    (SELECT count(*) FROM press p WHERE p.zone = z.zone) AS n_press, (SELECT count(*) FROM citizens c WHERE c.zone = z.zone AND c.state = 'coherente') AS n_citizen
  FROM (SELECT DISTINCT o_orderpriority AS zone FROM orders) z)"""
STATE_SQL = "CASE WHEN NOT has_stats THEN 'no_comparable' WHEN n_official > 0 THEN 'coincide' WHEN n_press > 0 THEN 'prensa' WHEN n_citizen > 0 THEN 'ciudadano' ELSE 'pendiente' END"


def _cross(spark, d):
    orders = table(spark, d, "orders").withColumn("zone", F.col("o_orderpriority"))
    k, s, z = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("zone")
    stats = orders.select(z, F.when(z != "5-LOW", F.col("o_totalprice")).alias("affected"))
    evidence = orders.select(F.when((z == "1-URGENT") & (s == "F"), z).alias("zone"), F.when(k % 2 == 0, "oficial").otherwise("prensa").alias("kind"))
    press = orders.select(F.when(z.isin("1-URGENT", "2-HIGH") & (s == "O"), z).alias("zone"))
    citizens = orders.select(F.nullif(z, F.lit("4-NOT SPECIFIED")).alias("zone"), F.when(k % 3 == 0, "coherente").otherwise("recibido").alias("state"))
    return coverage.cross_check(orders.select(z), stats, evidence, press, citizens)


@query("A01", f"WITH {CROSS_SQL} SELECT zone, has_stats, n_official, n_press, n_citizen FROM cross_check")
def a01(spark, d):
    return _cross(spark, d).drop("state")


@query("A02", f"WITH {CROSS_SQL} SELECT zone, {STATE_SQL} AS state FROM cross_check")
def a02(spark, d):
    return _cross(spark, d).select("zone", "state")


# ---------------------------------------------------------------- A03: line items as statistics of suppliers' zones
CATEGORIES = [coverage.POPULATION, coverage.BUILT_UP, coverage.TRANSPORT, coverage.BLOCKED, "Other"]
ZONE_STATS_SQL = f"""zs AS (SELECT l_suppkey AS zone, ([{",".join(f"'{c}'" for c in CATEGORIES)}])[l_orderkey % 5 + 1] AS category, CAST(l_quantity AS BIGINT) AS total,
  CASE WHEN l_linenumber % 3 <> 0 AND l_suppkey % 4 <> 0 THEN CAST(l_quantity AS BIGINT) END AS affected FROM lineitem)"""
SUMMARY_SQL = f"""SELECT zone, CAST(max(total) FILTER (category = '{CATEGORIES[0]}') AS BIGINT) AS population, CAST(sum(affected) FILTER (category = '{CATEGORIES[1]}') AS BIGINT) AS affected_buildings,
  CAST(sum(affected) FILTER (category = '{CATEGORIES[2]}') AS BIGINT) AS affected_roads_km, CAST(sum(affected) FILTER (category = '{CATEGORIES[3]}') AS BIGINT) AS road_interruptions FROM zs GROUP BY zone"""


def _zone_stats(spark, d):
    amount = F.col("l_quantity").cast("bigint")
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("zone"), F.get(F.array(*[F.lit(c) for c in CATEGORIES]), (F.col("l_orderkey") % 5).cast("int")).alias("category"),
        amount.alias("total"), F.when((F.col("l_linenumber") % 3 != 0) & (F.col("l_suppkey") % 4 != 0), amount).alias("affected"),
    )


@query("A03", f"WITH {ZONE_STATS_SQL} {SUMMARY_SQL}")
def a03(spark, d):
    return coverage.zone_summary(_zone_stats(spark, d), ["zone"])


@query(
    "A04",
    f"""WITH {POINTS_SQL}, x AS (SELECT 'Z' || label AS zone, CASE WHEN label % 2 = 0 THEN CASE WHEN id % 5 = 0 THEN 'Sin grado' ELSE grade END ELSE 'Interrupciones/crisis' END AS grade FROM points
      UNION ALL SELECT 'Z' || label, 'Vías dañadas' FROM points)
    SELECT zone, grade, count(*) AS n FROM x GROUP BY ALL""",
)
def a04(spark, d):
    p = points(spark, d).withColumn("zone", F.concat(F.lit("Z"), F.col("label").cast("string")))
    pts = p.select("zone", F.when(F.col("label") % 2 == 0, "builtUpP").otherwise("ancillaryCrisisInfoP").alias("layer"), F.when(F.col("id") % 5 != 0, F.col("grade")).alias("grade"))
    return coverage.detections(pts, p)


def _vendor(spark, d):
    p = points(spark, d)
    code = F.when(F.col("id") % 6 == 0, None).when(F.col("id") % 6 == 1, "eq20260822col").otherwise("eq20260810col")
    return p.withColumn("grade", F.when(F.col("id") % 9 != 0, F.col("grade"))).withColumn("event_code", code).withColumn(
        "sensor_date", F.concat(F.lit("202608"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0"))
    )


@query(
    "A05",
    f"""WITH {POINTS_SQL}, v AS (SELECT place, CASE WHEN id % 9 <> 0 THEN grade END AS g, id FROM points WHERE place IS NOT NULL)
    SELECT place, count(*) AS buildings, count(*) FILTER (g IN ('Destroyed', 'Damaged')) AS observed, count(*) FILTER (g = 'Possibly damaged') AS possible,
      count(*) FILTER (id % 6 < 2) AS inconsistent_code, max('202608' || lpad(CAST(id % 28 + 1 AS VARCHAR), 2, '0')) AS last_image FROM v GROUP BY place""",
)
def a05(spark, d):
    return coverage.vendor_by_place(_vendor(spark, d), "EQ20260810COL")


@query(
    "A06",
    f"""WITH {POINTS_SQL} SELECT place, count(*) FILTER (grade <> 'Not Applicable') AS buildings, count(*) FILTER (grade = 'Not Applicable') AS without_grade, count(*) FILTER (grade = 'Destroyed') AS destroyed,
      count(*) FILTER (grade = 'Damaged') AS damaged, count(*) FILTER (grade = 'Possibly damaged') AS possible, (SELECT max(s_acctbal) FROM supplier WHERE 'P' || s_suppkey % 3 = place) AS area_km2
    FROM points WHERE place IS NOT NULL GROUP BY place""",
)
def a06(spark, d):
    products = table(spark, d, "supplier").select(F.concat(F.lit("P"), (F.col("s_suppkey") % 3).cast("string")).alias("place"), F.col("s_acctbal").alias("area_km2"))
    return coverage.graded_by_place(points(spark, d), products)


# ---------------------------------------------------------------- A08, A09, A10 - A13
@query(
    "A08",
    """WITH c AS (SELECT 'E' || user_id % 2 AS event_key, CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'view') AS press, count(DISTINCT user_id) AS sources FROM events WHERE event_type <> 'error' GROUP BY ALL),
    f AS (SELECT 'E' || user_id % 2 AS event_key, CAST(ts AS DATE) AS day, count(*) AS feeds FROM events WHERE event_type = 'error' GROUP BY ALL)
    SELECT coalesce(c.event_key, f.event_key) AS event_key, coalesce(c.day, f.day) AS day, press, sources, feeds FROM c FULL JOIN f ON c.event_key = f.event_key AND c.day = f.day""",
)
def a08(spark, d):
    events = table(spark, d, "events").select(F.concat(F.lit("E"), (F.col("user_id") % 2).cast("string")).alias("event_key"), F.to_date("ts").alias("day"), "event_type", "user_id")
    shown = events.filter("event_type <> 'error'").groupBy("event_key", "day").agg(
        F.count_if(F.col("event_type") == "view").alias("press"), F.count_distinct("user_id").alias("sources")
    )
    older = shown.select("event_key", "day", (F.col("press") - 1).alias("press"), F.lit(None).cast("bigint").alias("sources"))
    feeds = events.filter("event_type = 'error'").groupBy("event_key", "day").agg(F.count("*").alias("feeds"))
    return media.media_volume(shown.unionByName(older), feeds, ["press", "sources"])


@query("A08_daily", "SELECT CAST(ts AS DATE) AS day, count(*) AS items, count(DISTINCT user_id) AS sources FROM events GROUP BY 1")
def a08_daily(spark, d):
    return media.daily_items(table(spark, d, "events").select(F.to_date("ts").alias("day"), "user_id"), "day", "user_id")


@query(
    "A09",
    """WITH r AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1),
    c AS (SELECT CAST(unnest(generate_series(DATE '2023-12-28', DATE '2024-02-02', INTERVAL 1 DAY)) AS DATE) AS day)
    SELECT coalesce(c.day, r.day) AS day, coalesce(r.n, 0) AS n FROM c FULL JOIN r ON c.day = r.day""",
)
def a09(spark, d):
    return citizen.daily_reports(table(spark, d, "events"), F.to_date("ts"), "2023-12-28", "2024-02-03")


REBUILT_SQL = """rebuilt AS (SELECT 'E1' AS event_key, CAST(o_orderdate AS DATE) + 1 AS day, count(*) AS municipalities, CAST(sum(o_orderkey) AS BIGINT) AS families, CAST(sum(o_custkey) AS BIGINT) AS persons FROM orders GROUP BY ALL)"""
SERIES_SQL = "series AS (SELECT event_key, day, count(*) AS municipalities, CAST(sum(families) AS BIGINT) AS families, CAST(sum(persons) AS BIGINT) AS persons, false AS rebuilt FROM registry GROUP BY event_key, day)"


def _series(spark, d):
    daily = registry(spark, d)
    rebuilt = table(spark, d, "orders").groupBy(F.lit("E1").alias("event_key"), F.date_add(F.to_date("o_orderdate"), 1).alias("day")).agg(
        F.count("*").alias("municipalities"), F.sum("o_orderkey").alias("families"), F.sum("o_custkey").alias("persons")
    )
    return reg.registry_series(daily, rebuilt)


@query("A10", f"WITH {REGISTRY_SQL}, {SERIES_SQL}, {REBUILT_SQL} SELECT * FROM series UNION ALL SELECT *, true FROM rebuilt WHERE day NOT IN (SELECT day FROM series)")
def a10(spark, d):
    return _series(spark, d)


@query(
    "A11",
    f"""WITH {REGISTRY_SQL}, b AS (SELECT max(day) AS last, (SELECT max(day) FROM registry WHERE day < (SELECT max(day) FROM registry)) AS prior FROM registry),
    p AS (SELECT r.* FROM registry r, b WHERE day = prior), n AS (SELECT r.* FROM registry r, b WHERE day = last),
    pop AS (SELECT o_orderstatus AS department, nullif(o_orderpriority, '3-MEDIUM') AS municipality, count(*) AS population FROM orders GROUP BY ALL)
    SELECT n.event_key, n.department, n.municipality, n.day, n.families, n.persons, pop.population, CASE WHEN n.persons <> 0 THEN round(n.persons / CAST(pop.population AS DOUBLE) * 100, 4) END AS rate_pct,
      n.families - p.families AS delta_families, p.day IS NULL AS is_new FROM n LEFT JOIN p USING (department, municipality) LEFT JOIN pop USING (department, municipality)""",
)
def a11(spark, d):
    daily = registry(spark, d)
    population = table(spark, d, "orders").groupBy(
        F.col("o_orderstatus").alias("department"), F.nullif(F.col("o_orderpriority"), F.lit("3-MEDIUM")).alias("municipality")
    ).agg(F.count("*").alias("population"))
    return reg.registry_detail(daily, reg.registry_series(daily), population)


@query(
    "A12",
    """WITH e AS (SELECT 'E' || l_orderkey % 3 AS event_key, CAST(sum(CASE WHEN l_linenumber >= 4 THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS exposed FROM lineitem GROUP BY 1),
    c AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'E' || o_orderkey % 2 END AS event_key, CAST(sum(o_custkey) AS BIGINT) AS covered FROM orders GROUP BY 1)
    SELECT event_key, exposed, coalesce(covered, 0) AS covered, greatest(exposed - coalesce(covered, 0), 0) AS uncovered, round(CAST(100 * coalesce(covered, 0) AS DOUBLE) / exposed, 1) AS covered_pct FROM e LEFT JOIN c USING (event_key) WHERE exposed > 0""",
)
def a12(spark, d):
    exposure = table(spark, d, "lineitem").select(
        F.concat(F.lit("E"), (F.col("l_orderkey") % 3).cast("string")).alias("event_key"), F.col("l_linenumber").alias("intensity"), F.col("l_quantity").cast("bigint").alias("people")
    )
    covered = table(spark, d, "orders").select(
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("E"), (F.col("o_orderkey") % 2).cast("string"))).alias("event_key"), F.col("o_custkey").alias("population")
    )
    return reg.exposure_gap(exposure, covered, 4)


@query(
    "A13",
    """SELECT o_orderpriority AS source, count(*) AS records, min(day) AS since, max(day) AS until, CAST(DATE '2026-08-22' - max(day) AS INTEGER) AS silent_days
    FROM (SELECT o_orderpriority, CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_orderdate AS DATE) END AS day FROM orders) GROUP BY 1""",
)
def a13(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("source"), F.when(F.col("o_orderpriority") != "5-LOW", F.to_date("o_orderdate")).alias("day"))
    return reg.source_silence(rows, "source", "day", "2026-08-22")


# ---------------------------------------------------------------- A14 - A17, L02
LAYER_SQL = f"""pl AS (SELECT n_name AS municipality, r_name AS department, n_nationkey AS k, n_nationkey * 1000 AS population, n_nationkey % 8 = 7 AS homonym, n_nationkey % 5 = 0 AS needs_department FROM nation JOIN region ON n_regionkey = r_regionkey),
news AS (SELECT CASE WHEN c_nationkey % 3 <> 0 THEN c_nationkey END AS k, count(*) AS n_news FROM customer GROUP BY 1),
felt AS (SELECT CASE WHEN s_nationkey % 4 <> 1 THEN s_nationkey END AS k, max(s_suppkey % 9) AS felt_max_cdi, count(*) AS felt_cells, CAST(sum(s_suppkey) AS BIGINT) AS felt_responses FROM supplier GROUP BY 1),
rg AS (SELECT CASE WHEN c_nationkey % 7 <> 0 THEN c_nationkey END AS k, count(*) AS families, CAST(sum(c_custkey) AS BIGINT) AS persons FROM customer GROUP BY 1),
va AS (SELECT CASE WHEN c_nationkey % 6 = 1 THEN c_nationkey END AS k, count(*) AS b FROM customer GROUP BY 1), vb AS (SELECT CASE WHEN c_nationkey % 6 = 2 THEN c_nationkey END AS k, count(*) AS b FROM customer GROUP BY 1),
layer AS (SELECT municipality, department, population, needs_department, homonym, CASE WHEN homonym THEN NULL ELSE coalesce(n_news, 0) END AS n_news, felt_max_cdi, felt_responses, families, persons,
    va.b AS vendor_a_buildings, vb.b AS vendor_b_buildings, pl.k % 9 = 0 AS in_zone,
    CASE WHEN pl.k % 9 = 0 THEN 'en_aoi' WHEN va.b > 0 THEN 'evaluado_unosat' WHEN vb.b > 0 THEN 'evaluado_satelite' WHEN felt_max_cdi >= 6 THEN 'intensidad_alta' WHEN n_news > 0 THEN 'mencion_prensa' WHEN rg.k IS NOT NULL THEN 'solo_rud' ELSE 'fuera_aoi' END AS state,
    pl.k % 2 = 0 AS own_search, concat_ws(',', CASE WHEN n_news > 0 THEN 'prensa' END, CASE WHEN felt_max_cdi IS NOT NULL THEN 'dyfi' END, CASE WHEN rg.k IS NOT NULL THEN 'rud' END, CASE WHEN va.b > 0 THEN 'unosat' END, CASE WHEN vb.b > 0 THEN 'sertit' END) AS sources,
    CASE WHEN persons <> 0 AND population <> 0 THEN round(CAST(persons AS DOUBLE) / population * 100, 4) END AS rate_pct
  FROM pl LEFT JOIN news USING (k) LEFT JOIN felt USING (k) LEFT JOIN rg ON rg.k = pl.k LEFT JOIN va ON va.k = pl.k LEFT JOIN vb ON vb.k = pl.k
  WHERE n_news > 0 OR felt_max_cdi IS NOT NULL OR rg.k IS NOT NULL OR va.b > 0 OR vb.b > 0)"""


def _layer(spark, d):
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    places = nation.select(
        F.col("n_name").alias("municipality"), F.col("r_name").alias("department"), (k * 1000).alias("population"), (k % 8 == 7).alias("homonym"),
        (k % 5 == 0).alias("needs_department"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), k.alias("k"),
    )
    name = places.select("k", "municipality")

    def per(source: str, key: str, condition, *aggs):
        rows = table(spark, d, source).groupBy(F.when(condition, F.col(key)).alias("k")).agg(*aggs)
        return rows.join(name, "k").drop("k")

    c, s = F.col("c_nationkey"), F.col("s_nationkey")
    number = F.count("*")
    return influence.influence_layer(
        places.drop("k"), per("customer", "c_nationkey", c % 3 != 0, number.alias("n_news")),
        per("supplier", "s_nationkey", s % 4 != 1, F.max(F.col("s_suppkey") % 9).alias("felt_max_cdi"), number.alias("felt_cells"), F.sum("s_suppkey").alias("felt_responses")),
        per("customer", "c_nationkey", c % 7 != 0, number.alias("families"), F.sum("c_custkey").alias("persons")),
        per("customer", "c_nationkey", c % 6 == 1, number.alias("buildings")), per("customer", "c_nationkey", c % 6 == 2, number.alias("buildings")),
        name.filter("k % 9 = 0"), name.filter("k % 2 = 0"),
    )


@query("A14", f"WITH {LAYER_SQL} SELECT * FROM layer")
def a14(spark, d):
    return _layer(spark, d).withColumn("sources", F.array_join("sources", ",")).drop("lat", "lon")


@query(
    "A15",
    f"""WITH {LAYER_SQL}, r AS (SELECT *, coalesce(n_news = 0, false) AS mute, coalesce(n_news = 0, false) AND NOT needs_department AND NOT homonym AND own_search AS certain FROM layer WHERE persons > 0)
    SELECT count(*) FILTER (mute) AS mute, CAST(coalesce(sum(persons) FILTER (mute), 0) AS BIGINT) AS people, count(*) FILTER (certain) AS certain, CAST(coalesce(sum(persons) FILTER (certain), 0) AS BIGINT) AS people_certain,
      count(*) FILTER (mute AND NOT certain) AS doubtful, count(*) FILTER (mute AND NOT certain AND NOT own_search) AS unsearched, count(*) FILTER (n_news IS NULL AND homonym) AS unattributable,
      CAST(coalesce(sum(persons) FILTER (n_news IS NULL AND homonym), 0) AS BIGINT) AS people_unattributable, arg_min(municipality, row(-rate_pct, -persons, municipality)) FILTER (certain) AS top_place, max(rate_pct) FILTER (certain) AS top_rate_pct FROM r HAVING count(*) FILTER (mute) > 0""",
)
def a15(spark, d):
    return coverage.press_silence(_layer(spark, d))


EVIDENCE_SQL = f"""{TOWN_SQL}, {LOCATED_SQL}, {UNITS_SQL}, n AS (SELECT place, count(*) FILTER (source = 's0') AS n_satellite, count(*) FILTER (source = 's1' AND label < 5) AS n_citizen, count(*) FILTER (source = 's2' AND label > 5) AS n_vendor_a, count(*) FILTER (label = 6) AS n_vendor_b FROM points WHERE place IS NOT NULL GROUP BY place),
ev AS (SELECT n.*, coalesce(units, greatest(n_satellite, n_vendor_a, n_vendor_b)) AS n_evaluated FROM n LEFT JOIN solved USING (place) WHERE n_satellite + n_citizen + n_vendor_a + n_vendor_b > 0)"""


def _evidence(spark, d):
    p = points(spark, d).filter("place IS NOT NULL")

    def n(condition: str):
        return p.filter(condition).groupBy("place").agg(F.count("*").alias("n"))

    units = resolved_units(spark, d)
    return coverage.point_evidence(n("source = 's0'"), n("source = 's1' AND label < 5"), n("source = 's2' AND label > 5"), n("label = 6"), units)


@query("A16", f"WITH {EVIDENCE_SQL} SELECT * FROM ev")
def a16(spark, d):
    return _evidence(spark, d)


@query("A16_looked", f"WITH {EVIDENCE_SQL} SELECT count(*) FILTER (n_evaluated > 0) AS by_satellite, count(*) FILTER (n_citizen > 0) AS by_citizens FROM ev")
def a16_looked(spark, d):
    return coverage.looked_at(_evidence(spark, d))


@query("A17", f"WITH {ZONE_STATS_SQL}, s AS ({SUMMARY_SQL}) SELECT zone FROM s WHERE coalesce(affected_buildings, 0) > 0 AND zone % 3 <> 0")
def a17(spark, d):
    summary = coverage.zone_summary(_zone_stats(spark, d), ["zone"]).withColumn("n_official", F.when(F.col("zone") % 3 == 0, 2))
    return coverage.unregistered_zones(summary)


# ---------------------------------------------------------------- A20, A21
@query(
    "A20",
    f"""WITH {REGISTRY_SQL}, {POINTS_SQL}, {CENTRES_SQL},
    s AS (SELECT 'P' || department AS place, day, CAST(sum(families) AS BIGINT) AS families FROM registry GROUP BY ALL),
    g AS (SELECT place, count(*) AS n_days, arg_min(families, day) AS first_families, arg_max(families, day) AS last_families FROM s GROUP BY place),
    r AS (SELECT place, count(*) AS n_reports, count(*) FILTER (id % 2 = 0) AS n_with_media FROM points WHERE place IS NOT NULL GROUP BY place),
    w AS (SELECT 'P' || o_orderstatus AS place, count(*) AS n_news, count(DISTINCT o_orderpriority) AS n_outlets FROM orders GROUP BY 1),
    z AS (SELECT p.place, c.place AS zone, {haversine_sql("p.lat", "p.lon", "c.plat", "c.plon")} AS km FROM (SELECT 'P' || id AS place, lon, lat FROM points) p, centres c),
    nz AS (SELECT place, arg_min(zone, km) AS nearest_zone, round(min(km), 6) AS nearest_km FROM z WHERE km < 90 GROUP BY place)
    SELECT place, n_days, first_families, last_families, CASE WHEN n_days > 1 AND first_families <> 0 THEN last_families - first_families END AS delta,
      CASE WHEN n_days > 1 AND first_families <> 0 THEN round(CAST(last_families - first_families AS DOUBLE) / first_families * 100, 4) END AS delta_pct, n_reports, n_with_media, n_news, n_outlets, nearest_zone, nearest_km
    FROM g FULL JOIN r USING (place) FULL JOIN w USING (place) FULL JOIN nz USING (place)""",
)
def a20(spark, d):
    daily = registry(spark, d).groupBy(F.concat(F.lit("P"), "department").alias("place"), "day").agg(F.sum("families").alias("families"))
    p = points(spark, d)
    reports = p.filter("place IS NOT NULL").select("place", (F.col("id") % 2 == 0).alias("has_media"))
    news = table(spark, d, "orders").select(F.concat(F.lit("P"), "o_orderstatus").alias("place"), F.col("o_orderpriority").alias("outlet"))
    spots = p.select(F.concat(F.lit("P"), F.col("id").cast("string")).alias("spot"), "lon", "lat")
    near = spatial.nearest_within(spots, "spot", "lon", "lat", centres(spark, d), "place", "plon", "plat", 90.0).select(
        F.col("spot").alias("place"), F.col("place").alias("zone"), "km"
    )
    return coverage.place_profile(daily, reports, news, near).withColumn("nearest_km", F.round("nearest_km", 6))


@query(
    "A21",
    f"""WITH {POINTS_SQL}, l AS (SELECT place, 'Z' || label AS zone, (['mapper','vendor','citizen'])[label % 3 + 1] AS layer FROM points WHERE place IS NOT NULL)
    SELECT place, count(*) FILTER (layer = 'mapper') AS mapper, count(*) FILTER (layer = 'vendor') AS vendor, count(*) FILTER (layer = 'citizen') AS citizen, count(*) FILTER (layer <> 'citizen') AS satellite, count(*) AS total,
      coalesce(string_agg(DISTINCT CASE WHEN layer = 'mapper' THEN zone END, ',' ORDER BY CASE WHEN layer = 'mapper' THEN zone END), '') AS zones FROM l GROUP BY place""",
)
def a21(spark, d):
    p = points(spark, d).withColumn("zone", F.concat(F.lit("Z"), F.col("label").cast("string")))
    names = ["mapper", "vendor", "citizen"]
    bundle = coverage.evidence_layers({n: p.filter(F.col("label") % 3 == i) for i, n in enumerate(names)})
    return coverage.evidence_counts(bundle, names)


@query("A22", "SELECT event_id, event_type FROM events WHERE event_type LIKE '%sig%' AND user_id % 3 <> 0")
def a22(spark, d):
    events = table(spark, d, "events").withColumn("lat", F.when(F.col("user_id") % 3 != 0, F.col("value"))).withColumn("lon", F.col("value"))
    return reg.historic_events(events, "event_type", "SIG").select("event_id", "event_type")


# ---------------------------------------------------------------- A23 - A27
@query(
    "A23",
    """SELECT 'reportes_ciudadanos' AS kind, 'info' AS level, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-29' AND event_type = 'signup' UNION ALL
    SELECT 'titulares_nuevos', 'info', count(*) FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-30' AND event_type = 'view' UNION ALL
    SELECT 'sertit_sin_vectores', 'alta', count(*) FROM part WHERE p_size % 10 = 0 UNION ALL
    SELECT 'rud_actualizado', 'info', count(*) FILTER (o_orderkey % 2 = 0) - count(*) FILTER (o_orderkey % 3 = 1) FROM orders UNION ALL
    SELECT 'fuente_oficial_actualizada', 'alta', CAST(max(CAST(o_orderdate AS DATE)) - DATE '1970-01-01' AS BIGINT) FROM orders""",
)
def a23(spark, d):
    events, orders = table(spark, d, "events"), table(spark, d, "orders")
    both = orders.select("o_orderkey", F.lit(1).alias("families"))
    grown = alerts.registry_alert(both.filter("o_orderkey % 2 = 0"), both.filter("o_orderkey % 3 = 1"))
    woke = alerts.awakened_source(orders.select(F.to_date("o_orderdate").alias("day")), "day", "1999-01-01")
    rows = alerts.count_alert(events, (F.col("ts") >= F.lit("2024-01-29").cast("timestamp_ntz")) & (F.col("event_type") == "signup"), "reportes_ciudadanos", "info")
    rows = rows.unionByName(alerts.count_alert(events, (F.to_date("ts") == F.lit("2024-01-30").cast("date")) & (F.col("event_type") == "view"), "titulares_nuevos", "info"))
    rows = rows.unionByName(alerts.count_alert(table(spark, d, "part"), F.col("p_size") % 10 == 0, "sertit_sin_vectores", "alta"))
    rows = rows.unionByName(grown.select("kind", "level", F.col("d_municipalities").alias("n")))
    return rows.unionByName(woke.select("kind", "level", F.unix_date("max_day").cast("bigint").alias("n")))


@query(
    "A24",
    """WITH c AS (SELECT p_brand AS brand, p_partkey + 2 * (p_partkey // 5) AS n FROM part),
    g AS (SELECT brand, n, lead(n) OVER (PARTITION BY brand ORDER BY n) AS nx FROM c)
    SELECT brand, n + 1 AS first_missing, nx - 1 AS last_missing, nx - n - 1 AS run_length FROM g WHERE nx - n > 1""",
)
def a24(spark, d):
    codes = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.expr("p_partkey + 2 * (p_partkey DIV 5)").alias("n"))
    return alerts.missing_codes(codes, ["brand"], "n")


@query("A24_new", "SELECT s_suppkey AS code FROM supplier WHERE s_suppkey % 2 = 0 AND s_nationkey % 4 = 0 AND s_suppkey % 3 <> 0")
def a24_new(spark, d):
    k = F.col("s_suppkey")
    after = table(spark, d, "supplier").select(
        k.alias("code"), (k % 2 == 0).alias("exists_public"), F.array(F.concat(F.lit("C"), (F.col("s_nationkey") % 4).cast("string")), F.lit("X")).alias("countries")
    )
    before = after.select("code", (F.col("code") % 3 == 0).alias("exists_public"))
    return alerts.new_activations(before, alerts.public_index(after), "C0").select("code")


@query(
    "A26",
    """WITH a AS (SELECT CAST(ts AS DATE) AS day, CASE event_type WHEN 'error' THEN 'rud_actualizado' ELSE event_type END AS kind, count(*) AS n, min(event_id) AS position FROM events GROUP BY 1, 2),
    n AS (SELECT *, CASE WHEN n % 3 = 0 THEN 'alta' ELSE 'info' END AS level, n || ' avisos' AS text FROM a WHERE n % 3 = 0 OR kind IN ('rud_actualizado', 'balance_en_medios')),
    p AS (SELECT day, count(*) AS n_alerts, '[' || string_agg('["' || kind || '","' || text || '"]', ',' ORDER BY position) || ']' AS payload, list(CASE WHEN level = 'alta' THEN '⚠️ ' ELSE '' END || text ORDER BY position) AS lines FROM n GROUP BY day)
    SELECT day, n_alerts, sha256(payload) AS payload_sha, substring(array_to_string(lines[1:2], chr(10)) || CASE WHEN n_alerts > 2 THEN chr(10) || '… y ' || (n_alerts - 2) || ' más' ELSE '' END, 1, 500) AS body FROM p""",
)
def a26(spark, d):
    fired = table(spark, d, "events").groupBy(
        F.to_date("ts").alias("day"), F.when(F.col("event_type") == "error", "rud_actualizado").otherwise(F.col("event_type")).alias("kind")
    ).agg(F.count("*").alias("n"), F.min("event_id").alias("position"))
    rows = fired.select("day", "position", "kind", F.when(F.col("n") % 3 == 0, "alta").otherwise("info").alias("level"), F.concat(F.col("n").cast("string"), F.lit(" avisos")).alias("text"))
    return alerts.digest(rows, "day", 2)


@query(
    "A27",
    """WITH f AS (SELECT DISTINCT source AS feed, CASE WHEN source = 'src3' THEN 'HTTP 503' END AS error FROM documents UNION ALL SELECT 'silent', NULL),
    i AS (SELECT source AS feed, count(*) AS items, count(*) FILTER (lang = 'en') AS kept FROM documents GROUP BY 1)
    SELECT feed, error, CASE WHEN error IS NULL THEN coalesce(items, 0) END AS items, CASE WHEN error IS NULL THEN coalesce(kept, 0) END AS kept FROM f LEFT JOIN i USING (feed)""",
)
def a27(spark, d):
    docs = table(spark, d, "documents").withColumnRenamed("source", "feed")
    silent = docs.sparkSession.range(1).select(F.lit("silent").alias("feed"))
    registered = docs.select("feed").distinct().unionByName(silent).withColumn("error", F.when(F.col("feed") == "src3", "HTTP 503"))
    return media.ingest_summary(docs.select("feed", (F.col("lang") == "en").alias("relevant")), registered)


# ---------------------------------------------------------------- A28, A30, A32 - A34
@query(
    "A28",
    """SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source
    UNION ALL SELECT 'tags', v, count(*) FROM (SELECT DISTINCT doc_id, unnest(['t' || doc_id % 3, 't' || doc_id % 4]) AS v FROM documents) GROUP BY v""",
)
def a28(spark, d):
    k = F.col("doc_id")
    tags = F.array(F.concat(F.lit("t"), (k % 3).cast("string")), F.concat(F.lit("t"), (k % 4).cast("string")))
    return media.facet_counts(table(spark, d, "documents").withColumn("tags", tags), ["tags"], ["lang", "source"])


@query("A28_search", "SELECT doc_id FROM documents WHERE contains(lower(strip_accents(text || ' ' || source)), 'thouou') AND lang = 'en' AND doc_id % 2 = 0 AND n_chars > 500")
def a28_search(spark, d):
    rows = table(spark, d, "documents").withColumn("tags", F.array(F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd"))).withColumn("long", F.col("n_chars") > 500)
    return media.search(rows, "THÓUOU", ["text", "source"], {"lang": "en"}, {"tags": "even"}, ["long"]).select("doc_id")


@query(
    "A30",
    f"""WITH {CAPTURES_SQL}, {POINTS_SQL}, {REGISTRY_SQL}, m AS (SELECT event_key, since AS day, value FROM (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY day DESC) AS rn FROM series WHERE metric = 'familias_afectadas') WHERE rn = 1)
    SELECT 'E1' AS event_key, 'satellite' AS card, DATE '2026-08-22' AS day, count(*) AS value FROM points UNION ALL
    SELECT event_key, 'registry', day, CAST(sum(families) AS BIGINT) FROM registry WHERE day = (SELECT max(day) FROM registry) GROUP BY ALL UNION ALL SELECT event_key, 'media', day, value FROM m UNION ALL
    SELECT 'E1', 'citizen', max(CAST(ts AS DATE)), count(*) FROM events""",
)
def a30(spark, d):
    rows = captures(spark, d)
    series = consensus.daily_series(rows, consensus.accepted_values(consensus.candidates(consensus.with_order(rows))))
    last = series.filter("metric = 'familias_afectadas'").groupBy("event_key").agg(F.max_by(F.struct("since", "value"), "day").alias("l")).select("event_key", F.col("l.since").alias("day"), F.col("l.value").alias("value"))
    key = F.lit("E1").alias("event_key")
    satellite = points(spark, d).agg(F.count("*").alias("value")).select(key, F.lit("2026-08-22").cast("date").alias("day"), "value")
    official = snapshots.latest_snapshot(registry(spark, d), "day").groupBy("event_key", "day").agg(F.sum("families").alias("value"))
    people = table(spark, d, "events").agg(F.to_date(F.max("ts")).alias("day"), F.count("*").alias("value")).select(key, "day", "value")
    return media.source_cards(satellite, official, last, people)


@query(
    "A32",
    """SELECT o_orderpriority AS zone, CAST(o_orderdate AS DATE) AS delivered, o_orderstatus AS ptype, o_custkey AS version FROM orders WHERE CAST(o_orderdate AS DATE) = (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) AND o_orderpriority <> '5-LOW'""",
)
def a32(spark, d):
    rows = table(spark, d, "orders").select(
        F.to_date("o_orderdate").alias("snapshot_date"), F.col("o_orderpriority").alias("zone"), F.when(F.col("o_orderpriority") != "5-LOW", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm")).alias("delivery_time"),
        F.col("o_orderstatus").alias("ptype"), F.col("o_custkey").alias("version"),
    )
    return coverage.deliveries(rows)


@query("A33", f"WITH {LAYER_SQL} SELECT municipality, (coalesce(families, 0) > 0 OR coalesce(n_news, 0) > 0 OR coalesce(felt_responses, 0) > 0 OR in_zone) AS eligible FROM layer")
def a33(spark, d):
    signals = [F.col("families") > 0, F.col("n_news") > 0, F.col("felt_responses") > 0, F.col("in_zone")]
    return _layer(spark, d).select("municipality", coverage.has_signal(*signals).alias("eligible"))


@query(
    "A34",
    """WITH e AS (SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 'z' END AS zone, CASE WHEN user_id % 3 <> 0 THEN user_id % 20 END AS sha FROM events),
    f AS (SELECT *, min(event_id) OVER (PARTITION BY sha) AS first FROM e) SELECT count(*) AS reports, count(zone) AS in_zone, count(*) FILTER (sha IS NOT NULL AND first <> event_id) AS duplicates FROM f""",
)
def a34(spark, d):
    u = F.col("user_id")
    rows = table(spark, d, "events").select("event_id", "ts", F.when(u % 4 == 0, "z").alias("zone"), F.when(u % 3 != 0, (u % 20).cast("string")).alias("sha"))
    return citizen.citizen_totals(citizen.duplicate_media(rows, "event_id", "sha", "event_id"))


# ---------------------------------------------------------------- A29
@query(
    "A29",
    """WITH v AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'view') AS press, count(*) FILTER (event_type = 'click') AS citizen FROM events GROUP BY 1),
    p AS (SELECT (SELECT day FROM v ORDER BY press DESC, day LIMIT 1) AS pd, (SELECT day FROM v ORDER BY citizen DESC, day LIMIT 1) AS cd)
    SELECT 'attention_decays' AS hypothesis, arg_min(press, day) > arg_max(press, day) * 2 AS holds FROM v UNION ALL SELECT 'citizen_peak_later', cd > pd FROM p UNION ALL
    SELECT 'deliveries_in_low_attention', count(*) FILTER (press < (SELECT max(press) FROM v) * 0.8) > 0 FROM v WHERE day IN (SELECT CAST(ts AS DATE) FROM events WHERE event_type = 'purchase') UNION ALL
    SELECT 'no_match_without_official', (SELECT count(*) FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0)) = 0 UNION ALL
    SELECT 'hashes_present', count(*) FILTER (n_chars % 5 = 0) = 0 FROM documents UNION ALL SELECT 'no_exact_coordinate', count(*) = 0 FROM embeddings WHERE vec_id % 100 = 0 AND abs(CAST(embedding[2] AS DOUBLE) - round(CAST(embedding[2] AS DOUBLE), 3)) > 1e-9 UNION ALL
    SELECT 'coverage_within_bounds', count(*) FILTER (l_discount * 1000 > 100) = 0 FROM lineitem""",
)
def a29(spark, d):
    events = table(spark, d, "events")
    volume = events.groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "view").alias("press"), F.count_if(F.col("event_type") == "click").alias("citizen"))
    delivered = events.filter("event_type = 'purchase'").select(F.to_date("ts").alias("day")).distinct()
    states = table(spark, d, "nation").select(F.col("n_nationkey").alias("zone"), F.when(F.col("n_nationkey") % 2 == 0, "coincide").otherwise("prensa").alias("state"))
    evidence = table(spark, d, "supplier").select(F.col("s_nationkey").alias("zone"), F.when(F.col("s_suppkey") % 3 == 0, "oficial").otherwise("prensa").alias("kind"))
    log = table(spark, d, "documents").select(F.lit(200).alias("status"), F.when(F.col("n_chars") % 5 != 0, F.md5(F.col("text").cast("binary"))).alias("sha256"))
    p = points(spark, d)
    published = p.select(F.when(F.col("id") % 100 == 0, F.col("lat")).otherwise(F.round("lat", 3)).alias("lat"), F.when(F.col("id") % 100 == 0, F.col("lon")).otherwise(F.round("lon", 3)).alias("lon"))
    covered = table(spark, d, "lineitem").select((F.col("l_discount") * 1000).alias("covered_pct"))
    parts = [
        quality.attention_decays(volume), quality.citizen_peak_later(volume), quality.deliveries_in_low_attention(volume, delivered, 0.8),
        quality.no_match_without_official(states, evidence), quality.hashes_present(log), quality.no_exact_coordinate(p, published), quality.coverage_within_bounds(covered),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "P39",
    """WITH v AS (SELECT CASE event_id % 4 WHEN 0 THEN 'EQ20260822COL' WHEN 1 THEN 'eq20260812col' WHEN 2 THEN 'RAROSINFECHA' END AS event_code, event_type AS layer, CASE WHEN user_id % 3 <> 0 THEN '202608' || lpad(CAST(user_id % 20 + 11 AS VARCHAR), 2, '0') END AS sensor_date FROM events),
    g AS (SELECT event_code, layer, min(sensor_date) AS s, count(*) AS n FROM v WHERE event_code IS NOT NULL AND event_code <> 'RAROSINFECHA' GROUP BY ALL),
    c AS (SELECT *, '2026-08-' || substr(event_code, 9, 2) AS code_day, '2026-08-' || substr(s, 7, 2) AS image_day FROM g)
    SELECT event_code, layer, n, code_day, image_day, CASE WHEN code_day > '2026-08-20' THEN 'future' ELSE 'after_image' END AS reason FROM c WHERE code_day > '2026-08-20' OR code_day > image_day""",
)
def p39(spark, d):
    k, u = F.col("event_id") % 4, F.col("user_id")
    rows = table(spark, d, "events").select(
        F.when(k == 0, "EQ20260822COL").when(k == 1, "eq20260812col").when(k == 2, "RAROSINFECHA").alias("event_code"), F.col("event_type").alias("layer"),
        F.when(u % 3 != 0, F.concat(F.lit("202608"), F.lpad((u % 20 + 11).cast("string"), 2, "0"))).alias("sensor_date"),
    )
    return alerts.impossible_codes(rows, "2026-08-20")


# ---------------------------------------------------------------- K04: the whole slice, points to published rows
@query(
    "K04",
    f"""WITH {CROSS_SQL}, s AS (SELECT nullif(o_orderpriority, '3-MEDIUM') AS zone, count(*) AS population, CAST(sum(o_custkey) FILTER (o_orderstatus = 'F') AS BIGINT) AS affected_buildings FROM orders GROUP BY 1),
    c AS (SELECT *, {STATE_SQL} AS state FROM cross_check)
    SELECT zone AS aoi, state AS estado, CASE state {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in coverage.STATE_LABELS.items())} END AS etiqueta, population AS poblacion, affected_buildings AS edificios_afectados,
      CAST(NULL AS DOUBLE) AS vias_afectadas_km, CAST(NULL AS BIGINT) AS interrupciones_viales, n_press AS n_prensa, n_citizen AS n_ciudadano, n_official AS n_oficial, CAST(NULL AS VARCHAR) AS entrega_producto, 'EMS + news + citizens' AS fuente
    FROM c LEFT JOIN s USING (zone)""",
)
def k04(spark, d):
    orders = table(spark, d, "orders").withColumn("zone", F.col("o_orderpriority"))
    summary = orders.groupBy(F.nullif(F.col("zone"), F.lit("3-MEDIUM")).alias("zone")).agg(
        F.count("*").alias("population"), F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_custkey"))).alias("affected_buildings"),
        F.lit(None).cast("double").alias("affected_roads_km"), F.lit(None).cast("bigint").alias("road_interruptions"),
    )
    delivered = orders.select("zone").distinct().withColumn("delivery_time", F.lit(None).cast("string"))
    return sinks.crosscheck_rows(_cross(spark, d), summary, delivered, "EMS + news + citizens")


@query(
    "L02",
    f"""WITH {LAYER_SQL} SELECT municipality, state,
      row_number() OVER (ORDER BY in_zone DESC, coalesce(vendor_a_buildings, 0) DESC, coalesce(felt_max_cdi, 0) DESC, coalesce(n_news, 0) DESC, municipality) AS position FROM layer""",
)
def l02(spark, d):
    return positioned(influence.display_order(_layer(spark, d))).select("municipality", "state", "position")


