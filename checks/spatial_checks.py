"""Geometry, spatial joins and building counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import (
    CENTRES_SQL, POINTS_SQL, ZONES_SQL, centres, haversine_sql, points, query, table, zones,
)
from tremorlens.functions import geo
from tremorlens.operators import buildings, spatial

METRES = 20.0
# The points of a town: the same layout two hundred times smaller, so that the operator's own threshold fits it.
SHRINK = 200
TOWN_SQL = POINTS_SQL.replace("CAST(embedding[1] AS DOUBLE) AS lon", f"CAST(embedding[1] AS DOUBLE) / {SHRINK} AS lon").replace("CAST(embedding[2] AS DOUBLE) AS lat", f"CAST(embedding[2] AS DOUBLE) / {SHRINK} AS lat")
KM = 25.0


def town(spark, d):
    return points(spark, d).withColumns({c: F.col(c) / SHRINK for c in ("lon", "lat")})


@query("P13", f"WITH {POINTS_SQL} SELECT id, round(lon, 3) + 0.0::DOUBLE AS lon_pub, round(lat, 3) + 0.0::DOUBLE AS lat_pub FROM points")
def p13(spark, d):
    return points(spark, d).select(
        "id", geo.public_coordinate(F.col("lon")).alias("lon_pub"), geo.public_coordinate(F.col("lat")).alias("lat_pub")
    )


@query(
    "P30",
    f"""WITH {POINTS_SQL}, {ZONES_SQL}
    SELECT zone, CAST(max(ring) + 1 AS INTEGER) AS n_rings, CAST(count(*) AS INTEGER) AS n_corners, min(xi) AS x0, max(xi) AS x1,
      min(yi) AS y0, max(yi) AS y1 FROM edges GROUP BY zone""",
)
def p30(spark, d):
    rings = zones(spark, d).withColumn("r", geo.wkt_rings(F.col("wkt")))
    box = geo.ring_bounds(F.col("r")[0])
    return rings.select(
        "zone", F.size("r").alias("n_rings"), F.aggregate("r", F.lit(0), lambda n, r: n + F.size(r)).alias("n_corners"),
        box["x0"].alias("x0"), box["x1"].alias("x1"), box["y0"].alias("y0"), box["y1"].alias("y1"),
    )


@query(
    "P31",
    f"WITH {POINTS_SQL}, {ZONES_SQL} SELECT p.id, (i.id IS NOT NULL) AS inside FROM points p LEFT JOIN inside i ON i.id = p.id AND i.zone = 'NATION_12'",
)
def p31(spark, d):
    from tremorlens.plans.joins import with_scalar

    one = zones(spark, d).filter("zone = 'NATION_12'").agg(F.first(geo.wkt_rings(F.col("wkt"))).alias("rings"))
    return with_scalar(points(spark, d), one).select(
        "id", geo.polygon_contains(F.col("lon"), F.col("lat"), F.col("rings")).alias("inside")
    )


@query(
    "P32",
    f"""WITH {POINTS_SQL} SELECT id, round({haversine_sql("lat", "lon", "0.1", "0.2")}, 6) AS km,
      round(sqrt(pow((lon - 0.2) * 111320.0 * cos(radians((lat + 0.1) / 2)), 2) + pow((lat - 0.1) * 110570.0, 2)), 4) AS metres FROM points""",
)
def p32(spark, d):
    lon, lat, x, y = F.col("lon"), F.col("lat"), F.lit(0.2), F.lit(0.1)
    return points(spark, d).select(
        "id", F.round(geo.haversine_km(lat, lon, y, x), 6).alias("km"), F.round(geo.plane_m(lon, lat, x, y), 4).alias("metres")
    )


GRID = {"x0": -0.3, "x1": 0.3, "nx": 50, "y0": -0.25, "y1": 0.25, "ny": 40}


def grid(spark, d):
    """A 50 x 40 grid over the box: parts supply the values, later parts win a cell."""
    part = table(spark, d, "part")
    return part.groupBy(F.pmod("p_partkey", F.lit(50)).alias("ix"), F.pmod(F.floor(F.col("p_partkey") / 50), F.lit(40)).alias("iy")).agg(
        F.max_by("p_retailprice", "p_partkey").alias("value")
    )


# The value of the nearest cell for every row of ``points``.
GRID_SQL = """grid_cells AS (SELECT p_partkey % 50 AS ix, (p_partkey // 50) % 40 AS iy, arg_max(p_retailprice, p_partkey) AS value FROM part GROUP BY ALL),
    grid_spots AS (SELECT id, round_even((lon + 0.3) / 0.6 * 49, 0) AS fx, round_even((lat + 0.25) / 0.5 * 39, 0) AS fy FROM points),
    felt AS (SELECT id, c.value AS intensity FROM grid_spots LEFT JOIN grid_cells c ON fx BETWEEN 0 AND 49 AND fy BETWEEN 0 AND 39 AND c.ix = fx AND c.iy = fy)"""


@query("P33", f"WITH {POINTS_SQL}, {GRID_SQL} SELECT id, intensity FROM felt")
def p33(spark, d):
    return spatial.grid_value(points(spark, d), F.col("lon"), F.col("lat"), GRID, grid(spark, d), "intensity").select("id", "intensity")


@query("J05", f"WITH {POINTS_SQL}, {ZONES_SQL} SELECT p.id, h.zone FROM points p LEFT JOIN hit h USING (id)")
def j05(spark, d):
    return spatial.containing_zone(points(spark, d), "id", "lon", "lat", zones(spark, d), "zone", "wkt").select("id", "zone")


@query("J06", f"WITH {POINTS_SQL}, {ZONES_SQL} SELECT id FROM hit")
def j06(spark, d):
    return spatial.in_any_zone(points(spark, d), "id", "lon", "lat", zones(spark, d), "zone", "wkt").select("id")


@query(
    "J07",
    f"""WITH {POINTS_SQL}, {CENTRES_SQL},
    p AS (SELECT id, lon, lat, CASE WHEN label = 3 THEN 'NATION_7' WHEN label = 4 THEN 'nowhere' END AS declared FROM points),
    c AS (SELECT id, place, {haversine_sql("lat", "lon", "plat", "plon")} AS km FROM p, centres),
    n AS (SELECT id, place, row_number() OVER (PARTITION BY id ORDER BY km, place) AS rn FROM c WHERE km <= {KM})
    SELECT p.id, coalesce(k.place, n.place) AS place FROM p LEFT JOIN centres k ON k.place = p.declared LEFT JOIN n ON n.id = p.id AND n.rn = 1""",
)
def j07(spark, d):
    label = F.col("label")
    rows = points(spark, d).drop("place").withColumn("declared", F.when(label == 3, "NATION_7").when(label == 4, "nowhere"))
    return spatial.nearest_place(rows, "id", "lon", "lat", "declared", centres(spark, d), "place", "plon", "plat", KM).select("id", "place")


@query(
    "J08",
    f"""WITH {POINTS_SQL}, {CENTRES_SQL} SELECT id, c.place, round({haversine_sql("lat", "lon", "plat", "plon")}, 6) AS km
    FROM points, centres c WHERE {haversine_sql("lat", "lon", "plat", "plon")} < 12""",
)
def j08(spark, d):
    out = spatial.within_radius(points(spark, d).drop("place"), "id", "lon", "lat", centres(spark, d), "place", "plon", "plat", 12.0)
    return out.select("id", "place", F.round("km", 6).alias("km"))


def _edge_sql(metres: float) -> str:
    return (
        f"pow((a.lon - b.lon) * 111320.0 * cos(radians((a.lat + b.lat) / 2)), 2) + pow((a.lat - b.lat) * 110570.0, 2) < pow({metres}, 2)"
    )


_UNIT = "STRUCT(s VARCHAR, x DOUBLE, y DOUBLE, g VARCHAR)[][]"
_FITS = (
    "list_transform(a.units, lambda m: NOT list_contains(list_transform(m, lambda q: q.s), p.s) AND len(list_filter(m, lambda q: "
    f"pow((q.x - p.x) * 111320.0 * cos(radians((q.y + p.y) / 2)), 2) + pow((q.y - p.y) * 110570.0, 2) < pow({METRES}, 2))) > 0)"
)
UNITS_SQL = f"""seq AS (
  SELECT place, list({{'s': source, 'x': lon, 'y': lat, 'g': lower(grade), 'units': CAST([] AS {_UNIT})}} ORDER BY source, lon, lat, lower(grade)) AS xs FROM located GROUP BY place),
walked AS (
  SELECT place, list_reduce(list_prepend({{'s': '', 'x': 0.0::DOUBLE, 'y': 0.0::DOUBLE, 'g': '', 'units': CAST([] AS {_UNIT})}}, xs), lambda a, p:
    {{'s': p.s, 'x': p.x, 'y': p.y, 'g': p.g, 'units': CASE WHEN coalesce(list_position({_FITS}, true), 0) = 0
        THEN list_append(a.units, [{{'s': p.s, 'x': p.x, 'y': p.y, 'g': p.g}}])
        ELSE list_concat(list_concat(a.units[1:list_position({_FITS}, true) - 1],
             [list_append(a.units[list_position({_FITS}, true)], {{'s': p.s, 'x': p.x, 'y': p.y, 'g': p.g}})]), a.units[list_position({_FITS}, true) + 1:]) END}}).units AS units
  FROM seq),
unit AS (SELECT place, len(list_distinct(list_transform(m, lambda q: q.s))) AS services, len(list_distinct(list_filter(list_transform(m, lambda q: q.g), lambda g: g <> ''))) AS grades
  FROM (SELECT place, unnest(units) AS m FROM walked)),
solved AS (SELECT place, count(*) AS units, count(*) FILTER (services > 1) AS agreements, count(*) FILTER (services > 1 AND grades > 1) AS grade_disagreements, count(*) FILTER (services = 1) AS single_source FROM unit GROUP BY place)"""


# Places whose services are joined; the others count by their greatest service.
JOINED = ("P1", "P2", "P3")
LOCATED_SQL = f"located AS (SELECT * FROM points WHERE place IN {JOINED})"


def resolved_units(spark, d):
    """Units of J18 for the places that are joined: place, units."""
    located = town(spark, d).withColumn("place", F.when(F.col("place").isin(*JOINED), F.col("place"))).filter("place IS NOT NULL")
    units = buildings.building_units(located, "place", "source", "lon", "lat", "grade", METRES)
    return buildings.unit_summary(units).select(F.col("group_key").alias("place"), "units")


@query("J18", f"WITH {TOWN_SQL}, located AS (SELECT * FROM points), {UNITS_SQL} SELECT place AS group_key, units, agreements, grade_disagreements, single_source FROM solved")
def j18(spark, d):
    units = buildings.building_units(town(spark, d), "place", "source", "lon", "lat", "grade", METRES)
    return buildings.unit_summary(units)


@query(
    "J18_pairs",
    f"""WITH {TOWN_SQL} SELECT DISTINCT a.place, a.lon AS lon, a.lat AS lat, b.lon AS other_lon, b.lat AS other_lat
    FROM points a JOIN points b ON a.place IS NOT DISTINCT FROM b.place AND a.source = 's0' AND b.source <> 's0' WHERE {_edge_sql(METRES)}""",
)
def j18_pairs(spark, d):
    # places are made distinct before they are paired, so pairs stream out and are never gathered
    side = F.when(F.col("source") == "s0", "s0").when(F.col("source") != "s0", "other")
    places = town(spark, d).withColumns({"source": side, "grade": F.lit("")}).filter("source IS NOT NULL")
    nodes = buildings._nodes(places, "place", "source", "lon", "lat", "grade")
    first = buildings._open_units(nodes.filter("source = 's0'"))
    edges = buildings._edges(first, nodes.filter("source = 'other'"), METRES)
    return edges.select(
        F.col("g").alias("place"), F.col("u.lon").alias("lon"), F.col("u.lat").alias("lat"), F.col("q.lon").alias("other_lon"), F.col("q.lat").alias("other_lat")
    )


def _draws() -> str:
    return ", ".join(f"({i}, {u!r}::DOUBLE, {v!r}::DOUBLE)" for i, (u, v) in enumerate(spatial.unit_square()))


@query(
    "J19",
    f"""WITH {TOWN_SQL}, draws(i, u, v) AS (VALUES {_draws()}),
    b AS (SELECT place, min(lon) x0, max(lon) x1, min(lat) y0, max(lat) y1, min(source) AS target, max(source) AS other FROM points GROUP BY place),
    t AS (SELECT place, i, x0 + (x1 - x0) * u AS lon, y0 + (y1 - y0) * v AS lat, target FROM b, draws WHERE target <> other),
    h AS (SELECT a.place, count(DISTINCT a.i) AS n FROM t a JOIN points b ON a.place IS NOT DISTINCT FROM b.place AND b.source = a.target
      WHERE {_edge_sql(METRES)} GROUP BY a.place)
    SELECT b.place, b.target, round(100.0::DOUBLE * coalesce(h.n, 0) / 500, 1) AS chance_pct FROM b LEFT JOIN h ON h.place = b.place""",
)
def j19(spark, d):
    return spatial.chance_rate(town(spark, d), "place", "source", "lon", "lat", METRES)


@query(
    "P29",
    f"""WITH {POINTS_SQL} SELECT place, CASE WHEN grade = 'Not Applicable' THEN 'ungraded' WHEN grade = 'Possibly damaged' THEN 'possible' ELSE 'observed' END AS bucket,
    count(*) AS n FROM points GROUP BY ALL""",
)
def p29(spark, d):
    return points(spark, d).groupBy("place", buildings.grade_bucket(F.col("grade")).alias("bucket")).agg(F.count("*").alias("n"))


@query("U06", f"WITH {POINTS_SQL} SELECT source, lon, lat, place, grade FROM points WHERE grade <> 'Not Applicable'")
def u06(spark, d):
    p = points(spark, d)
    return buildings.stack_layers({s: p.filter(F.col("source") == s) for s in ("s0", "s1", "s2")})


@query(
    "A07",
    f"""WITH {TOWN_SQL}, stacked AS (SELECT * FROM points WHERE grade <> 'Not Applicable'), located AS (SELECT * FROM stacked WHERE place IS NOT NULL), {UNITS_SQL},
    r AS (SELECT place, count(*) AS points, count(DISTINCT source) AS sources FROM located GROUP BY place),
    f AS (SELECT r.*, units, agreements, grade_disagreements FROM r JOIN solved USING (place))
    SELECT place, points, sources, units, agreements, grade_disagreements, CAST(NULL AS BIGINT) AS without_place FROM f UNION ALL
    SELECT NULL, CAST(sum(points) AS BIGINT), max(sources), CAST(sum(units) AS BIGINT), CAST(sum(agreements) AS BIGINT), CAST(sum(grade_disagreements) AS BIGINT), (SELECT count(*) FROM stacked WHERE place IS NULL) FROM f""",
)
def a07(spark, d):
    p = town(spark, d)
    stacked = buildings.stack_layers({s: p.filter(F.col("source") == s) for s in ("s0", "s1", "s2")})
    located = stacked.filter("place IS NOT NULL")
    units = buildings.building_units(located, "place", "source", "lon", "lat", "grade", METRES)
    return buildings.satellite_totals(stacked, units, "place", "source")


@query(
    "A19",
    f"""WITH {TOWN_SQL}, {LOCATED_SQL}, {UNITS_SQL}, c AS (SELECT place, count(*) FILTER (source = 's0') a, count(*) FILTER (source = 's1') b, count(*) FILTER (source = 's2') c
      FROM points WHERE place IS NOT NULL GROUP BY place)
    SELECT place, CAST(coalesce(units, greatest(a, b, c)) AS BIGINT) AS evaluated FROM c LEFT JOIN solved USING (place)""",
)
def a19(spark, d):
    per = points(spark, d).filter("place IS NOT NULL").groupBy("place").agg(
        *[F.count_if(F.col("source") == s).alias(s) for s in ("s0", "s1", "s2")]
    )
    return per.join(resolved_units(spark, d), "place", "left").select(
        "place", buildings.evaluated_buildings(F.col("units"), F.col("s0"), F.col("s1"), F.col("s2")).alias("evaluated")
    )


@query(
    "A31",
    f"WITH {POINTS_SQL} SELECT string_agg(DISTINCT source, ',' ORDER BY source) AS services, count(DISTINCT source) AS n_services FROM points WHERE place IS NOT NULL",
)
def a31(spark, d):
    from tremorlens.operators.coverage import services

    return services(points(spark, d), "place", "source")
