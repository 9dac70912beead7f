"""Geometry as column expressions (P13, P30-P33) and metric grid keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres per degree of the local plane, and the sphere radius.
M_PER_DEG_LON = 111320.0
M_PER_DEG_LAT = 110570.0
EARTH_KM = 6371.0

RINGS_TYPE = "array<array<struct<x:double,y:double>>>"


def public_coordinate(value: Column) -> Column:
    """About 110 m of published precision."""
    return F.round(value, 3)


def wkt_rings(wkt: Column) -> Column:
    """Rings of a POINT or POLYGON as nested arrays; empty when unreadable."""
    groups = F.regexp_extract_all(F.coalesce(wkt, F.lit("")), F.lit(r"\(([^()]+)\)"), F.lit(1))

    def pair(text: Column) -> Column:
        xy = F.split(F.trim(text), r"\s+")
        return F.when(
            F.size(xy) >= 2,
            F.struct(xy[0].try_cast("double").alias("x"), xy[1].try_cast("double").alias("y")),
        )

    def ring(text: Column) -> Column:
        return F.filter(F.transform(F.split(text, ","), pair), lambda p: p.isNotNull())

    return F.filter(F.transform(groups, ring), lambda r: F.size(r) > 0)


def rings_geojson(wkt: Column, rings: Column) -> Column:
    """GeoJSON text of a parsed POINT or POLYGON, NULL otherwise."""
    kind = F.upper(F.trim(wkt))
    as_pairs = F.transform(rings, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    point = F.to_json(F.struct(F.lit("Point").alias("type"), as_pairs[0][0].alias("coordinates")))
    area = F.to_json(F.struct(F.lit("Polygon").alias("type"), as_pairs.alias("coordinates")))
    return F.when(
        F.size(rings) > 0,
        F.when(kind.startswith("POINT"), point).when(kind.startswith("POLYGON"), area),
    )


def ring_contains(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd rule, each edge against its predecessor."""
    last = F.size(ring) - 1

    def flip(inside: Column, i: Column) -> Column:
        a, b = ring[i], ring[F.when(i == 0, last).otherwise(i - 1)]
        straddles = (a["y"] > lat) != (b["y"] > lat)
        crossing = F.try_divide((b["x"] - a["x"]) * (lat - a["y"]), b["y"] - a["y"]) + a["x"]
        return inside != (straddles & F.coalesce(lon < crossing, F.lit(False)))

    return F.aggregate(F.sequence(F.lit(0), last), F.lit(False), flip)


def polygon_contains(lon: Column, lat: Column, rings: Column) -> Column:
    """Inside the outer ring and inside none of the holes."""
    holes = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))
    inside = ring_contains(lon, lat, rings[0]) & ~F.exists(
        holes, lambda hole: ring_contains(lon, lat, hole)
    )
    return F.when(F.size(rings) > 0, inside).otherwise(F.lit(False))


def ring_bounds(ring: Column) -> Column:
    """Bounding box of one ring as a struct."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"),
        F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"),
    )


def plane_m(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    """Metres in the local plane; meant for distances of a few hundred metres."""
    east = (lon_a - lon_b) * M_PER_DEG_LON * F.cos(F.radians((lat_a + lat_b) / 2))
    north = (lat_a - lat_b) * M_PER_DEG_LAT
    return F.hypot(east, north)


def haversine_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Great-circle kilometres."""
    half_lat = F.radians(lat_b - lat_a) / 2
    half_lon = F.radians(lon_b - lon_a) / 2
    chord = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(
        F.sin(half_lon), 2
    )
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(chord > 1, F.lit(1.0)).otherwise(chord)))


def grid_index(value: Column, start: Column, stop: Column, num: Column) -> Column:
    """Nearest position on a regular axis (ties to even), NULL off the axis."""
    position = F.rint((value - start) / (stop - start) * (num - 1)).cast("bigint")
    return F.when((position >= 0) & (position < num), position)
