"""Point joins: containing zone, nearest place, radius, grid value."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlens.functions.geo import (
    M_PER_DEG_LAT, M_PER_DEG_LON, grid_index, haversine_km, plane_m, polygon_contains,
    ring_bounds, wkt_rings,
)
from tremorlens.plans.grid import box_keys, box_level, cell_edges, near_keys, near_probes, point_keys
from tremorlens.plans.joins import BROADCAST_ROWS, derived_join, skew_join
from tremorlens.session import cut_lineage, written

# Metres per degree on the 6371 km sphere, for grids that serve haversine distances.
SPHERE_M_PER_DEG = 111194.0
# Geometry is heavier than a key: zones are broadcast only below this many vertices.
BROADCAST_VERTICES = 1_000_000


def prepare_zones(zones: DataFrame, zone: str, wkt: str) -> DataFrame:
    """Parsed rings, bounding box and box area; unreadable shapes drop out."""
    rings = zones.withColumn("_rings", wkt_rings(F.col(wkt))).filter(F.size("_rings") > 0)
    boxed = rings.withColumn("_box", ring_bounds(F.col("_rings")[0]))
    area = (F.col("_box.x1") - F.col("_box.x0")) * (F.col("_box.y1") - F.col("_box.y0"))
    return boxed.select(F.col(zone), "_rings", "_box", area.alias("_area"))


def zone_hits(points: DataFrame, key: str, lon: str, lat: str, zones: DataFrame, zone: str, wkt: str) -> DataFrame:
    """``(key, zone)`` with the smallest containing zone; points outside all are absent."""
    box = F.col("_box")
    level = box_level(box["x1"] - box["x0"], box["y1"] - box["y0"])
    # shapes are parsed once; how large they are, and on which levels, is seen while they are written
    shapes, summary = written(
        prepare_zones(zones, zone, wkt), levels=F.collect_set(level), vertices=F.sum(F.aggregate("_rings", F.lit(0), lambda n, r: n + F.size(r)))
    )
    levels = sorted(summary["levels"] or []) or [0]
    small_enough = (summary["vertices"] or 0) <= BROADCAST_VERTICES
    probes = point_keys(
        points.select(key, lon, lat).filter(F.col(lon).isNotNull() & F.col(lat).isNotNull()), lon, lat, levels
    )
    cells = box_keys(shapes, box)
    pairs = skew_join(
        probes, cells, ["_level", "_cx", "_cy"], spread=F.col(key),
        rows=BROADCAST_ROWS if small_enough else 0,
    )
    inside = pairs.filter(
        F.col(lon).between(F.col("_box.x0"), F.col("_box.x1"))
        & F.col(lat).between(F.col("_box.y0"), F.col("_box.y1"))
        & polygon_contains(F.col(lon), F.col(lat), F.col("_rings"))
    )
    return inside.groupBy(key).agg(F.min_by(zone, F.struct("_area", zone)).alias(zone))


def containing_zone(points: DataFrame, key: str, lon: str, lat: str, zones: DataFrame, zone: str, wkt: str) -> DataFrame:
    """Each point with its smallest containing zone, NULL outside all of them."""
    return points.join(zone_hits(points, key, lon, lat, zones, zone, wkt), key, "left")


def in_any_zone(points: DataFrame, key: str, lon: str, lat: str, zones: DataFrame, zone: str, wkt: str) -> DataFrame:
    """Only the points that lie inside some zone."""
    return points.join(zone_hits(points, key, lon, lat, zones, zone, wkt), key, "left_semi")


def near_pairs(
    points: DataFrame, key: str, lon: str, lat: str, places: DataFrame, place: str, place_lon: str,
    place_lat: str, radius_km: float,
) -> DataFrame:
    """``(key, place, km)`` for every point and place within reach (inclusive)."""
    metres = radius_km * 1000.0
    sphere = {"per_lat": SPHERE_M_PER_DEG, "per_lon": SPHERE_M_PER_DEG}
    left = near_keys(
        points.select(key, lon, lat).filter(F.col(lon).isNotNull() & F.col(lat).isNotNull()), lon, lat, metres, **sphere
    )
    right = near_probes(
        places.select(F.col(place), F.col(place_lon).alias("_plon"), F.col(place_lat).alias("_plat")).filter(
            F.col("_plon").isNotNull() & F.col("_plat").isNotNull()
        ),
        "_plon", "_plat", metres, **sphere,
    )
    pairs = skew_join(left, right, ["_band", "_cell"], spread=F.col(key))
    km = haversine_km(F.col(lat), F.col(lon), F.col("_plat"), F.col("_plon"))
    return pairs.select(key, place, km.alias("km")).filter(F.col("km") <= radius_km)


# Halvings of the radius down to the cells that share their candidates, and what a level is larger than its radius.
HALVINGS, MARGIN = 7, 1.02


def _middle(df: DataFrame, metres: float) -> DataFrame:
    """Cells (_band, _cell) with their middle (_lon, _lat) and the distance from there to the farthest corner (_half, km)."""
    north, east = cell_edges(F.col("_band"), F.col("_cell"), metres, SPHERE_M_PER_DEG)
    lat, lon = (north[0] + north[1]) / 2, (east[0] + east[1]) / 2
    corners = [haversine_km(lat, lon, y, east[1]) for y in north]
    return df.select("_band", "_cell", lon.alias("_lon"), lat.alias("_lat"), (F.greatest(*corners) * 1.001).alias("_half"))


def nearest_candidates(cells: DataFrame, places: DataFrame, place: str, radius_km: float) -> DataFrame:
    """Places that may be the nearest within the radius of some point of a cell: (_band, _cell, place, _plon, _plat).

    A pyramid of cells, each level of half the size, names one place near every cell that has any.  The distance to the nearest of
    those is proven for all points of a cell, so only places within it, measured from the middle, are candidates: as many as
    there are in the ring between, however dense places are elsewhere.
    """
    sphere = {"per_lat": SPHERE_M_PER_DEG, "per_lon": SPHERE_M_PER_DEG}
    widest = radius_km * MARGIN * 1000.0
    metres, levels = F.lit(widest) / F.pow(F.lit(2.0), F.col("_level")), F.explode(F.sequence(F.lit(0), F.lit(HALVINGS))).alias("_level")
    home = _middle(cells, widest / 2**HALVINGS).withColumnsRenamed({"_band": "_fine_band", "_cell": "_fine_cell"})
    spots = places.select(F.col(place), "_plon", "_plat").distinct()
    probes = near_probes(spots.select("*", levels), "_plon", "_plat", metres, **sphere)
    on, cell = ["_level", "_band", "_cell"], ["_fine_band", "_fine_cell"]
    some = probes.groupBy(*on).agg(F.min(F.struct("_plon", "_plat")).alias("_some"))
    km = haversine_km(F.col("_lat"), F.col("_lon"), F.col("_some._plat"), F.col("_some._plon"))
    keyed = near_keys(home.select("*", levels), "_lon", "_lat", metres, **sphere)
    proven = derived_join(keyed, some, on).groupBy(*cell, "_lon", "_lat", "_half").agg(F.min(km + F.col("_half")).alias("_proven"))
    reach = F.least("_proven", F.lit(float(radius_km))) + F.col("_half")
    level = F.floor(F.log2(F.lit(widest / 1000.0) / reach))
    reaching = proven.withColumn("_reach", reach).withColumn("_level", F.greatest(F.least(level, F.lit(HALVINGS)), F.lit(0)).cast("int"))
    near = derived_join(near_keys(reaching, "_lon", "_lat", metres, **sphere), probes, on)
    near = near.filter(haversine_km(F.col("_lat"), F.col("_lon"), F.col("_plat"), F.col("_plon")) <= F.col("_reach") * (1 + 1e-9))
    return near.select(F.col("_fine_band").alias("_band"), F.col("_fine_cell").alias("_cell"), place, "_plon", "_plat").distinct()


def nearest_place(
    points: DataFrame, key: str, lon: str, lat: str, declared: str, places: DataFrame, place: str,
    place_lon: str, place_lat: str, radius_km: float = 25.0,
) -> DataFrame:
    """Declared place when known, else the nearest centre in reach (inclusive; ties by name), else NULL (orphan)."""
    known = places.select(F.col(place).alias(declared), F.col(place).alias("_known")).distinct()
    checked = skew_join(points, known, [declared], "left", spread=F.col(key))
    metres = radius_km * MARGIN * 1000.0 / 2**HALVINGS
    loose = points.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull())
    keyed = near_keys(loose, lon, lat, metres, per_lat=SPHERE_M_PER_DEG, per_lon=SPHERE_M_PER_DEG)
    centres = places.select(F.col(place), F.col(place_lon).alias("_plon"), F.col(place_lat).alias("_plat")).filter("_plon IS NOT NULL AND _plat IS NOT NULL")
    candidates = nearest_candidates(keyed.select("_band", "_cell").distinct(), centres, place, radius_km)
    km = haversine_km(F.col(lat), F.col(lon), F.col("_plat"), F.col("_plon"))
    pairs = derived_join(keyed.select(key, lon, lat, "_band", "_cell"), candidates, ["_band", "_cell"]).withColumn("km", km).filter(F.col("km") <= radius_km)
    best = pairs.groupBy(key).agg(F.min_by(place, F.struct("km", place)).alias("_nearest"))
    return (
        checked.join(best, key, "left")
        .withColumn(place, F.coalesce("_known", "_nearest"))
        .drop("_known", "_nearest")
    )


def within_radius(
    points: DataFrame, key: str, lon: str, lat: str, places: DataFrame, place: str, place_lon: str,
    place_lat: str, radius_km: float,
) -> DataFrame:
    """Pairs strictly closer than the radius, with the distance."""
    pairs = near_pairs(points, key, lon, lat, places, place, place_lon, place_lat, radius_km)
    return pairs.filter(F.col("km") < radius_km)


def nearest_within(
    points: DataFrame, key: str, lon: str, lat: str, places: DataFrame, place: str, place_lon: str,
    place_lat: str, radius_km: float, rings: int = 4,
) -> DataFrame:
    """``(key, place, km)`` of the nearest place closer than the radius.

    The radius doubles from ring to ring, and only points that found nothing go on: a point
    meets the places around it, not all that the full radius holds.
    """
    left, out = points.select(key, lon, lat), None
    for ring in range(rings - 1, -1, -1):
        pairs = within_radius(left, key, lon, lat, places, place, place_lon, place_lat, radius_km / 2**ring)
        best = pairs.groupBy(key).agg(F.min(F.struct("km", place)).alias("_best")).select(key, f"_best.{place}", "_best.km")
        found = cut_lineage(best)
        out = found if out is None else out.unionByName(found)
        if ring:
            left = left.join(found.select(key), key, "left_anti")
    return out


def grid_cells(header: DataFrame, keys: list[str]) -> DataFrame:
    """One row per cell of a regular grid stored row by row (y outer, x inner)."""
    cells = header.select(*keys, "nx", F.posexplode("values").alias("_i", "value"))
    return cells.select(
        *keys, F.pmod(F.col("_i"), F.col("nx")).cast("bigint").alias("ix"),
        F.expr("_i div nx").cast("bigint").alias("iy"), "value",
    )


def grid_value(
    points: DataFrame, lon: Column, lat: Column, header: dict[str, float], cells: DataFrame, out: str = "value"
) -> DataFrame:
    """Value of the nearest grid cell, NULL outside the grid.

    ``header`` has x0, x1, nx, y0, y1, ny: one grid per call, its cells stay a table.
    """
    axis = {k: F.lit(v) for k, v in header.items()}
    keyed = points.withColumn("ix", grid_index(lon, axis["x0"], axis["x1"], axis["nx"])).withColumn(
        "iy", grid_index(lat, axis["y0"], axis["y1"], axis["ny"])
    )
    lookup = cells.select("ix", "iy", F.col("value").alias(out))
    return skew_join(keyed, lookup, ["ix", "iy"], "left").drop("ix", "iy")


def unit_square(samples: int = 500, seed: int = 42) -> list[tuple[float, float]]:
    """Seeded pairs in [0, 1): the only part of the control that is not data."""
    source = random.Random(seed)
    return [(source.random(), source.random()) for _ in range(samples)]


def chance_rate(
    points: DataFrame, group: str, source: str, lon: str, lat: str, metres: float = 20.0,
    samples: int = 500, seed: int = 42,
) -> DataFrame:
    """Share of random points in each group's box that fall near the target source.

    The target is the first source by name; groups with one source yield 0.0.
    """
    clean = points.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull())
    boxes = clean.groupBy(group).agg(
        F.min(lon).alias("_x0"), F.max(lon).alias("_x1"), F.min(lat).alias("_y0"), F.max(lat).alias("_y1"),
        F.min(source).alias("_target"), F.max(source).alias("_other"),
    )
    draws = F.array(*[F.struct(F.lit(u).alias("u"), F.lit(v).alias("v")) for u, v in unit_square(samples, seed)])
    mixed = boxes.filter(F.col("_target") != F.col("_other"))
    throws = mixed.select(group, "_target", "_x0", "_x1", "_y0", "_y1", F.posexplode(draws).alias("_draw", "_uv")).select(
        group, "_target", "_draw",
        (F.col("_x0") + (F.col("_x1") - F.col("_x0")) * F.col("_uv.u")).alias("_qlon"),
        (F.col("_y0") + (F.col("_y1") - F.col("_y0")) * F.col("_uv.v")).alias("_qlat"),
    )
    plane = {"per_lat": M_PER_DEG_LAT, "per_lon": M_PER_DEG_LON}
    # copies at one coordinate answer the same question, so they are merged first
    targets = clean.select(group, F.col(source).alias("_target"), F.col(lon).alias("_lon"), F.col(lat).alias("_lat")).distinct()
    left = near_keys(targets, "_lon", "_lat", metres, **plane)
    right = near_probes(throws, "_qlon", "_qlat", metres, **plane)
    near = derived_join(left, right, [group, "_target", "_band", "_cell"]).filter(
        plane_m(F.col("_qlon"), F.col("_qlat"), F.col("_lon"), F.col("_lat")) < metres
    )
    hits = near.groupBy(group).agg(F.count_distinct("_draw").alias("_hits"))
    rate = F.round(100 * F.coalesce(F.col("_hits"), F.lit(0)) / F.lit(samples), 1)
    return boxes.join(hits, group, "left").select(group, F.col("_target").alias("target"), rate.alias("chance_pct"))
