"""Nearest places by proven radius against all distances."""

import math
import random

import pytest

from pyspark.sql import functions as F
from tremorlens.operators import spatial
from tremorlens.plans.grid import near_keys


def km(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(h))


@pytest.mark.parametrize("around,spread,n_places", [((-75.0, 4.0), 1.5, 60), ((-75.0, 4.0), 0.2, 400), ((179.95, -16.0), 0.4, 80), ((10.0, 78.0), 2.0, 50)])
def test_nearest_equals_all_distances(spark, around, spread, n_places):
    rng = random.Random(n_places)

    def somewhere():
        lon = around[0] + rng.uniform(-spread, spread)
        return (lon - 360 if lon > 180 else lon), around[1] + rng.uniform(-spread, spread)

    places = [(f"place {i:03}", *somewhere()) for i in range(n_places)]
    places += [("copy", *places[0][1:]), ("nowhere", None, None), ("far", 100.0, 0.0)]
    points = [(i, *somewhere(), None) for i in range(300)] + [(900 + i, *places[i][1:], None) for i in range(5)]
    points += [(1000, None, 1.0, None), (1001, *places[3][1:], "place 007"), (1002, *places[3][1:], "unheard of"), (1003, -20.0, -60.0, None)]
    table = spark.createDataFrame(points, "id long, lon double, lat double, said string")
    at = spark.createDataFrame(places, "place string, plon double, plat double")
    got = {r["id"]: r["place"] for r in spatial.nearest_place(table, "id", "lon", "lat", "said", at, "place", "plon", "plat", 25.0).collect()}
    for i, lon, lat, said in points:
        if said == "place 007":
            assert got[i] == said
            continue
        near = sorted((km((lon, lat), p[1:]), p[0]) for p in places if p[1] is not None) if lon is not None else []
        near = [x for x in near if x[0] <= 25.0]
        assert got[i] == (near[0][1] if near else None)


def test_the_limit_is_inclusive(spark):
    table = spark.createDataFrame([(1, 0.0, 0.0, None), (2, 0.0, 0.0001, None)], "id long, lon double, lat double, said string")
    at = spark.createDataFrame([("p", 0.0, 0.2)], "place string, plon double, plat double")
    exact = spark.range(1).select(spatial.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.2), F.lit(0.0))).first()[0]
    for radius, found in ((exact, {1: "p", 2: "p"}), (exact - 1e-9, {1: None, 2: "p"})):
        assert {r["id"]: r["place"] for r in spatial.nearest_place(table, "id", "lon", "lat", "said", at, "place", "plon", "plat", radius).collect()} == found


def test_candidates_do_not_follow_density(spark):
    """A hundred times as many places leave about as many candidates for a cell."""
    rng, counts = random.Random(1), []
    points = spark.createDataFrame([(rng.uniform(0, 0.5), rng.uniform(0, 0.5)) for _ in range(200)], "lon double, lat double")
    cells = near_keys(points, "lon", "lat", 25 * spatial.MARGIN * 1000 / 2**spatial.HALVINGS, per_lat=spatial.SPHERE_M_PER_DEG, per_lon=spatial.SPHERE_M_PER_DEG).select("_band", "_cell").distinct()
    for n in (60, 6000):
        places = spark.createDataFrame([(f"p{i}", rng.uniform(0, 0.5), rng.uniform(0, 0.5)) for i in range(n)], "place string, _plon double, _plat double")
        found = spatial.nearest_candidates(cells, places, "place", 25.0)
        counts.append(found.count() / cells.count())
    assert counts[1] < 3 * counts[0] and counts[1] < 30
