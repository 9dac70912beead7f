"""Grid keys that turn "within r metres" and "inside a box" into equi-joins.

Latitude is cut in bands of one radius.  Inside a band the longitude step is the
radius at the band's most poleward neighbour, so any two points closer than the
radius lie in the same or in an adjacent cell.  The small side is copied to nine
cells, the large side keeps one row per point.  The radius may be a column, where rows
belong to levels of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MIN_COS = 0.01


def _band(lat: Column, step: float) -> Column:
    return F.floor(lat / F.lit(step))


def _lon_step(band: Column, lat_step: float, metres: float, per_degree: float) -> Column:
    edge = F.greatest(F.abs((band - 1) * lat_step), F.abs((band + 2) * lat_step))
    cosine = F.greatest(F.cos(F.radians(F.least(edge, F.lit(90.0)))), F.lit(_MIN_COS))
    return F.lit(metres * 1.0001 / per_degree) / cosine


def near_keys(
    df: DataFrame, lon: str, lat: str, metres: float | Column, per_lat: float, per_lon: float
) -> DataFrame:
    """One cell per row: adds ``_band`` and ``_cell``."""
    step = metres * 1.0001 / per_lat
    keyed = df.withColumn("_band", _band(F.col(lat), step))
    width = _lon_step(F.col("_band"), step, metres, per_lon)
    return keyed.withColumn("_cell", F.floor(F.col(lon) / width))


def cell_edges(band: Column, cell: Column, metres: float, per_degree: float) -> tuple[list[Column], list[Column]]:
    """Latitudes and longitudes (south and north, west and east) between which a cell lies; degrees are alike in both directions."""
    step = metres * 1.0001 / per_degree
    width = _lon_step(band, step, metres, per_degree)
    return [band * step, (band + 1) * step], [cell * width, (cell + 1) * width]


def near_probes(
    df: DataFrame, lon: str, lat: str, metres: float | Column, per_lat: float, per_lon: float
) -> DataFrame:
    """The nine cells around each row, under the same two key columns.

    Longitudes are also probed one turn away, so the date line needs no special case.
    """
    step = metres * 1.0001 / per_lat
    home = _band(F.col(lat), step)
    bands = df.withColumn("_band", F.explode(F.sequence(home - 1, home + 1)))
    width = _lon_step(F.col("_band"), step, metres, per_lon)

    def around(shift: float) -> Column:
        centre = F.floor((F.col(lon) + shift) / width)
        return F.sequence(centre - 1, centre + 1)

    near_edge = F.abs(F.col(lon)) > 180.0 - 2 * width
    cells = F.when(
        near_edge, F.array_union(around(0.0), F.array_union(around(360.0), around(-360.0)))
    ).otherwise(around(0.0))
    return bands.withColumn("_cell", F.explode(cells))


# Box joins: each box picks the level whose cell is at least as large as the box, so it
# touches at most four cells; a point probes one cell per level that is really in use.
_FINEST = 2.0**-14
_LEVELS = 26


def box_level(width: Column, height: Column) -> Column:
    size = F.greatest(width, height, F.lit(_FINEST))
    return F.least(F.ceil(F.log2(size / F.lit(_FINEST))).cast("int"), F.lit(_LEVELS))


def _cell_size(level: Column) -> Column:
    return F.lit(_FINEST) * F.pow(F.lit(2.0), level)


def box_keys(df: DataFrame, box: Column) -> DataFrame:
    """Cells touched by a bounding box struct (x0, x1, y0, y1): at most four rows."""
    level = box_level(box["x1"] - box["x0"], box["y1"] - box["y0"])
    size = _cell_size(level)
    return (
        df.withColumn("_level", level)
        .withColumn("_cx", F.explode(F.sequence(F.floor(box["x0"] / size), F.floor(box["x1"] / size))))
        .withColumn("_cy", F.explode(F.sequence(F.floor(box["y0"] / size), F.floor(box["y1"] / size))))
    )


def point_keys(df: DataFrame, lon: str, lat: str, levels: list[int]) -> DataFrame:
    """One probe per level in use."""
    probes = df.withColumn("_level", F.explode(F.array(*[F.lit(int(v)) for v in levels])))
    size = _cell_size(F.col("_level"))
    return probes.withColumn("_cx", F.floor(F.col(lon) / size)).withColumn(
        "_cy", F.floor(F.col(lat) / size)
    )
