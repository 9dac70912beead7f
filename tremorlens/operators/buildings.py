"""Counting each building once when several services mapped it.

The rule is sequential: points are visited by (source, lon, lat); a point joins the
first unit, in creation order, that has no point of its source and some member
closer than the threshold, else it opens a unit.  Visiting source by source turns
each step into one serial dictatorship between the source's points and the open
units, and that is a triangular system: what a point gets from a unit depends only
on earlier points of that unit and on earlier units of that point.  Leaves of the
plane serve their points in order, each seeking its first open unit in the cells
around it, so no list of pairs is made; only units in reach of several leaves carry
what they have given from one leaf to the next.

Leaves follow the data: tiles that touch from south to north are a run; runs are ordered along a Z curve and share a leaf while it
holds few points; a crowded run is cut into strips of longitude.  Points are visited by longitude, so a strip waits for those west
of it only.

Copies (same source, coordinate and grade) are one weighted node from the start, so
the number of edges follows distinct places, not rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorlens.functions.geo import M_PER_DEG_LAT, M_PER_DEG_LON, plane_m
from tremorlens.plans.grid import near_keys, near_probes
from tremorlens.plans.joins import derived_join, with_scalar
from tremorlens.session import cut_lineage, written

_PLANE = {"per_lat": M_PER_DEG_LAT, "per_lon": M_PER_DEG_LON}
# Side of a tile in thresholds; tiles in a row of a square, and slivers of longitude in a tile, are 2 ** HALVINGS and 2 ** (2 * HALVINGS).
TILE, HALVINGS = 512, 8
# Rows of a leaf (points, and members of units); a leaf ends with the sliver or tile that reaches the bound.
LEAF_PAIRS = 50_000
# Members of units that are measured at a time.
STRIDE = 256
# Names of sources that are asked for at a time.
NAMES = 64


def grade_bucket(grade: Column) -> Column:
    """Observed, possible or ungraded; an ungraded point is set apart, never lost."""
    low = F.lower(F.coalesce(grade, F.lit("")))
    return (
        F.when(low.startswith("not applicable") | (low == ""), "ungraded")
        .when(low.startswith("possibl"), "possible")
        .otherwise("observed")
    )


def stack_layers(layers: dict[str, DataFrame]) -> DataFrame:
    """Point layers of several services as (source, lon, lat, place, grade).

    Points that a service marked without grading are not classified damage.
    """
    out = None
    for name, layer in layers.items():
        part = layer.select(F.lit(name).alias("source"), "lon", "lat", "place", "grade").filter(
            ~F.coalesce(F.lower("grade").startswith("not applicable"), F.lit(False))
        )
        out = part if out is None else out.unionByName(part)
    return out


def _nodes(points: DataFrame, group: str, source: str, lon: str, lat: str, grade: str) -> DataFrame:
    clean = points.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull())
    return (
        clean.groupBy(
            F.col(group).alias("g"), F.coalesce(F.col(source), F.lit("")).alias("source"),
            F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat"),
            F.lower(F.coalesce(F.col(grade), F.lit(""))).alias("grade"),
        )
        .agg(F.count("*").alias("n"))
        .withColumn("ord", F.struct("source", "lon", "lat", "grade", F.lit(0).cast("bigint").alias("at")))
    )


_MEMBER = "struct<source:string,lon:double,lat:double,grade:string>"


def _open_units(nodes: DataFrame) -> DataFrame:
    member = F.struct("source", "lon", "lat", "grade").cast(_MEMBER)
    return nodes.select("g", F.col("ord").alias("u"), F.col("n").alias("cap"), F.array(member).alias("members"))


def _edges(units: DataFrame, nodes: DataFrame, metres: float) -> DataFrame:
    """Unit and node pairs closer than the threshold; one row per pair, at the unit's first member in reach."""
    spots = units.select("g", "u", "cap", "members", F.posexplode("members").alias("at", "m")).select(
        "g", "u", "cap", F.col("m.lon").alias("ulon"), F.col("m.lat").alias("ulat"), F.slice("members", 1, F.col("at")).alias("earlier")
    )
    left = near_keys(spots, "ulon", "ulat", metres, **_PLANE)
    right = near_probes(nodes.select("g", F.col("ord").alias("q"), "n", "lon", "lat"), "lon", "lat", metres, **_PLANE)

    def near(lon: Column, lat: Column) -> Column:
        return plane_m(lon, lat, F.col("lon"), F.col("lat")) < metres

    pairs = derived_join(left, right, ["g", "_band", "_cell"]).filter(near(F.col("ulon"), F.col("ulat")))
    return pairs.filter(~F.exists("earlier", lambda m: near(m["lon"], m["lat"]))).select("g", "u", "q", "cap", "n")


_ORD = "struct<source:string,lon:double,lat:double,grade:string,at:bigint>"
LEAF = ("g", "ty", "tx", "leaf")
# Rows of a leaf in the order in which they are read: members of units, then nodes among what other leaves have taken.
SPOT, TAKEN, NODE = 0, 1, 2


def _solve(rows: DataFrame, metres: float) -> DataFrame:
    """Serve the nodes of every leaf in order: each takes from the first units in reach what is left of them.

    Members of the leaf's units are held by cells of one threshold; nodes stream by.
    """
    import pyarrow as pa

    step, stride, spot, taken = metres * 1.0001 / M_PER_DEG_LAT, STRIDE, SPOT, TAKEN

    def run(batches):
        import numpy as np

        def column(band, lon):
            edge = max(abs((band - 1) * step), abs((band + 2) * step))
            return math.floor(lon / (metres * 1.0001 / M_PER_DEG_LON / max(math.cos(math.radians(min(edge, 90.0))), 0.01)))

        def first(lon, lat):
            """The first open unit in reach: of each cell, members are measured in the order of their units."""
            best, home = len(free), math.floor(lat / step)
            for band in (home - 1, home, home + 1):
                centre = column(band, lon)
                for key in ((band, centre - 1), (band, centre), (band, centre + 1)):
                    if key not in cells:
                        continue
                    if isinstance(cells[key], list):
                        ids, xs, ys = zip(*cells[key], strict=True)
                        cells[key] = np.array(ids), np.array(xs), np.array(ys)
                    ids, xs, ys = cells[key]
                    head = free[ids[:stride]] > 0
                    if 2 * head.sum() < len(head):
                        left = free[ids] > 0
                        ids, xs, ys = cells[key] = ids[left], xs[left], ys[left]
                    for k in range(0, len(ids), stride):
                        if ids[k] >= best:
                            break
                        part, x, y = (v[k : k + stride] for v in (ids, xs, ys))
                        east = (x - lon) * M_PER_DEG_LON * np.cos(np.radians((y + lat) / 2))
                        hit = (free[part] > 0) & (np.hypot(east, (y - lat) * M_PER_DEG_LAT) < metres)
                        at = int(hit.argmax())
                        if hit[at]:
                            best = min(best, int(part[at]))
                            break
            return best

        leaf, index, caps, cells, free = None, {}, [], {}, None
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            leaves = zip(*(columns[k].to_pylist() for k in LEAF), strict=True)
            orders, units = (list(zip(*(c.to_pylist() for c in columns[k].flatten()), strict=True)) for k in ("o", "u"))
            rest = [columns[k].to_pylist() for k in ("kind", "n", "lon", "lat")]
            out = []
            for here, o, u, kind, n, lon, lat in zip(leaves, orders, units, *rest, strict=True):
                if here != leaf:
                    leaf, index, caps, cells, free = here, {}, [], {}, None
                if kind == spot:
                    if o not in index:
                        index[o] = len(caps)
                        caps.append((o, n))
                    band = math.floor(lat / step)
                    cells.setdefault((band, column(band, lon)), []).append((index[o], lon, lat))
                    continue
                if free is None:
                    free = np.array([cap for _, cap in caps], dtype=np.int64)
                if kind == taken:
                    free[index[u]] -= n
                    continue
                while n > 0 and (at := first(lon, lat)) < len(free):
                    x = min(n, int(free[at]))
                    free[at] -= x
                    n -= x
                    out.append((*here, caps[at][0], o, x))
            types = [columns[k].type for k in (*LEAF, "u", "o", "n")]
            parts = zip(*out, strict=True) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(parts, types, strict=True)], names=[*LEAF, "u", "q", "x"])

    kind = rows.schema["g"].dataType.simpleString()
    # a leaf is little to read and much to do: tasks are not joined by their size
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(tasks, *LEAF).sortWithinPartitions(*LEAF, F.col("kind") > SPOT, "o")
    return ordered.mapInArrow(run, f"g {kind}, ty bigint, tx bigint, leaf bigint, u {_ORD}, q {_ORD}, x bigint")


def _spread(x: Column) -> Column:
    """The low bits of a number, moved to every other place."""
    return sum((F.shiftright(x, k).bitwiseAND(F.lit(1)) * (1 << (2 * k)) for k in range(HALVINGS)), F.lit(0).cast("bigint"))


def _with_leaves(rows: DataFrame, metres: float, beside: DataFrame | None = None) -> DataFrame:
    """Rows with the leaf of their node (ty, tx, leaf): a strip of one crowded run of tiles, or a stretch of the Z curve through runs.

    A run holds the tiles that touch from south to north.  No border of latitude parts its points, so that leaves only wait for
    leaves to the west.  ``beside`` (g, q) are rows that count for the size of a leaf.  What is ordered are slivers and runs with
    counts; a run has a fixed number of slivers, and a square a fixed number of tiles.  Rows themselves only meet in their leaves.
    """
    side, bits = TILE * metres, 2 * HALVINGS
    sliver = F.floor(F.col("q.lon") * M_PER_DEG_LON / (side / (1 << bits)))
    # squares begin half a square off the equator and the zero meridian, which cross towns
    half = 1 << (HALVINGS - 1)
    tile = ["g", "cty", "ctx"]
    keys = {"cty": F.floor(F.col("q.lat") * M_PER_DEG_LAT / side), "ctx": F.shiftright(sliver, bits), "z": sliver.bitwiseAND((1 << bits) - 1)}
    placed = rows.withColumns(keys)
    counted = placed.select(*tile, "z")
    if beside is not None:
        counted = counted.unionByName(beside.withColumns(keys).select(*tile, "z"))
    cells = counted.groupBy(*tile, "z").agg(F.count("*").alias("_held"))
    past, column = (Window.unboundedPreceding, -1), Window.partitionBy("g", "ctx").orderBy("cty")
    start = F.when(F.coalesce(F.col("cty") - F.lag("cty").over(column), F.lit(2)) > 1, F.col("cty"))
    named = cells.select(*tile).distinct().withColumn("_start", start).withColumn("run", F.max("_start").over(column)).drop("_start")
    run = ["g", "run", "ctx"]
    cells = cells.join(named, tile)
    slivers = cells.groupBy(*run, "z").agg(F.sum("_held").alias("_held"))
    number = F.expr(f"coalesce(_before, 0) div {LEAF_PAIRS}")
    inside = slivers.withColumn("_before", F.sum("_held").over(Window.partitionBy(*run).orderBy("z").rowsBetween(*past))).select(*run, "z", number.alias("_inner"))
    runs, square = slivers.groupBy(*run).agg(F.sum("_held").alias("_held")), [F.shiftright(F.col(c) + half, HALVINGS) for c in ("run", "ctx")]
    curve = Window.partitionBy("g", *square).orderBy(_spread(F.col("run") + half) * 2 + _spread(F.col("ctx") + half)).rowsBetween(*past)
    around = runs.withColumn("_before", F.sum("_held").over(curve)).select(*run, (F.col("_held") > LEAF_PAIRS).alias("_crowded"), number.alias("_outer"))
    crowded = F.col("_crowded")
    dealt = inside.join(around, run).select(
        *run, "z", F.when(crowded, F.col("run")).otherwise(square[0]).alias("ty"), F.when(crowded, F.col("ctx")).otherwise(square[1]).alias("tx"),
        F.when(crowded, F.col("_inner") * 2 + 1).otherwise(F.col("_outer") * 2).alias("leaf"),
    )
    leaves = cells.select(*tile, "z", "run").join(dealt, [*run, "z"]).drop("run")
    return derived_join(placed, leaves, [*tile, "z"]).drop("cty", "ctx", "z")


def _leaf_rows(units: DataFrame, nodes: DataFrame, metres: float) -> DataFrame:
    """Nodes in their leaves, and members of units in every leaf that has a node in a cell beside theirs."""
    places = F.array_distinct(F.transform("members", lambda m: F.struct(m["lon"].alias("lon"), m["lat"].alias("lat"))))
    spots = units.select("g", "u", "cap", F.explode(places).alias("q"))
    dealt = _with_leaves(nodes.select("g", F.col("ord").alias("q"), "n"), metres, spots).select("*", "q.lon", "q.lat")
    keyed = near_keys(spots.select("g", "u", "cap", "q.lon", "q.lat"), "lon", "lat", metres, **_PLANE)
    beside = near_probes(dealt.select(*LEAF, "lon", "lat"), "lon", "lat", metres, **_PLANE).select(*LEAF, "_band", "_cell").distinct()
    place, by_u = F.struct("ty", "tx", "leaf"), Window.partitionBy("g", "u")
    held = derived_join(keyed, beside, ["g", "_band", "_cell"]).select(
        *LEAF, F.lit(SPOT).alias("kind"), F.col("u").alias("o"), "u", F.col("cap").alias("n"), "lon", "lat", (F.min(place).over(by_u) != F.max(place).over(by_u)).alias("shared")
    )
    served = dealt.select(*LEAF, F.lit(NODE).alias("kind"), F.col("q").alias("o"), F.col("q").alias("u"), "n", "lon", "lat", F.lit(False).alias("shared"))
    return held.unionByName(served)


def _allocate(units: DataFrame, nodes: DataFrame, metres: float) -> DataFrame:
    """Solve ``x = min(n - earlier units of q, cap - earlier nodes of u)`` for the units and nodes in reach of each other; rows are (g, u, q, x).

    Every leaf is solved to its end in one pass.  What units in reach of several leaves have given elsewhere comes in from the round
    before, and only leaves to which that is news are solved again: rounds follow the leaves that a chain crosses, not its links.
    """
    rows, seen = written(_leaf_rows(units, nodes, metres), shared=F.count_if("shared"))
    given = cut_lineage(_solve(rows, metres))
    if not seen["shared"]:
        return given
    held = cut_lineage(rows.filter("shared").select(*LEAF, "u").distinct())
    place, other = F.struct("ty", "tx", "leaf"), F.struct("ty", "tx", "leaf").alias("_other")
    told = None
    while True:
        known = told
        told = cut_lineage(derived_join(given.select("g", "u", "q", "x", other), held, ["g", "u"]).filter(F.col("_other") != place).select(*LEAF, "u", "q", "x"))
        signed = told.withColumn("_s", F.lit(1))
        if known is not None:
            signed = signed.unionByName(known.withColumn("_s", F.lit(-1)))
        news = signed.groupBy(*LEAF, "u", "q", "x").agg(F.sum("_s").alias("_s")).filter("_s <> 0").select(*LEAF).distinct()
        news, seen = written(news, leaves=F.count("*"))
        if not seen["leaves"]:
            return given
        nowhere = F.lit(None).cast("double")
        outside = told.select(*LEAF, F.lit(TAKEN).alias("kind"), F.col("q").alias("o"), "u", F.col("x").alias("n"), nowhere.alias("lon"), nowhere.alias("lat"), F.lit(True).alias("shared"))
        again = rows.unionByName(outside).join(news, list(LEAF), "left_semi")
        given = cut_lineage(given.join(news, list(LEAF), "left_anti").unionByName(_solve(again, metres)))


def _next_units(units: DataFrame, nodes: DataFrame, given: DataFrame) -> DataFrame:
    """Split units by who joined them and open units for the rest of each node."""
    order = Window.partitionBy("g", "u").orderBy("q")
    parts = given.withColumn(
        "_from", F.coalesce(F.sum("x").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    )
    joined = parts.join(units.select("g", "u", "members"), ["g", "u"]).select(
        "g", F.col("u").withField("at", F.col("u.at") + F.col("_from")).alias("u"), F.col("x").alias("cap"),
        F.concat("members", F.array(F.struct("q.source", "q.lon", "q.lat", "q.grade").cast(_MEMBER))).alias("members"),
    )
    used = given.groupBy("g", "u").agg(F.sum("x").alias("_used"))
    rest = units.join(used, ["g", "u"], "left").withColumn("_used", F.coalesce("_used", F.lit(0))).select(
        "g", F.col("u").withField("at", F.col("u.at") + F.col("_used")).alias("u"),
        (F.col("cap") - F.col("_used")).alias("cap"), "members",
    )
    placed = given.groupBy("g", F.col("q").alias("ord")).agg(F.sum("x").alias("_placed"))
    fresh = nodes.join(placed, ["g", "ord"], "left").withColumn("n", F.col("n") - F.coalesce("_placed", F.lit(0)))
    opened = _open_units(fresh.filter(F.col("n") > 0))
    return joined.unionByName(rest.filter(F.col("cap") > 0)).unionByName(opened)


def building_units(
    points: DataFrame, group: str, source: str, lon: str, lat: str, grade: str, metres: float = 20.0
) -> DataFrame:
    """Units as weighted rows ``(g, u, cap, members)``; ``cap`` is how many alike units."""
    nodes = cut_lineage(_nodes(points, group, source, lon, lat, grade))
    units, last = None, None
    while True:
        later = nodes if last is None else nodes.filter(F.col("source") > last)
        names = [r[0] for r in later.groupBy("source").agg(F.lit(1)).orderBy("source").limit(NAMES).collect()]
        for name in names:
            arriving = nodes.filter(F.col("source") == name)
            units = _open_units(arriving) if units is None else cut_lineage(_next_units(units, arriving, _allocate(units, arriving, metres)))
        if len(names) < NAMES:
            return _open_units(nodes) if units is None else units
        last = names[-1]


def unit_summary(units: DataFrame) -> DataFrame:
    """J18 figures per group: units, units seen by several services, grade disagreements."""
    sources = F.array_distinct(F.transform("members", lambda m: m["source"]))
    grades = F.array_except(
        F.array_distinct(F.transform("members", lambda m: m["grade"])), F.array(F.lit(""))
    )
    shared = F.size(sources) > 1
    return units.groupBy(F.col("g").alias("group_key")).agg(
        F.sum("cap").alias("units"),
        F.sum(F.when(shared, F.col("cap")).otherwise(0)).alias("agreements"),
        F.sum(F.when(shared & (F.size(grades) > 1), F.col("cap")).otherwise(0)).alias("grade_disagreements"),
        F.sum(F.when(~shared, F.col("cap")).otherwise(0)).alias("single_source"),
    )


def exclusive_by_source(units: DataFrame) -> DataFrame:
    """Units that only one service saw, per service."""
    sources = F.array_distinct(F.transform("members", lambda m: m["source"]))
    lone = units.filter(F.size(sources) == 1)
    return lone.groupBy(F.col("g").alias("group_key"), F.col("members")[0]["source"].alias("source")).agg(
        F.sum("cap").alias("exclusive_units")
    )


def satellite_totals(points: DataFrame, units: DataFrame, place: str, source: str) -> DataFrame:
    """One row per place plus the overall row (NULL place) and points without place."""
    per_source = points.filter(F.col(place).isNotNull()).groupBy(F.col(place).alias("place")).agg(
        F.count("*").alias("points"), F.count_distinct(source).alias("sources")
    )
    solved = unit_summary(units).withColumnRenamed("group_key", "place")
    rows = per_source.join(solved, "place", "left").select(
        "place", "points", "sources", "units", "agreements", "grade_disagreements"
    )
    lost = points.agg(F.count_if(F.col(place).isNull()).alias("without_place"))
    overall = rows.agg(
        F.sum("points").alias("points"), F.max("sources").alias("sources"), F.sum("units").alias("units"),
        F.sum("agreements").alias("agreements"), F.sum("grade_disagreements").alias("grade_disagreements"),
    ).withColumn("place", F.lit(None).cast("string"))
    total = with_scalar(overall, lost)
    return rows.withColumn("without_place", F.lit(None).cast("bigint")).unionByName(total)


def evaluated_buildings(units: Column, *vendors: Column) -> Column:
    """Resolved units where the join exists, else the greatest single service."""
    return F.when(units > 0, units).otherwise(
        F.greatest(*[F.coalesce(v, F.lit(0)) for v in vendors])
        if len(vendors) > 1 else F.coalesce(vendors[0], F.lit(0))
    )
