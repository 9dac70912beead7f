"""Text and names to places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlens.functions.geo import haversine_km
from tremorlens.functions.numbers import pad_code
from tremorlens.functions.text import admin_name, fold, title_es
from tremorlens.plans.joins import skew_join
from tremorlens.plans.terms import match_terms


def match_zones(texts: DataFrame, key: str, text: str, toponyms: DataFrame) -> DataFrame:
    """Distinct ``(key, zone)``; ``toponyms`` is (zone, term) with folded terms."""
    return match_terms(texts, key, text, toponyms.select("zone", "term")).select(key, "zone").distinct()


def place_arrays(texts: DataFrame, key: str, text: str, gazetteer: DataFrame, toponyms: DataFrame | None = None) -> DataFrame:
    """J01-J03 in one pass over the texts: per key the arrays zones, places, departments.

    ``gazetteer``: municipality, department, term, needs_department, homonym.  An
    ambiguous name counts only beside its department; a name shared with a department
    never counts.  Only the hits are shuffled; an array is at most as long as the
    dictionary.  Texts that name nothing are absent.
    """
    none = F.lit(None).cast("string")
    terms = gazetteer.filter(~F.col("homonym")).select("term", F.lit("place").alias("kind"), F.col("municipality").alias("name"), "department", "needs_department")
    own_names = gazetteer.select(
        fold(F.col("department")).alias("term"), F.lit("department").alias("kind"), none.alias("name"), "department", F.lit(False).alias("needs_department")
    ).distinct()
    terms = terms.unionByName(own_names)
    if toponyms is not None:
        terms = terms.unionByName(
            toponyms.select("term", F.lit("zone").alias("kind"), F.col("zone").alias("name"), none.alias("department"), F.lit(False).alias("needs_department"))
        )
    kind = F.col("kind")
    grouped = match_terms(texts, key, text, terms).groupBy(key).agg(
        F.collect_set(F.when(kind == "zone", F.col("name"))).alias("zones"),
        F.collect_set(F.when(kind == "place", F.struct("name", "department", "needs_department"))).alias("_named"),
        F.collect_set(F.when(kind == "department", F.col("department"))).alias("_own"),
    )
    kept = F.filter("_named", lambda m: ~m["needs_department"] | F.array_contains("_own", m["department"]))
    places = F.transform(kept, lambda m: F.struct(m["name"].alias("municipality"), m["department"].alias("department")))
    return grouped.select(
        key, "zones", F.array_distinct(places).alias("places"), F.array_union("_own", F.transform(kept, lambda m: m["department"])).alias("departments")
    )


def match_municipalities(texts: DataFrame, key: str, text: str, gazetteer: DataFrame) -> DataFrame:
    """Distinct ``(key, municipality, department)``."""
    return place_arrays(texts, key, text, gazetteer).select(key, F.inline("places"))


def match_departments(texts: DataFrame, key: str, text: str, gazetteer: DataFrame) -> DataFrame:
    """``(key, departments)``: those of matched municipalities and those the text names, sorted."""
    found = place_arrays(texts, key, text, gazetteer).select(key, F.array_sort("departments").alias("departments"))
    return found.filter(F.size("departments") > 0)


def add_declared(tagged: DataFrame, feed: str, feeds: DataFrame) -> DataFrame:
    """Places a feed declares join those read in the text.

    ``tagged`` has arrays ``municipalities`` and ``departments``; ``feeds`` has the feed
    id with ``feed_municipalities`` and ``feed_departments``.
    """
    joined = skew_join(tagged, feeds, [feed], "left")
    empty = F.array().cast("array<string>")

    def merged(own: str, extra: str) -> Column:
        return F.array_sort(F.array_union(F.coalesce(own, empty), F.coalesce(extra, empty)))

    return (
        joined.withColumn("municipalities", merged("municipalities", "feed_municipalities"))
        .withColumn("departments", merged("departments", "feed_departments"))
        .drop("feed_municipalities", "feed_departments")
    )


def tag_headlines(news: DataFrame, key: str, text: str, feed: str, toponyms: DataFrame, gazetteer: DataFrame, feeds: DataFrame) -> DataFrame:
    """J01-J04 together: each headline with sorted arrays of zones, municipalities, departments."""
    found = place_arrays(news, key, text, gazetteer, toponyms).select(
        key, F.array_sort("zones").alias("zones"), F.array_sort(F.transform("places", lambda p: p["municipality"])).alias("municipalities"), "departments"
    )
    empty = F.array().cast("array<string>")
    tagged = news.join(found, key, "left").withColumn("zones", F.coalesce("zones", empty))
    return add_declared(tagged, feed, feeds)


def place_key(name: Column, department: Column) -> Column:
    return F.concat_ws("|", fold(name), fold(department))


def _only_unique(catalog: DataFrame, key: str) -> DataFrame:
    """Keys that point at exactly one catalogue row."""
    return catalog.groupBy(key).agg(F.count("*").alias("_n"), F.first("_row").alias("_row")).filter("_n = 1").drop("_n")


def resolve_places(
    rows: DataFrame, key: str, name: Column, department: Column, code: Column, catalog: DataFrame, payload: list[str]
) -> DataFrame:
    """Exact key, else a unique normalised key, else a unique code.

    ``catalog`` has name, department, code and the payload columns.  Adds the payload
    (NULL when nothing resolves) and ``resolved_by``.
    """
    row = F.struct(*payload)
    base = catalog.select(
        place_key(F.col("name"), F.col("department")).alias("_k1"),
        F.concat_ws("|", admin_name(F.col("name")), admin_name(F.col("department"))).alias("_k2"),
        pad_code(F.col("code")).alias("_k3"), row.alias("_row"),
    )
    exact = base.groupBy("_k1").agg(F.max("_row").alias("_r1"))
    loose = _only_unique(base, "_k2").withColumnRenamed("_row", "_r2")
    coded = _only_unique(base.filter("_k3 != ''"), "_k3").withColumnRenamed("_row", "_r3")
    keyed = (
        rows.withColumn("_k1", place_key(name, department))
        .withColumn("_k2", F.concat_ws("|", admin_name(name), admin_name(department)))
        .withColumn("_k3", F.nullif(pad_code(code), F.lit("")))
    )
    joined = skew_join(keyed, exact, ["_k1"], "left", spread=F.col(key))
    joined = skew_join(joined, loose, ["_k2"], "left", spread=F.col(key))
    joined = skew_join(joined, coded, ["_k3"], "left", spread=F.col(key))
    found = F.coalesce("_r1", "_r2", "_r3")
    how = F.when(F.col("_r1").isNotNull(), "exact").when(F.col("_r2").isNotNull(), "name").when(F.col("_r3").isNotNull(), "code")
    return (
        joined.withColumn("resolved_by", how).withColumns({c: found[c] for c in payload})
        .drop("_k1", "_k2", "_k3", "_r1", "_r2", "_r3")
    )


def registry_by_alias(places: DataFrame, registry: DataFrame, payload: list[str]) -> DataFrame:
    """Registry row of a place by its name or, in order, by any other name it has.

    ``places``: municipality, department, aliases (array, own name first); ``registry``:
    department, municipality and the payload.
    """
    names = places.select(
        "municipality", fold(F.col("department")).alias("_d"), F.posexplode("aliases").alias("_rank", "_alias")
    ).withColumn("_m", fold(F.col("_alias")))
    rows = registry.select(
        fold(F.col("department")).alias("_d"), fold(F.col("municipality")).alias("_m"), F.struct(*payload).alias("_row")
    )
    best = names.join(rows, ["_d", "_m"]).groupBy("municipality", "_d").agg(
        F.min_by("_row", F.struct("_rank", "_row")).alias("_row")
    )
    keyed = places.withColumn("_d", fold(F.col("department")))
    return keyed.join(best, ["municipality", "_d"], "left").select(
        *places.columns, *[F.col("_row")[c].alias(c) for c in payload]
    )


def missing_places(registry: DataFrame, places: DataFrame, catalog: DataFrame) -> DataFrame:
    """Registered places absent from the curated list, as guarded dimension rows.

    ``places`` as in J11; ``catalog``: name, department, code, lat, lon.
    """
    covered = places.select(
        admin_name(F.col("department")).alias("_d"), F.explode("aliases").alias("_alias")
    ).select("_d", admin_name(F.col("_alias")).alias("_m")).distinct()
    fresh = (
        registry.select("department", "municipality").distinct()
        .withColumn("_d", admin_name(F.col("department"))).withColumn("_m", admin_name(F.col("municipality")))
        .join(covered, ["_d", "_m"], "left_anti").drop("_d", "_m")
    )
    located = resolve_places(
        fresh, "municipality", F.col("municipality"), F.col("department"), F.lit(None).cast("string"),
        catalog, ["code", "lat", "lon"],
    )
    homonyms = catalog.select(fold(F.col("department")).alias("_m")).distinct().withColumn("_same", F.lit(True))
    return (
        skew_join(located.withColumn("_m", fold(F.col("municipality"))), homonyms, ["_m"], "left")
        .select(
            title_es(F.col("municipality")).alias("municipality"), title_es(F.col("department")).alias("department"),
            "code", "lat", "lon", F.array("_m").alias("aliases"), F.lit(True).alias("needs_department"),
            F.coalesce("_same", F.lit(False)).alias("homonym"),
        )
    )


def felt_cells(cells: DataFrame, places: DataFrame, radius_km: float = 30.0) -> DataFrame:
    """Intensity cells to the one place of that name nearby, summed per place.

    ``cells``: cell_id, label, lon, lat, cdi, responses, dist; ``places``: municipality,
    aliases, lat, lon.  A name carried by several places is attributed to none.
    """
    names = places.select("municipality", "lat", "lon", F.explode("aliases").alias("_alias")).select(
        "municipality", F.col("lat").alias("_plat"), F.col("lon").alias("_plon"), fold(F.col("_alias")).alias("_name")
    ).distinct()
    unique = names.groupBy("_name").agg(
        F.count_distinct("municipality").alias("_n"), F.first(F.struct("municipality", "_plat", "_plon")).alias("_p")
    ).filter("_n = 1")
    label = F.coalesce(F.nullif(F.regexp_extract("label", r"<br>([^<]+)$", 1), F.lit("")), F.col("label"))
    tagged = cells.withColumn("_name", fold(F.trim(label)))
    pairs = skew_join(tagged, unique, ["_name"], spread=F.col("cell_id")).select("*", "_p.*")
    near = F.coalesce(
        haversine_km(F.col("_plat"), F.col("_plon"), F.col("lat"), F.col("lon")) <= radius_km, F.lit(True)
    )
    return pairs.filter(near).groupBy("municipality").agg(
        F.max("cdi").alias("felt_max_cdi"), F.sum("responses").alias("felt_responses"),
        F.count("*").alias("felt_cells"), F.min("dist").alias("felt_min_dist"),
    )


def official_evidence(bridge: DataFrame, registry: DataFrame) -> DataFrame:
    """Zone to its official municipalities to registry rows, as evidence rows.

    ``bridge``: zone, department, municipality; ``registry`` adds families, persons,
    destroyed, damaged, day.
    """
    amount = [F.format_string("%.0f", F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in ("families", "persons", "destroyed", "damaged")]
    quote = F.concat(
        F.lit("RUD "), "municipality", F.lit(" ("), "department", F.lit("): "), amount[0], F.lit(" familias, "),
        amount[1], F.lit(" personas, "), amount[2], F.lit(" viviendas destruidas, "), amount[3], F.lit(" averiadas"),
    )
    return skew_join(registry, bridge, ["department", "municipality"]).select(
        "zone", F.lit("oficial").alias("kind"), F.col("day"), quote.alias("quote")
    )
