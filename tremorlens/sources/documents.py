"""JSON-shaped bodies to rows.

Every parser takes a frame with a text column ``body`` and passes the other columns
(``snapshot_date``, ``path``, ...) through, so one job reads many days and events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlens.functions.dates import compact_day, epoch_ms_day, slash_day
from tremorlens.functions.geo import public_coordinate
from tremorlens.functions.numbers import parse_count, parse_number
from tremorlens.functions.web import present, vendor_link
from tremorlens.operators.spatial import grid_cells
from tremorlens.plans.joins import skew_join
from tremorlens.plans.rows import unnest, unnest_at, unnest_map

# Kinds of damage layer by the fragment their names carry.
LAYER_KINDS = {"builtUpP": "points", "ancillaryCrisisInfoP": "points", "transportationL": "lines", "notAnalysedA": "areas"}
UNDAMAGED = ["No visible damage", "Not Analysed"]

_ACTIVATION = (
    "struct<results:array<struct<code:string,name:string,category:string,subCategory:string,eventTime:string,"
    "activationTime:string,closed:boolean,gdacsId:string,countries:array<struct<name:string>>,centroid:string,extent:string,"
    "aois:array<struct<name:string,number:int,extent:string,products:array<struct<type:string,monitoring:boolean,"
    "monitoringNumber:int,feasible:boolean,expectedDelivery:string,downloadPath:string,"
    "version:struct<number:int,statusCode:string,deliveryTime:string>,layers:array<struct<name:string,json:string>>,"
    "stats:map<string,map<string,struct<unit:string,total:string,affected:string>>>>>>>>>>"
)
_FEATURES = "struct<features:array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>>"


def read_bodies(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Whole text files with their path and the day their folder names."""
    files = spark.read.text(paths, wholetext=True).select(F.col("value").alias("body"), F.col("_metadata.file_path").alias("path"))
    return files.withColumn("snapshot_date", F.regexp_extract("path", r"/(?:snapshot_date=)?(\d{4}-\d{2}-\d{2})/", 1).try_cast("date"))


def _rest(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "body"]


def activations(bodies: DataFrame) -> DataFrame:
    """One row per activation."""
    rows = unnest(bodies, _rest(bodies), F.from_json("body", _ACTIVATION)["results"], "a")
    return rows.select(
        *_rest(bodies), "a.code", "a.name", "a.category", F.col("a.subCategory").alias("sub_category"),
        F.col("a.eventTime").alias("event_time"), F.col("a.activationTime").alias("activation_time"),
        F.coalesce("a.closed", F.lit(False)).alias("closed"), F.col("a.gdacsId").alias("gdacs_id"),
        F.transform("a.countries", lambda c: c["name"]).alias("countries"),
        F.col("a.centroid").alias("centroid_wkt"), F.col("a.extent").alias("extent_wkt"), F.col("a.aois").alias("aois"),
    )


def activation_zones(acts: DataFrame) -> DataFrame:
    """The zones of each activation with their extent."""
    return acts.select("code", "snapshot_date", F.explode("aois").alias("z")).select(
        "code", "snapshot_date", F.col("z.name").alias("aoi_name"), F.col("z.number").alias("aoi_number"), F.col("z.extent").alias("extent_wkt")
    )


def _product_rows(acts: DataFrame) -> DataFrame:
    zones = acts.select("code", "snapshot_date", F.explode("aois").alias("z"))
    return zones.select(
        "code", "snapshot_date", F.col("z.name").alias("aoi_name"), F.col("z.number").alias("aoi_number"), F.explode("z.products").alias("p")
    )


def products(acts: DataFrame) -> DataFrame:
    """Product versions; missing numbers of monitoring and version mean the first."""
    return _product_rows(acts).select(
        "code", "aoi_name", "aoi_number", F.col("p.type").alias("ptype"), F.coalesce("p.monitoring", F.lit(False)).alias("monitoring"),
        F.coalesce("p.monitoringNumber", F.lit(0)).alias("monitoring_number"), F.coalesce("p.version.number", F.lit(0)).alias("version_number"),
        F.col("p.version.statusCode").alias("status_code"), F.coalesce("p.feasible", F.lit(False)).alias("feasible"),
        F.col("p.expectedDelivery").alias("expected_delivery"), F.col("p.version.deliveryTime").alias("delivery_time"),
        F.col("p.downloadPath").alias("download_path"), "snapshot_date",
    )


def stats(acts: DataFrame) -> DataFrame:
    """Damage statistics; the raw literal travels beside the parsed number."""
    rows = _product_rows(acts).select(
        "code", "aoi_name", F.col("p.type").alias("ptype"), F.coalesce("p.monitoringNumber", F.lit(0)).alias("monitoring_number"),
        F.coalesce("p.version.number", F.lit(0)).alias("version_number"), "snapshot_date", F.explode("p.stats").alias("category", "_subs"),
    ).select("*", F.explode("_subs").alias("subcategory", "_v")).filter(F.col("_v").isNotNull())
    return rows.select(
        "code", "aoi_name", "ptype", "monitoring_number", "version_number", "category", "subcategory", F.col("_v.unit").alias("unit"),
        parse_number(F.col("_v.total")).alias("total"), parse_number(F.col("_v.affected")).alias("affected"),
        F.col("_v.total").alias("total_raw"), F.col("_v.affected").alias("affected_raw"), "snapshot_date",
    )


def features(bodies: DataFrame) -> DataFrame:
    """GeoJSON features: properties as a map, geometry as type and raw coordinates."""
    return unnest_at(bodies, _rest(bodies), F.from_json("body", _FEATURES)["features"], "idx", "f").select(
        *_rest(bodies), "idx", F.coalesce("f.properties", F.create_map().cast("map<string,string>")).alias("properties"),
        F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"),
    )


def point_coordinates(rows: DataFrame) -> DataFrame:
    """Adds lon and lat of point features (NULL for other shapes)."""
    xy = F.when(F.col("geometry_type") == "Point", F.from_json("coordinates", "array<double>"))
    return rows.withColumn("lon", F.get(xy, 0)).withColumn("lat", F.get(xy, 1))


def damage_layers(bodies: DataFrame, zone_places: DataFrame) -> DataFrame:
    """Features tagged with zone, layer, kind and place; undamaged roads drop out.

    ``bodies`` also has ``layer_name`` and ``zone``; ``zone_places``: zone, place.
    """
    layer = F.coalesce(*[F.when(F.col("layer_name").contains(k), k) for k in LAYER_KINDS])
    kinds = F.create_map(*[F.lit(v) for pair in LAYER_KINDS.items() for v in pair])
    rows = features(bodies.withColumn("layer", layer).filter(F.col("layer").isNotNull()).withColumn("kind", kinds[F.col("layer")]))
    grade = F.col("properties")["damage_gra"]
    idle_road = (F.col("layer") == "transportationL") & (grade.isNull() | grade.isin(UNDAMAGED))
    located = point_coordinates(rows.withColumn("grade", grade).filter(~idle_road))
    return skew_join(located, zone_places.select("zone", "place"), ["zone"], "left")


def coverage_grid(bodies: DataFrame) -> DataFrame:
    """Grid header and its values, one row per document."""
    axis = "struct<start:double,stop:double,num:int>"
    shape = f"struct<domain:struct<axes:struct<x:{axis},y:{axis}>>,ranges:map<string,struct<values:array<double>>>>"
    doc = bodies.select(*_rest(bodies), F.from_json("body", shape).alias("d"))
    return doc.select(
        *_rest(bodies), F.col("d.domain.axes.x.start").alias("x0"), F.col("d.domain.axes.x.stop").alias("x1"), F.col("d.domain.axes.x.num").alias("nx"),
        F.col("d.domain.axes.y.start").alias("y0"), F.col("d.domain.axes.y.stop").alias("y1"), F.col("d.domain.axes.y.num").alias("ny"),
        F.try_element_at(F.map_values("d.ranges"), F.lit(1))["values"].alias("values"),
    )


def coverage_cells(bodies: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, ix, iy, value)``."""
    return grid_cells(coverage_grid(bodies), keys)


def registry_rows(bodies: DataFrame) -> DataFrame:
    """A bare list or ``{data: [...]}``; rows without place or date drop out."""
    row = "departamento:string,municipio:string,fecha_evento:string,evento:string," + ",".join(
        f"{c}:string" for c in ("familias", "personas", "destruidas", "averiadas", "habitables", "nohabitables")
    )
    items = F.when(F.trim("body").startswith("["), F.from_json("body", f"array<struct<{row}>>")).otherwise(
        F.from_json("body", f"struct<data:array<struct<{row}>>>")["data"]
    )
    rows = unnest(bodies, _rest(bodies), items, "r")
    typed = rows.select(
        *_rest(bodies), F.trim(F.coalesce("r.departamento", F.lit(""))).alias("departamento"), F.trim(F.coalesce("r.municipio", F.lit(""))).alias("municipio"),
        slash_day(F.col("r.fecha_evento")).alias("fecha"), F.col("r.evento").alias("evento"), parse_count(F.col("r.familias")).alias("familias"),
        parse_count(F.col("r.personas")).alias("personas"), parse_count(F.col("r.destruidas")).alias("viv_destruidas"),
        parse_count(F.col("r.averiadas")).alias("viv_averiadas"), parse_count(F.col("r.habitables")).alias("habitables"),
        parse_count(F.col("r.nohabitables")).alias("nohabitables"),
    )
    return typed.filter((F.col("municipio") != "") & F.col("fecha").isNotNull())


def attribute_pages(bodies: DataFrame, fields: dict[str, tuple[str, str]], key: str, epoch: list[str] = ()) -> DataFrame:
    """Pages of ``{features: [{attributes: {...}}]}`` to rows, one per key.

    ``fields``: output name -> (attribute, type); ``epoch`` names the millisecond dates.
    """
    schema = "struct<features:array<struct<attributes:struct<" + ",".join(f"`{a}`:{t}" for a, t in fields.values()) + ">>>>"
    rows = unnest(bodies, _rest(bodies), F.from_json("body", schema)["features"], "f")

    def value(name: str, attribute: str) -> Column:
        raw = F.col("f.attributes")[attribute]
        return (epoch_ms_day(raw) if name in epoch else raw).alias(name)

    flat = rows.select(*_rest(bodies), *[value(n, a) for n, (a, _) in fields.items()])
    return flat.dropDuplicates([key])


def volume_timeline(bodies: DataFrame) -> DataFrame:
    """Attention per day."""
    shape = "struct<timeline:array<struct<data:array<struct<date:string,value:double>>>>>"
    lines = unnest(bodies, _rest(bodies), F.from_json("body", shape)["timeline"], "t")
    points = unnest(lines, _rest(bodies), F.col("t.data"), "p")
    return points.select(*_rest(bodies), compact_day(F.col("p.date")).try_cast("date").alias("day"), F.col("p.value").alias("value")).filter("day IS NOT NULL")


def news_list(bodies: DataFrame) -> DataFrame:
    """Aggregated news; an empty source is absence, not an outlet."""
    shape = "array<struct<title:string,description:string,source:string,pubdate:string,link:string>>"
    rows = unnest(bodies, _rest(bodies), F.from_json("body", shape), "n")
    return rows.select(
        *_rest(bodies), F.trim("n.title").alias("title"), F.substring("n.description", 1, 300).alias("summary"),
        F.nullif(F.trim("n.source"), F.lit("")).alias("outlet"), F.substring("n.pubdate", 1, 19).alias("published"), F.col("n.link").alias("url"),
    )


def citizen_reports(bodies: DataFrame, origin: str = "chatmap") -> DataFrame:
    """One row per report; without an id, a hash of place and time stands in.

    Exact coordinates stay internal; only the rounded pair may be published.
    """
    rows = point_coordinates(features(bodies))
    p = F.col("properties")
    spaced = F.regexp_replace(F.coalesce("coordinates", F.lit("[null,null]")), r",\s*", ", ")
    stamp = F.when(p["time"].isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), p["time"], F.lit('"')))
    derived = F.substring(F.sha1(F.concat(F.lit("["), spaced, F.lit(", "), stamp, F.lit("]"))), 1, 16)
    return rows.select(
        *_rest(bodies), F.lit(origin).alias("origen"), F.coalesce(F.nullif(p["id"], F.lit("")), derived).alias("id_externo"),
        F.coalesce(p["time"], F.lit("")).alias("ts"), "lat", "lon", public_coordinate(F.col("lat")).alias("lat_pub"),
        public_coordinate(F.col("lon")).alias("lon_pub"), F.coalesce(p["file"], F.lit("")).alias("media_url"),
        F.coalesce(p["message"], F.lit("")).alias("mensaje"),
    )


def embedded_json(bodies: DataFrame, variable: str) -> DataFrame:
    """The object literal assigned to a script variable, as text ``object``."""
    return bodies.withColumn("object", F.nullif(F.regexp_extract("body", rf"(?s)var {variable} = (\{{.*?\}});\s*\n", 1), F.lit("")))


def embedded_products(bodies: DataFrame, variable: str = "js_data") -> DataFrame:
    """Products of the embedded action."""
    product = "struct<nProduit:string,nomAnnexes:string,echelle:string,type:string,imgPrincipale:string,dateProduction:string>"
    shape = f"struct<itemAction:struct<id:int,charte:string,produits:map<string,{product}>>>"
    doc = embedded_json(bodies, variable).withColumn("d", F.from_json("object", shape))
    keep = [*_rest(bodies), F.col("d.itemAction.id").alias("accion_id"), F.col("d.itemAction.charte").alias("charter")]
    rows = unnest_map(doc, keep, F.col("d.itemAction.produits"), "_id", "p")
    return rows.select(
        *_rest(bodies), F.col("_id").try_cast("bigint").alias("producto_id"), "accion_id", "charter", F.col("p.nProduit").alias("n_producto"),
        F.col("p.nomAnnexes").alias("nombre_base"), F.col("p.echelle").alias("escala"), F.col("p.type").alias("tipo"),
        F.col("p.imgPrincipale").alias("imagen_principal"), F.nullif(F.substring("p.dateProduction", 1, 10), F.lit("")).alias("fecha_produccion"),
    )


def vendor_listing(bodies: DataFrame, event_code: str) -> DataFrame:
    """Product ids of the event in the vendor's listing."""
    shape = "struct<products:array<struct<map_event:struct<id:bigint,glide:string,title:string>>>>"
    rows = unnest(bodies, [], F.from_json("body", shape)["products"], "p")
    return rows.filter(F.upper("p.map_event.glide") == event_code).select(F.col("p.map_event.id").alias("product_id")).filter("product_id IS NOT NULL").distinct()


def vendor_details(bodies: DataFrame, base: str) -> DataFrame:
    """Product rows with absolute links; a literal "None" is no link."""
    event = (
        "id:bigint,glide:string,title:string,description:string,created_at:string,sources:string,pdf_name:string,"
        "excel_table:string,shp_link:string,gdp_link:string"
    )
    doc = bodies.select(*_rest(bodies), F.from_json("body", f"struct<map_event:struct<{event}>,latitude:double,longitude:double>").alias("d"))
    m = F.col("d.map_event")
    pdf = F.concat(F.lit("/static/unosat_filesystem/"), m["id"].cast("string"), F.lit("/"), present(m["pdf_name"]))
    shp = F.trim(m["shp_link"])
    return doc.filter(m.isNotNull()).select(
        *_rest(bodies), m["id"].alias("product_id"), F.upper(m["glide"]).alias("glide"), m["title"].alias("titulo"), m["description"].alias("descripcion"),
        m["created_at"].alias("created_at"), F.col("d.latitude").alias("lat"), F.col("d.longitude").alias("lon"), vendor_link(pdf, base).alias("pdf_url"),
        F.nullif(F.when(shp.startswith("/"), F.concat(F.lit(base), shp)).otherwise(shp), F.lit("")).alias("shp_url"),
        vendor_link(m["gdp_link"], base).alias("gdb_url"), vendor_link(m["excel_table"], base).alias("xlsx_url"), m["sources"].alias("fuentes_texto"),
    )


def exposure_bands(bodies: DataFrame) -> DataFrame:
    """People per intensity band from two parallel arrays."""
    inner = "mmi:array<double>,aggregated_exposure:array<bigint>"
    doc = bodies.select(*_rest(bodies), F.from_json("body", f"struct<population_exposure:struct<{inner}>,{inner}>").alias("d"))
    levels = F.coalesce("d.population_exposure.mmi", "d.mmi")
    people = F.coalesce("d.population_exposure.aggregated_exposure", "d.aggregated_exposure")
    zipped = doc.select(*_rest(bodies), levels.alias("intensity"), people.alias("people"))
    return unnest(zipped, _rest(bodies), F.arrays_zip("intensity", "people"), "b").select(*_rest(bodies), "b.*").filter("intensity IS NOT NULL AND people IS NOT NULL")


def event_details(bodies: DataFrame) -> DataFrame:
    """Quake detail, felt testimonies and alert document in one row shape.

    ``bodies`` also has ``provider``; fields a provider does not have stay NULL.
    """
    props = (
        "mag:double,place:string,time:bigint,alert:string,felt:bigint,cdi:double,mmi:double,url:string,alertlevel:string,"
        "glide:string,name:string,datemodified:string,feltreportCount:bigint,last_update:string"
    )
    shape = f"struct<properties:struct<{props}>,geometry:struct<coordinates:array<double>>,features:array<struct<properties:struct<{props}>>>>"
    doc = bodies.select(*_rest(bodies), F.from_json("body", shape).alias("d"))
    p = F.coalesce("d.properties", F.try_element_at("d.features", F.lit(1))["properties"])
    return doc.filter(p.isNotNull()).select(
        *_rest(bodies), F.coalesce(p["place"], p["name"]).alias("place"), p["mag"].alias("mag"), F.timestamp_millis(p["time"]).alias("origin_time"),
        F.coalesce(p["alert"], p["alertlevel"]).alias("alert"), F.coalesce(p["felt"], p["feltreportCount"]).alias("felt"), p["mmi"].alias("mmi"),
        p["glide"].alias("glide"), F.get("d.geometry.coordinates", 0).alias("lon"), F.get("d.geometry.coordinates", 1).alias("lat"),
    )
