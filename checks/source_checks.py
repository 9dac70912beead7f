"""Readers and writers: bodies that Spark derives from the tables, parsed back."""

from __future__ import annotations

import io
import json
import struct
import zipfile

from pyspark.sql import functions as F

from checks.base import GAZETTEER, POINTS_SQL, gazetteer, points, query, scratch, table, values
from tremorlens.operators import citizen, snapshots
from tremorlens.sources import archives, documents, feeds, landing, sinks, tables

def _json(column):
    return F.to_json(column, {"ignoreNullFields": "false"})


# ---------------------------------------------------------------- S01
@query("S01", "SELECT o_orderkey, o_custkey FROM orders WHERE CAST(o_orderdate AS DATE) = (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)")
def s01(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("snapshot_date"))
    return snapshots.latest_snapshot(rows).select("o_orderkey", "o_custkey")


# ---------------------------------------------------------------- S02
def _activation_bodies(spark, d):
    """One document per nation: market segments are zones, each with one product."""
    per = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    total = F.when(F.col("n") % 4 == 0, "NA").otherwise(F.concat(F.col("n").cast("string"), F.lit(",000")))
    stat = lambda affected: F.create_map(F.lit("All"), F.struct(F.lit("no").alias("unit"), total.alias("total"), affected.alias("affected")))
    stats = F.create_map(F.lit("Built-up"), stat(F.col("n").cast("string")), F.lit("Estimated population"), stat(F.lit("-")))
    version = F.struct(F.lit(2).alias("number"), F.when(F.col("n") % 2 == 0, "F").otherwise("W").alias("statusCode"), F.lit("2026-08-14T10:00:00").alias("deliveryTime"))
    product = F.struct(F.lit("GRA").alias("type"), F.lit(True).alias("monitoring"), F.when(F.col("n") % 3 != 0, 1).alias("monitoringNumber"), version.alias("version"), stats.alias("stats"))
    zone = F.struct(F.col("c_mktsegment").alias("name"), F.length("c_mktsegment").alias("number"), F.array(product).alias("products"))
    grouped = per.groupBy("c_nationkey").agg(F.collect_list(zone).alias("aois"))
    named = grouped.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    act = F.struct(
        F.concat(F.lit("EMSR"), F.col("n_nationkey").cast("string")).alias("code"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 2 == 0).alias("closed"),
        F.array(F.struct(F.col("n_regionkey").cast("string").alias("name"))).alias("countries"), "aois",
    )
    return named.select(F.lit("2026-08-22").cast("date").alias("snapshot_date"), _json(F.struct(F.array(act).alias("results"))).alias("body"))


_SEGMENTS = "c AS (SELECT 'EMSR' || c_nationkey AS code, c_mktsegment AS aoi_name, count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment)"


@query(
    "S02",
    f"""WITH {_SEGMENTS} SELECT code, aoi_name, v.category, CAST(CASE WHEN n % 4 = 0 THEN NULL ELSE n * 1000 END AS DOUBLE) AS total,
      CAST(CASE WHEN v.category = 'Built-up' THEN n END AS DOUBLE) AS affected, CASE WHEN n % 4 = 0 THEN 'NA' ELSE n || ',000' END AS total_raw
    FROM c CROSS JOIN (VALUES ('Built-up'), ('Estimated population')) AS v(category)""",
)
def s02(spark, d):
    acts = documents.activations(_activation_bodies(spark, d))
    return documents.stats(acts).select("code", "aoi_name", "category", "total", "affected", "total_raw")


@query(
    "S02_products",
    f"""WITH {_SEGMENTS} SELECT code, aoi_name, 'GRA' AS ptype, CAST(CASE WHEN n % 3 <> 0 THEN 1 ELSE 0 END AS INTEGER) AS monitoring_number,
      CASE WHEN n % 2 = 0 THEN 'F' ELSE 'W' END AS status_code, CAST(substr(code, 5) AS INTEGER) % 2 = 0 AS closed FROM c""",
)
def s02_products(spark, d):
    acts = documents.activations(_activation_bodies(spark, d))
    return documents.products(acts).join(acts.select("code", "closed"), "code").select("code", "aoi_name", "ptype", "monitoring_number", "status_code", "closed")


# ---------------------------------------------------------------- S03
LAYERS = ["X_builtUpP_v1", "X_transportationL_v1", "X_ancillaryCrisisInfoP_v1", "X_other_v1"]


def _feature_bodies(spark, d):
    """Documents of at most fifty features."""
    p = points(spark, d)
    layer = F.get(F.array(*[F.lit(x) for x in LAYERS]), F.col("label") % 4)
    grade = F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 5 == 1, "No visible damage").otherwise(F.col("grade"))
    feature = F.struct(
        F.struct(F.col("id").alias("id"), grade.alias("damage_gra")).alias("properties"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
    )
    keyed = p.select(layer.alias("layer_name"), F.concat(F.lit("Z"), F.col("label").cast("string")).alias("zone"), F.floor(F.col("id") / 50).alias("part"), feature.alias("f"))
    return keyed.groupBy("layer_name", "zone", "part").agg(F.collect_list("f").alias("features")).select(
        "layer_name", "zone", _json(F.struct("features")).alias("body")
    )


@query(
    "S03",
    f"""WITH {POINTS_SQL}, f AS (SELECT id, lon, lat, 'Z' || label AS zone, (['builtUpP','transportationL','ancillaryCrisisInfoP',NULL])[label % 4 + 1] AS layer,
      CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'No visible damage' ELSE grade END AS g, CASE WHEN label < 6 THEN 'M' || label END AS place FROM points)
    SELECT CAST(id AS VARCHAR) AS id, zone, layer, CASE layer WHEN 'transportationL' THEN 'lines' ELSE 'points' END AS kind, g AS grade, lon, lat, place FROM f
    WHERE layer IS NOT NULL AND NOT (layer = 'transportationL' AND (g IS NULL OR g = 'No visible damage'))""",
)
def s03(spark, d):
    places = points(spark, d).filter("label < 6").select(
        F.concat(F.lit("Z"), F.col("label").cast("string")).alias("zone"), F.concat(F.lit("M"), F.col("label").cast("string")).alias("place")
    ).distinct()
    out = documents.damage_layers(_feature_bodies(spark, d), places)
    return out.select(F.col("properties")["id"].alias("id"), "zone", "layer", "kind", "grade", "lon", "lat", "place")


# ---------------------------------------------------------------- S04
@query("S04", "SELECT p_partkey // 100 AS doc, p_partkey % 10 AS ix, (p_partkey % 100) // 10 AS iy, p_retailprice AS value FROM part")
def s04(spark, d):
    part = table(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 100).alias("doc")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "p_retailprice"))), lambda v: v["p_retailprice"]).alias("values")
    )
    axis = lambda: F.struct(F.lit(0.0).alias("start"), F.lit(9.0).alias("stop"), F.lit(10).alias("num"))
    doc = F.struct(
        F.struct(F.struct(axis().alias("x"), axis().alias("y")).alias("axes")).alias("domain"), F.create_map(F.lit("MMI"), F.struct("values")).alias("ranges")
    )
    return documents.coverage_cells(part.select("doc", _json(doc).alias("body")), ["doc"])


# ---------------------------------------------------------------- S05
def _feed_bodies(spark, d):
    k = F.col("page_id")
    key = k.cast("string")
    title = F.concat(F.lit("Titular "), key, F.lit(" &amp; más"))
    source = F.when(k % 3 == 0, F.concat(F.lit('<source url="https://www.Outlet'), (k % 7).cast("string"), F.lit('.example/x">La Voz</source>'))).otherwise("")
    rss = F.concat(
        F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>Feed</title><item><title>'), title, F.lit("</title><link>https://n.example/"), key,
        F.lit("</link><pubDate>Sat, 22 Aug 2026 10:"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit(":00 GMT</pubDate><description>cuerpo</description>"), source,
        F.lit("</item><item><title>sin enlace</title></item></channel></rss>"),
    )
    atom = F.concat(
        F.lit('<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><entry><title>'), title, F.lit('</title><link href="https://n.example/'), key,
        F.lit('"/><updated>2026-08-21T09:00:00Z</updated><summary>resumen</summary></entry></feed>'),
    )
    return table(spark, d, "pages").select(k, F.when(k % 5 == 4, F.lit("<rss><channel><item>")).when(k % 5 == 3, atom).otherwise(rss).alias("body"))


@query(
    "S05",
    """SELECT page_id, 'Titular ' || page_id || ' & más' AS title, 'https://n.example/' || page_id AS url,
      CASE WHEN page_id % 5 = 3 THEN '2026-08-21T09:00:00' ELSE '2026-08-22T10:' || lpad(CAST(page_id % 60 AS VARCHAR), 2, '0') || ':00' END AS published,
      CASE WHEN page_id % 5 = 3 THEN 'resumen' ELSE 'cuerpo' END AS summary, CASE WHEN page_id % 5 <> 3 AND page_id % 3 = 0 THEN 'La Voz' END AS outlet,
      CASE WHEN page_id % 5 <> 3 AND page_id % 3 = 0 THEN 'outlet' || page_id % 7 || '.example' END AS outlet_domain FROM pages WHERE page_id % 5 <> 4""",
)
def s05(spark, d):
    return feeds.feed_entries(_feed_bodies(spark, d))


# ---------------------------------------------------------------- S06, S07
@query(
    "S06",
    """SELECT o_orderstatus AS departamento, o_orderpriority AS municipio, strftime(o_orderdate, '%Y-%m-%d') AS fecha,
      o_custkey * 1000 AS familias, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey END AS personas FROM orders WHERE o_orderkey % 9 <> 0""",
)
def s06(spark, d):
    k = F.col("o_orderkey")
    row = F.struct(
        F.concat(F.lit(" "), "o_orderstatus").alias("departamento"), F.when(k % 9 == 0, "").otherwise(F.col("o_orderpriority")).alias("municipio"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("fecha_evento"), F.concat(F.col("o_custkey").cast("string"), F.lit(".000")).alias("familias"),
        F.when(k % 4 == 0, "NA").otherwise(k.cast("string")).alias("personas"),
    )
    grouped = table(spark, d, "orders").groupBy(F.floor(k / 20).alias("part")).agg(F.collect_list(row).alias("data"))
    bodies = grouped.select(F.when(F.col("part") % 2 == 0, _json(F.col("data"))).otherwise(_json(F.struct("data"))).alias("body"))
    return documents.registry_rows(bodies).select("departamento", "municipio", "fecha", "familias", "personas")


@query(
    "S07",
    "SELECT CAST(o_orderkey AS VARCHAR) AS external_id, CAST(o_orderdate AS DATE) AS fecha, o_orderpriority AS municipio, o_totalprice AS personas FROM orders",
)
def s07(spark, d):
    attributes = F.struct(
        F.col("o_orderkey").cast("string").alias("OBJECTID"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("FECHA"),
        F.col("o_orderpriority").alias("MUNICIPIO"), F.col("o_totalprice").alias("PERSONAS"),
    )
    feature = F.struct(attributes.alias("attributes"))
    bodies = table(spark, d, "orders").groupBy(F.floor(F.col("o_orderkey") / 50).alias("page")).agg(F.collect_list(feature).alias("features")).select(
        _json(F.struct("features")).alias("body")
    )
    fields = {"external_id": ("OBJECTID", "string"), "fecha": ("FECHA", "bigint"), "municipio": ("MUNICIPIO", "string"), "personas": ("PERSONAS", "double")}
    return documents.attribute_pages(bodies, fields, "external_id", ["fecha"])


# ---------------------------------------------------------------- S08, S09
@query(
    "S08",
    """WITH c AS (SELECT n_name, r_name, n_nationkey, count(*) AS n, count(*) FILTER (c_custkey % 2 = 0) AS u FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
    SELECT lower(n_name) || '|' || lower(r_name) AS place_key, n_name AS municipality, n AS population, u AS urban, CASE WHEN n_nationkey % 3 <> 0 THEN n - u END AS rural FROM c""",
)
def s08(spark, d):
    base = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(
        table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    urban = F.count_if(F.col("c_custkey") % 2 == 0)
    per = base.groupBy(F.col("r_name").alias("department"), F.col("n_name").alias("municipality"), F.col("n_nationkey").alias("code")).agg(
        F.count("*").alias("Total"), urban.alias("Cabecera Municipal"), (F.count("*") - urban).alias("Centros Poblados y Rural Disperso")
    )
    long = per.unpivot(["department", "municipality", "code"], list(tables.AREAS), "area", "total").filter("NOT (area LIKE 'Centros%' AND code % 3 = 0)")
    years = long.withColumn("year", F.explode(F.array(F.lit(2025), F.lit(2026)))).withColumn("total", F.when(F.col("year") == 2026, F.col("total")).otherwise(0))
    return tables.population(years, 2026).select("place_key", "municipality", "population", "urban", "rural")


@query(
    "S09",
    """SELECT lower(s_name) || '|' || lower(n_name) AS place_key, CASE WHEN s_suppkey % 6 <> 0 THEN s_acctbal END AS lat, s_acctbal AS lon, s_suppkey % 6 = 0 AS no_coordinates
    FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 10 <> 7""",
)
def s09(spark, d):
    comma = F.replace(F.format_string("%.2f", "s_acctbal"), F.lit("."), F.lit(","))
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.when(F.col("s_suppkey") % 10 != 7, F.col("s_name")).alias("name"), F.col("n_name").alias("department"), F.col("s_suppkey").cast("string").alias("code"),
        F.when(F.col("s_suppkey") % 6 == 0, "None").otherwise(comma).alias("lat_text"), comma.alias("lon_text"),
    )
    return tables.place_catalogue(rows).select("place_key", "lat", "lon", "no_coordinates")


# ---------------------------------------------------------------- S10, S11, S12
@query("S10", "SELECT event_id // 50 AS doc, CAST(ts AS DATE) AS day, value FROM events WHERE event_id % 13 <> 0")
def s10(spark, d):
    stamp = F.when(F.col("event_id") % 13 == 0, "2024").otherwise(F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"))
    point = F.struct(stamp.alias("date"), "value")
    bodies = table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 50).alias("doc")).agg(F.collect_list(point).alias("data"))
    return documents.volume_timeline(bodies.select("doc", _json(F.struct(F.array(F.struct("data")).alias("timeline"))).alias("body")))


@query(
    "S11",
    """SELECT md5(trim(text)) AS title_hash, substring(text, 1, 300) AS summary, CASE WHEN doc_id % 4 <> 0 THEN source END AS outlet, '2026-08-20T10:00:00' AS published, 'https://n.example/' || doc_id AS url FROM documents""",
)
def s11(spark, d):
    k = F.col("doc_id")
    item = F.struct(
        F.col("text").alias("title"), F.col("text").alias("description"), F.when(k % 4 == 0, " ").otherwise(F.col("source")).alias("source"),
        F.lit("2026-08-20T10:00:00.000Z").alias("pubdate"), F.concat(F.lit("https://n.example/"), k.cast("string")).alias("link"),
    )
    bodies = table(spark, d, "documents").groupBy(F.floor(k / 20).alias("part")).agg(F.collect_list(item).alias("items")).select(_json(F.col("items")).alias("body"))
    return documents.news_list(bodies).select(F.md5(F.col("title").cast("binary")).alias("title_hash"), "summary", "outlet", "published", "url")


@query(
    "S12",
    f"""WITH {POINTS_SQL} SELECT CASE WHEN id % 4 <> 0 THEN 'r' || id END AS known_id, CAST(CASE WHEN id % 4 <> 0 THEN length('r' || id) ELSE 16 END AS INTEGER) AS id_length,
      CASE WHEN id % 6 = 0 THEN '' ELSE '2026-08-11T00:00:' || lpad(CAST(id % 60 AS VARCHAR), 2, '0') END AS ts, round(lat, 3) + 0.0::DOUBLE AS lat_pub, round(lon, 3) + 0.0::DOUBLE AS lon_pub, lon FROM points""",
)
def s12(spark, d):
    k = F.col("id")
    props = F.struct(
        F.when(k % 4 != 0, F.concat(F.lit("r"), k.cast("string"))).alias("id"),
        F.when(k % 6 != 0, F.concat(F.lit("2026-08-11T00:00:"), F.lpad((k % 60).cast("string"), 2, "0"))).alias("time"),
    )
    feature = F.struct(props.alias("properties"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"))
    bodies = points(spark, d).groupBy(F.floor(k / 50).alias("part")).agg(F.collect_list(feature).alias("features")).select(_json(F.struct("features")).alias("body"))
    out = documents.citizen_reports(bodies)
    return out.select(
        F.when(F.col("id_externo").startswith("r"), F.col("id_externo")).alias("known_id"), F.length("id_externo").alias("id_length"), "ts", "lat_pub", "lon_pub", "lon"
    )


# ---------------------------------------------------------------- S13, S14: archives built from the points, fifty to a file
def _packed(spark, d, kind: str):
    def build(key, group):
        import pandas as pd

        part = int(key[0])
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            if kind == "geojson":
                found = [
                    {"type": "Feature", "properties": {"DAMAGE": g, "ID": int(i)}, "geometry": {"type": "Point", "coordinates": [x, y]}}
                    for i, x, y, g in zip(group["id"], group["lon"], group["lat"], group["grade"], strict=True)
                ]
                z.writestr(f"v/A_{part}_UrbanP.geojson", json.dumps({"features": found}))
                area = {"properties": {"AREA_HA": 100.0 + part}, "geometry": None}
                z.writestr(f"v/A_{part}_AreaOfInterest.geojson", json.dumps({"features": [area]}))
            else:
                name = f"S_20260811_BuildingDamage_{part}"
                shapes = b"".join(
                    struct.pack(">ii", n + 1, 10) + struct.pack("<idd", 1, x, y) for n, (x, y) in enumerate(zip(group["lon"], group["lat"], strict=True))
                )
                z.writestr(name + ".shp", struct.pack(">i", 9994) + b"\0" * 96 + shapes)
                fields = [("Main_Dmg" if part % 2 else "d_Main_Dam", 20), ("ID", 12)]
                head = b"".join(n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([w, 0]) + b"\0" * 14 for n, w in fields)
                records = b"".join(b" " + g.encode().ljust(20) + str(int(i)).encode().rjust(12) for g, i in zip(group["grade"], group["id"], strict=True))
                z.writestr(name + ".dbf", b"\x03\0\0\0" + struct.pack("<IHH", len(group), 32 + len(head) + 1, 33) + b"\0" * 20 + head + b"\r" + records)
                z.writestr(name + ".prj", 'GEOGCS["WGS 84"]' if part % 3 else 'PROJCS["UTM"]')
        body = buffer.getvalue()
        return pd.DataFrame({"path": [f"f{part}.zip"], "package_sha": [f"sha{part}"], "length": [len(body)], "content": [body]})

    rows = points(spark, d).withColumn("part", F.floor(F.col("id") / 50)).select("part", "id", "lon", "lat", "grade")
    return rows.groupBy("part").applyInPandas(build, "path string, package_sha string, length bigint, content binary")


@query(
    "S13",
    f"WITH {POINTS_SQL} SELECT CAST(id AS VARCHAR) AS id, lon, lat, grade FROM points WHERE (id // 50) % 3 <> 0",
)
def s13(spark, d):
    found, _ = archives.unpack(_packed(spark, d, "shapefile"), "shapefile", "BuildingDamage")
    identity = found.select("package_sha", "layer", "idx", F.col("properties")["ID"].alias("id"))
    return archives.vendor_points(found).join(identity, ["package_sha", "layer", "idx"]).select("id", "lon", "lat", "grade")


@query(
    "S14",
    f"WITH {POINTS_SQL} SELECT lon, lat, grade, 'UrbanP' AS layer, round((100.0::DOUBLE + id // 50) / 100, 2) AS area_km2 FROM points",
)
def s14(spark, d):
    found, _ = archives.unpack(_packed(spark, d, "geojson"), "geojson")
    return archives.graded_points(found).join(archives.analysed_area(found), "package_sha", "left").select("lon", "lat", "grade", "layer", "area_km2")


# ---------------------------------------------------------------- S15 - S19
@query("S15", "SELECT p_partkey AS producto_id, p_name AS nombre_base, CAST(p_size AS VARCHAR) AS escala, CASE WHEN p_partkey % 2 = 0 THEN '2026-08-12' END AS fecha_produccion FROM part")
def s15(spark, d):
    product = F.struct(
        F.col("p_name").alias("nomAnnexes"), F.col("p_size").cast("string").alias("echelle"), F.when(F.col("p_partkey") % 2 == 0, "2026-08-12T01:00").alias("dateProduction")
    )
    entry = F.struct(F.col("p_partkey").cast("string").alias("key"), product.alias("value"))
    grouped = table(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 20).alias("page")).agg(F.map_from_entries(F.collect_list(entry)).alias("produits"))
    data = _json(F.struct(F.struct(F.lit(845).alias("id"), "produits").alias("itemAction")))
    bodies = grouped.select(F.concat(F.lit("<html><script>var other = {};\nvar js_data = "), data, F.lit(";\n</script></html>")).alias("body"))
    return documents.embedded_products(bodies).select("producto_id", "nombre_base", "escala", "fecha_produccion")


@query(
    "S16",
    """SELECT s_suppkey AS product_id, 'EQ20260810COL' AS glide, CASE WHEN s_suppkey % 3 <> 0 THEN 'https://v.example/static/unosat_filesystem/' || s_suppkey || '/map.pdf' END AS pdf_url,
      'https://v.example/z/' || s_suppkey || '.zip' AS shp_url, CASE WHEN s_suppkey % 4 <> 0 THEN 'https://v.example/x/' || s_suppkey END AS xlsx_url, s_acctbal AS lat FROM supplier WHERE s_suppkey % 5 <> 0""",
)
def s16(spark, d):
    k = F.col("s_suppkey")
    key = k.cast("string")
    event = F.struct(
        k.alias("id"), F.when(k % 5 == 0, "OTHER").otherwise("eq20260810col").alias("glide"), F.when(k % 3 == 0, "None").otherwise("map.pdf").alias("pdf_name"),
        F.concat(F.lit("/z/"), key, F.lit(".zip")).alias("shp_link"), F.concat(F.lit("/x/"), F.when(k % 4 == 0, "None").otherwise(key)).alias("excel_table"),
    )
    base = table(spark, d, "supplier")
    listing = base.groupBy(F.floor(k / 11).alias("page")).agg(F.collect_list(F.struct(event.alias("map_event"))).alias("products")).select(_json(F.struct("products")).alias("body"))
    details = base.select(_json(F.struct(event.alias("map_event"), F.col("s_acctbal").alias("latitude"))).alias("body"))
    ids = snapshots.known_ids(documents.vendor_listing(listing, "EQ20260810COL"))
    return documents.vendor_details(details, "https://v.example").join(ids, "product_id", "left_semi").select("product_id", "glide", "pdf_url", "shp_url", "xlsx_url", "lat")


@query(
    "S17",
    "SELECT l_orderkey % 100 AS doc, CAST(l_linenumber AS DOUBLE) AS intensity, count(*) AS people FROM lineitem GROUP BY ALL",
)
def s17(spark, d):
    per = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 100).alias("doc"), F.col("l_linenumber").cast("double").alias("mmi")).agg(F.count("*").alias("n"))
    rows = per.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("mmi", "n"))).alias("b"))
    arrays = F.struct(F.transform("b", lambda x: x["mmi"]).alias("mmi"), F.transform("b", lambda x: x["n"]).alias("aggregated_exposure"))
    body = F.when(F.col("doc") % 2 == 0, _json(F.struct(arrays.alias("population_exposure")))).otherwise(_json(arrays))
    return documents.exposure_bands(rows.select("doc", body.alias("body")))


@query(
    "S18",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN value END AS mag, CASE event_id % 3 WHEN 0 THEN event_type WHEN 2 THEN 'alert ' || event_id END AS place,
      CASE event_id % 3 WHEN 0 THEN user_id WHEN 1 THEN user_id * 2 END AS felt, CASE event_id % 3 WHEN 2 THEN 'Orange' END AS alert, CASE event_id % 3 WHEN 0 THEN -76.25::DOUBLE END AS lon FROM events""",
)
def s18(spark, d):
    k = F.col("event_id")
    quake = F.struct(
        F.struct(F.col("value").alias("mag"), F.col("event_type").alias("place"), F.col("user_id").alias("felt")).alias("properties"),
        F.struct(F.array(F.lit(-76.25), F.lit(4.5), F.lit(10.0)).alias("coordinates")).alias("geometry"),
    )
    felt = F.struct(F.array(F.struct(F.struct((F.col("user_id") * 2).alias("feltreportCount")).alias("properties"))).alias("features"))
    alert = F.struct(F.struct(F.lit("Orange").alias("alertlevel"), F.concat(F.lit("alert "), k.cast("string")).alias("name")).alias("properties"))
    body = F.when(k % 3 == 0, _json(quake)).when(k % 3 == 1, _json(felt)).otherwise(_json(alert))
    return documents.event_details(table(spark, d, "events").select(k, body.alias("body"))).select("event_id", "mag", "place", "felt", "alert", "lon")


@query(
    "S19",
    f"""WITH g(municipality, department, term, needs, homonym) AS (VALUES {values(GAZETTEER)}),
    r AS (SELECT 'feed-' || page_id AS id, CASE WHEN page_id % 3 = 0 THEN 'M' || page_id % 4 END AS place FROM pages WHERE page_id % 7 <> 0 AND page_id % 5 <> 0)
    SELECT id, place FROM r UNION ALL SELECT 'googlenews-municipio-' || lower(municipality), municipality FROM g WHERE NOT homonym""",
)
def s19(spark, d):
    k = F.col("page_id")
    feed = F.struct(
        F.concat(F.lit("feed-"), k.cast("string")).alias("id"), F.when(k % 5 == 0, "builtin").otherwise("rss").alias("tipo"), F.col("url").alias("url"), (k % 7 != 0).alias("activo"),
        F.when(k % 3 == 0, F.array(F.concat(F.lit("M"), (k % 4).cast("string")))).alias("municipios"),
    )
    bodies = table(spark, d, "pages").groupBy(F.floor(k / 25).alias("p")).agg(F.collect_list(feed).alias("feeds")).select(_json(F.struct("feeds")).alias("body"))
    return feeds.active_feeds(feeds.registered_feeds(bodies), feeds.place_feeds(gazetteer(spark))).select("id", F.get("municipios", F.lit(0)).alias("place"))


# ---------------------------------------------------------------- S20, K01
def _dump_rows(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        k, F.when(k % 4 == 0, None).when(k % 4 == 1, "").when(k % 4 == 2, F.concat("s_name", F.lit(', "said"\nNA'))).otherwise(F.col("s_name")).alias("label"),
        F.when(k % 3 != 0, F.col("s_acctbal")).alias("amount"),
    )


_DUMP_SQL = """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN s_name || ', "said"' || chr(10) || 'NA' ELSE s_name END AS label,
  CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END AS amount FROM supplier"""


@query("K01", _DUMP_SQL)
def k01(spark, d):
    path = scratch(spark, "dump")
    tables.write_dump(_dump_rows(spark, d), path, ["s_suppkey"])
    return tables.read_dump(spark, [path], "s_suppkey bigint, label string, amount double")


@query("S20", f"SELECT s_suppkey, label, amount, CAST(NULL AS INTEGER) AS added FROM ({_DUMP_SQL}) UNION ALL SELECT s_suppkey, s_name, s_acctbal, CAST(s_nationkey AS INTEGER) FROM supplier")
def s20(spark, d):
    old, new = scratch(spark, "old"), scratch(spark, "new")
    tables.write_dump(_dump_rows(spark, d), old, ["s_suppkey"])
    rows = table(spark, d, "supplier").select(F.col("s_nationkey").alias("added"), F.col("s_acctbal").alias("amount"), "s_suppkey", F.col("s_name").alias("label"))
    tables.write_dump(rows, new, ["s_suppkey"])
    return tables.read_dump(spark, [old, new], "s_suppkey bigint, label string, amount double, added int")


# ---------------------------------------------------------------- K02 - K10
@query(
    "K02",
    """WITH e AS (SELECT o_orderpriority AS zone, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS rank FROM orders)
    SELECT o_orderpriority AS zone, count(*) AS n_orders, CAST(3 AS INTEGER) AS n_examples, (SELECT CAST(o_orderkey AS VARCHAR) FROM e WHERE e.zone = o.o_orderpriority AND rank = 1) AS first_title,
      count(*) FILTER (o_orderstatus = 'F') AS n_f FROM orders o GROUP BY o_orderpriority""",
)
def k02(spark, d):
    from tremorlens.operators.coverage import examples

    orders = table(spark, d, "orders").withColumn("zone", F.col("o_orderpriority"))
    shown = examples(orders, ["zone"], ["o_orderdate", "o_orderkey"]).select("zone", "rank", F.col("o_orderkey").cast("string").alias("title"), F.lit("u").alias("url"))
    by_grade = orders.groupBy("zone", F.col("o_orderstatus").alias("grade")).agg(F.count("*").alias("n"))
    docs = sinks.zone_documents(orders.groupBy("zone").agg(F.count("*").alias("n_orders")), shown, by_grade, ["zone"])
    path = scratch(spark, "zones")
    sinks.write_documents(docs, path)
    schema = "zone string, summary struct<n_orders:bigint>, examples array<struct<rank:int,title:string,url:string>>, detections map<string,bigint>"
    back = spark.read.schema(schema).json(path)
    return back.select("zone", "summary.n_orders", F.size("examples").alias("n_examples"), F.col("examples")[0]["title"].alias("first_title"), F.col("detections")["F"].alias("n_f"))


@query("K03", f"WITH {POINTS_SQL} SELECT id, round(lon, 3) + 0.0::DOUBLE AS lon, round(lat, 3) + 0.0::DOUBLE AS lat, grade, place IS NOT NULL AS has_place FROM points")
def k03(spark, d):
    rows = points(spark, d).select("id", F.round("lon", 3).alias("lon_pub"), F.round("lat", 3).alias("lat_pub"), "grade", "place")
    path = scratch(spark, "features")
    sinks.write_features(sinks.point_features(rows, "lon_pub", "lat_pub", ["id", "grade", "place"]), path)
    line = spark.read.text(path)
    doc = F.from_json("value", "struct<geometry:struct<coordinates:array<double>>,properties:struct<id:bigint,grade:string>>")
    return line.select(doc.alias("f"), F.col("value").contains('"place"').alias("has_place")).select(
        "f.properties.id", F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"), "f.properties.grade", "has_place"
    )


@query(
    "K05",
    """WITH o AS (SELECT o_custkey AS k, max(o_totalprice) AS price, max(o_orderpriority) FILTER (o_orderkey % 3 = 0) AS prio, min(o_orderdate) AS seen FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
    n AS (SELECT o_custkey AS k, arg_max(o_totalprice, o_orderkey) AS price, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderkey % 4 = 1) AS prio, arg_min(o_orderdate, o_orderkey) AS seen FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
    SELECT coalesce(o.k, n.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.price ELSE o.price END AS price, coalesce(o.prio, n.prio) AS prio, CAST(CASE WHEN o.k IS NOT NULL THEN o.seen ELSE n.seen END AS DATE) AS seen
    FROM o FULL JOIN n ON o.k = n.k""",
)
def k05(spark, d):
    """Even orders are what is stored, one row a key; odd ones arrive by order key, several of a key in one batch."""
    orders, k = table(spark, d, "orders"), F.col("o_orderkey")
    old = orders.filter(k % 2 == 0).groupBy(F.col("o_custkey").alias("k")).agg(
        F.max("o_totalprice").alias("price"), F.max(F.when(k % 3 == 0, F.col("o_orderpriority"))).alias("prio"), F.to_date(F.min("o_orderdate")).alias("seen")
    )
    new = orders.filter(k % 2 == 1).select(
        F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("price"), F.when(k % 4 == 1, F.col("o_orderpriority")).alias("prio"), F.to_date("o_orderdate").alias("seen"), k.alias("ordinal")
    )
    return snapshots.upsert(old, new, ["k"], replace=["price"], fill=["prio"], keep=["seen"], order="ordinal")


@query(
    "K06",
    """WITH a AS (SELECT doc_id AS seq, DATE '2026-08-01' + CAST(doc_id % 5 AS INTEGER) AS day, 'f' || doc_id % 7 || CASE WHEN doc_id % 7 < 5 THEN '.json' ELSE '' END AS name, sha256(lang || doc_id % 3) AS sha256 FROM documents),
    f AS (SELECT *, first_value(sha256) OVER (PARTITION BY day, name ORDER BY seq) AS s1, min(seq) OVER (PARTITION BY day, name, sha256) AS w FROM a)
    SELECT seq, CAST(day AS VARCHAR) || '/' || CASE WHEN sha256 = s1 THEN name WHEN name LIKE '%.json' THEN replace(name, '.json', '') || '_' || sha256[1:8] || '.json' ELSE name || '_' || sha256[1:8] END AS path, seq = w AS stored FROM f""",
)
def k06(spark, d):
    k = F.col("doc_id")
    rows = table(spark, d, "documents").select(
        k.alias("seq"), F.date_add(F.lit("2026-08-01").cast("date"), (k % 5).cast("int")).alias("day"),
        F.concat(F.lit("f"), (k % 7).cast("string"), F.when(k % 7 < 5, ".json").otherwise("")).alias("name"), F.sha2(F.concat("lang", (k % 3).cast("string")), 256).alias("sha256"),
    )
    return landing.landing_plan(rows).select("seq", "path", "stored")


@query("K07", "SELECT 'repo:feeds' AS url, 'rebuilt outlets: ' || count(*) AS note, CAST(NULL AS INTEGER) AS http_status FROM documents")
def k07(spark, d):
    counted = table(spark, d, "documents").agg(F.count("*").alias("n"))
    return landing.derivation_log(counted, "repo:feeds", "rebuilt outlets", F.lit("2026-08-22 10:00:00").cast("timestamp")).select("url", "note", "http_status")


@query(
    "K08",
    """WITH t AS (SELECT * FROM events ORDER BY ts DESC, event_id LIMIT 80)
    SELECT CASE WHEN event_type = 'error' THEN '⚠️ ' ELSE '' END || 'kind ' || event_type AS title, 'value ' || user_id AS description, '2026-08-22-kind_' || event_type || '-' || event_id AS guid FROM t""",
)
def k08(spark, d):
    newest = sinks.recent_items(table(spark, d, "events"), [F.col("ts").desc(), F.col("event_id")])
    alerts = newest.select(
        F.when(F.col("event_type") == "error", "alta").otherwise("info").alias("level"), F.concat(F.lit("kind_"), "event_type").alias("kind"),
        F.concat(F.lit("value "), F.col("user_id").cast("string")).alias("text"), F.col("event_id").alias("position"),
    )
    path = scratch(spark, "items")
    sinks.write_items(sinks.alert_items(alerts, "2026-08-22", "https://x.example/"), path)
    back = spark.read.schema("title string, description string, guid string").format("xml").option("rowTag", "item").load(path)
    return back


@query("K09", "SELECT lang, count(*) AS n, 'documents' AS snapshot, count(*) AS items, sha256('rule text v1') AS rule_sha256 FROM documents GROUP BY lang")
def k09(spark, d):
    mart = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return landing.with_lineage(mart, F.lit("documents"), F.col("n"), "rule text v1").select("lang", "n", "derived_from.*")


@query(
    "K10",
    """SELECT event_id || '.mp4' AS object, md5(CAST(user_id AS VARCHAR)) AS sha, CASE WHEN event_id % 10 = 0 THEN user_id END AS bytes FROM events WHERE event_id % 2 = 0""",
)
def k10(spark, d):
    k = F.col("event_id")
    key = k.cast("string")
    reports = table(spark, d, "events").select(
        F.concat(F.lit("https://up.example/"), key, F.when(k % 2 == 0, ".mp4").otherwise(".jpg")).alias("media_url"), F.md5(F.col("user_id").cast("string").cast("binary")).alias("sha")
    )
    stored = table(spark, d, "events").select(F.when(k % 10 == 0, F.concat(key, F.lit(".mp4"))).when(k % 10 != 4, F.concat(key, F.lit(".part"))).alias("object"), F.col("user_id").alias("bytes"))
    return citizen.media_manifest(reports, stored).select("object", "sha", "bytes")


# ---------------------------------------------------------------- landing log against its bodies
@query(
    "J26",
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'missing_path' WHEN 1 THEN 'missing_body' WHEN 2 THEN 'hash_mismatch' END AS problem FROM documents WHERE doc_id % 5 < 3 AND doc_id % 11 <> 0""",
)
def j26(spark, d):
    from tremorlens.operators.quality import log_integrity

    k = F.col("doc_id")
    path = F.concat(F.lit("snap/"), k.cast("string"))
    docs = table(spark, d, "documents")
    log = docs.select(
        F.when(k % 5 != 0, path).alias("path"), F.concat_ws(":", F.sha2("text", 256), k.cast("string")).alias("sha256"), F.lit(200).alias("status"),
        F.col("n_chars").alias("bytes"), F.when(k % 11 == 0, "probe").alias("note"),
    )
    kept = F.when(k % 5 != 1, path).when(k % 2 == 0, F.concat(F.lit("elsewhere/"), path))
    bodies = docs.select(kept.alias("path"), F.concat_ws(":", F.sha2(F.when(k % 5 == 2, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256), k.cast("string")).alias("body_sha"))
    out = log_integrity(log, bodies, ["probe"])
    return out.select(F.element_at(F.split("sha256", ":"), -1).cast("bigint").alias("doc_id"), "problem")

