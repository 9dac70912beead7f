"""Literal cases with known answers, one operator each."""

import datetime as dt

from pyspark.sql import functions as F

from tremorlens.functions import dates, geo, numbers, report, text, web
from tremorlens.operators import alerts, attribution, citizen, coverage, media, registry, snapshots, spatial
from tremorlens.plans.terms import literal_terms
from tremorlens.sources import archives, documents, feeds


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(value):
    return F.lit(value).cast("string")


def test_number_parse(spark):
    for literal in ("NA", "-", "", None, "None", "null", "abc", "true", "1d", "Infinity"):
        assert one(spark, numbers.parse_number(lit(literal))) is None
    for literal, value in (("182", 182.0), ("0.6", 0.6), ("190,000", 190000.0), ("0", 0.0)):
        assert one(spark, numbers.parse_number(lit(literal))) == value
    assert one(spark, numbers.parse_count(lit("12.5"))) == 125
    assert one(spark, numbers.parse_decimal_comma(lit("-75,581775"))) == -75.581775
    assert one(spark, numbers.pad_code(lit("5001"))) == "05001"


def test_rate_keeps_tiny_shares_and_absence(spark):
    assert one(spark, numbers.rate_pct(F.lit(1), F.lit(300000))) == 0.0003
    assert one(spark, numbers.rate_pct(F.lit(0), F.lit(300000))) is None


def test_fold_and_names(spark):
    assert one(spark, text.fold(lit("Quibdó ÑANDÚ é"))) == "quibdo nandu e"
    assert one(spark, text.admin_name(lit("SOTARÁ - PAISPAMBA"))) == "sotara paispamba"
    assert one(spark, text.title_es(lit("SAN JOSÉ DEL PALMAR"))) == "San José del Palmar"
    assert one(spark, text.slug(lit("Río Iró"))) == "rio-iro"
    assert one(spark, text.page_slug(lit("El Águila"))) == "el-aguila"


def test_grid_value(spark):
    header = {"x0": -78.0, "x1": -74.0, "nx": 3, "y0": 2.0, "y1": 6.0, "ny": 3}
    grid = spark.createDataFrame([(3, [float(v) for v in range(1, 10)])], "nx int, values array<double>")
    pts = spark.createDataFrame([(1, -78.0, 2.0), (2, -74.0, 6.0), (3, -76.0, 4.0), (4, 0.0, 0.0)], "id int, lon double, lat double")
    out = spatial.grid_value(pts, F.col("lon"), F.col("lat"), header, spatial.grid_cells(grid, []))
    assert {r["id"]: r["value"] for r in out.collect()} == {1: 1.0, 2: 9.0, 3: 5.0, 4: None}


def test_polygon_with_hole(spark):
    rings = geo.wkt_rings(lit("POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"))
    for (x, y), inside in (((1, 1), True), ((5, 5), False), ((11, 5), False)):
        assert one(spark, geo.polygon_contains(F.lit(float(x)), F.lit(float(y)), rings)) is inside
    assert one(spark, geo.rings_geojson(lit("POINT (-75.5 4.5)"), geo.wkt_rings(lit("POINT (-75.5 4.5)")))) == '{"type":"Point","coordinates":[-75.5,4.5]}'
    assert one(spark, F.size(geo.wkt_rings(lit(None)))) == 0


def test_date_line_neighbours(spark):
    pts = spark.createDataFrame([(1, 179.99, 0.0)], "id int, lon double, lat double")
    places = spark.createDataFrame([("west", -179.99, 0.0)], "place string, plon double, plat double")
    assert spatial.within_radius(pts, "id", "lon", "lat", places, "place", "plon", "plat", 12.0).count() == 1


def test_nearest_place_declared_and_orphan(spark):
    pts = spark.createDataFrame(
        [(1, -76.0, 4.0, "Far"), (2, -76.0, 4.0, "Unknown"), (3, -60.0, 4.0, None), (4, -76.1, 4.0, None)], "id int, lon double, lat double, declared string"
    )
    places = spark.createDataFrame([("Near", -76.05, 4.0), ("Far", -70.0, 0.0), ("Bare", None, None)], "place string, plon double, plat double")
    out = spatial.nearest_place(pts, "id", "lon", "lat", "declared", places, "place", "plon", "plat")
    assert {r["id"]: r["place"] for r in out.collect()} == {1: "Far", 2: "Near", 3: None, 4: "Near"}


def test_cross_state(spark):
    cases = [((True, 0, 0, 0), "pendiente"), ((True, 0, 500, 0), "prensa"), ((True, 0, 0, 99), "ciudadano"), ((True, 1, 0, 0), "coincide"),
             ((False, 0, 10, 0), "no_comparable"), ((False, 1, 0, 0), "no_comparable")]
    for args, state in cases:
        assert one(spark, coverage.cross_state(*[F.lit(a) for a in args])) == state


def test_word_boundaries(spark):
    news = spark.createDataFrame(
        [(1, "Earthquake felt in California"), (2, "Colapso en Cali tras el sismo"), (3, "Daños graves en Quibdó")], "id int, title string"
    )
    tops = literal_terms(spark, [("Cali Center", "cali"), ("Quibdo Centre", "quibdo")], "zone string, term string")
    got = {(r["id"], r["zone"]) for r in attribution.match_zones(news, "id", "title", tops).collect()}
    assert got == {(2, "Cali Center"), (3, "Quibdo Centre")}


def test_ambiguous_names_need_their_department(spark):
    rows = [("Restrepo", "Valle del Cauca", "restrepo", True, False), ("San José", "Caldas", "san jose, caldas", True, False), ("Risaralda", "Caldas", "risaralda", False, True),
            ("Buga", "Valle del Cauca", "guadalajara de buga", False, False)]
    gaz = literal_terms(spark, rows, "municipality string, department string, term string, needs_department boolean, homonym boolean")
    news = spark.createDataFrame(
        [(1, "El ministro Restrepo habló"), (2, "Daños en Restrepo, Valle del Cauca"), (3, "San José del Palmar, Chocó"), (4, "En San José, Caldas, hubo daños"),
         (5, "Caldas y Risaralda"), (6, "Guadalajara de Buga")], "id int, title string"
    )
    places = attribution.match_municipalities(news, "id", "title", gaz)
    assert {(r["id"], r["municipality"]) for r in places.collect()} == {(2, "Restrepo"), (4, "San José"), (6, "Buga")}
    depts = attribution.match_departments(news, "id", "title", gaz)
    assert {(r["id"], r["department"]) for r in depts.select("id", F.explode("departments").alias("department")).collect()} == {(2, "Valle del Cauca"), (4, "Caldas"), (5, "Caldas"), (6, "Valle del Cauca")}


def test_dictionary_gives_the_same_however_it_is_joined(spark):
    """NULL and repeated keys, hits in several lines, and a dictionary that is shuffled instead of broadcast."""
    news = spark.createDataFrame([(1, "a b c de la d"), (2, "la b"), (2, "zz\nc de"), (None, "de la"), (None, "b\nb"), (3, "de\nla"), (4, None)], "id int, t string")
    tops = literal_terms(spark, [("A", "de la"), ("B", "b"), ("C", "c de")], "zone string, term string")
    expected = {(1, "A"), (1, "B"), (1, "C"), (2, "B"), (2, "C"), (None, "A"), (None, "B")}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold in (before, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            got = [tuple(r) for r in attribution.match_zones(news, "id", "t", tops).collect()]
            assert len(got) == len(expected) and set(got) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_last_arrival_wins(spark):
    """Repeats in one batch resolve by their number, not by their value."""
    old = spark.createDataFrame([("k", "z", None, "first")], "key string, r string, f string, s string")
    new = spark.createDataFrame([("k", "m", None, "x", 1), ("k", "b", "one", "y", 2), ("k", "a", "two", "y", 2), ("n", "q", None, "p", 1)], "key string, r string, f string, s string, at int")
    got = {r["key"]: (r["r"], r["f"], r["s"]) for r in snapshots.upsert(old, new, ["key"], replace=["r"], fill=["f"], keep=["s"], order="at").collect()}
    assert got == {"k": ("b", "two", "first"), "n": ("q", None, "p")}


def test_empty_text_sorts_last(spark):
    rows = spark.createDataFrame([("b",), ("",), (None,), ("a",)], "t string")
    for descending, first in ((False, ["a", "b"]), (True, ["b", "a"])):
        got = [r["t"] for r in media.sorted_rows(rows, "t", descending).collect()]
        assert got[:2] == first and set(got[2:]) == {"", None}


def test_newest_day_prunes_the_partitions(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    spark.range(30).selectExpr("id", "concat('2026-08-0', id % 3 + 1) AS day").write.partitionBy("day").parquet(path)
    newest = snapshots.latest_snapshot(spark.read.parquet(path), "day")
    assert newest.count() == 10
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "subquery" in plan.split("PartitionFilters")[1][:200]


def test_salted_join_equals_broadcast(spark):
    from tremorlens.plans.joins import skew_join

    big = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 7 == 0, None).otherwise(F.col("id")).alias("k"))
    small = spark.createDataFrame([(1, "hot"), (5, "five")], "k bigint, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        a, b = (sorted(map(repr, skew_join(big, small, ["k"], how, rows=n).select("id").collect())) for n in (10, 0))
        assert a == b


def test_salted_side_is_never_broadcast(spark):
    """Its copies per bucket are not in the size that Spark estimates from the file."""
    from tremorlens.plans.joins import skew_join

    big, small = spark.range(1000).withColumn("k", F.col("id") % 50), spark.range(50).withColumnRenamed("id", "k").withColumn("v", F.lit(1))
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert "Broadcast" not in skew_join(big, small, ["k"], how, rows=10)._jdf.queryExecution().executedPlan().toString()


def test_zero_only_on_closed_days(spark):
    rows = spark.createDataFrame([("2026-08-10",), ("2026-08-17",)], "d string")
    out = {str(r["day"]): r["n"] for r in citizen.daily_reports(rows, F.col("d").cast("date"), "2026-08-10", "2026-08-20").collect()}
    assert out["2026-08-16"] == 0 and out["2026-08-19"] == 0 and "2026-08-20" not in out and out["2026-08-17"] == 1


def test_zone_summary(spark):
    rows = [("Z", "Built-up", None, 182.0), ("Z", "Transportation", None, 0.6), ("Z", "Transportation", None, 0.2), ("Z", "Estimated population", 190000.0, None),
            ("Z", "Blocked road / interruption", None, 11.0), ("N", "Built-up", 5.0, None)]
    out = {r["zone"]: tuple(r)[1:] for r in coverage.zone_summary(spark.createDataFrame(rows, "zone string, category string, total double, affected double"), ["zone"]).collect()}
    assert out == {"Z": (190000.0, 182.0, 0.8, 11.0), "N": (None, None, None, None)}


BULLETIN = "Población: 304 personas fallecidas, 4.548 heridas, 426 desaparecidas y 356 personas rescatadas. 134.342 viviendas averiadas, 29.554 destruidas."


def test_figures(spark):
    f = one(spark, report.figures(lit(BULLETIN)))
    assert (f["fallecidos"], f["heridos"], f["desaparecidos"], f["rescatados"]) == (304, 4548, 426, 356)
    assert (f["viviendas_averiadas"], f["viviendas_destruidas"], f["personas_afectadas"]) == (134342, 29554, None)
    f = one(spark, report.figures(lit("294 muertos, 3.935 heridos y 320 desaparecidos, con 54.008 familias afectadas.")))
    assert (f["fallecidos"], f["heridos"], f["desaparecidos"], f["familias_afectadas"]) == (294, 3935, 320, 54008)
    f = one(spark, report.figures(lit("115.461 personas afectadas en 448 municipios afectados de 15 departamentos afectados.")))
    assert (f["personas_afectadas"], f["municipios_afectados"], f["departamentos_afectados"]) == (115461, 448, 15)
    assert one(spark, report.figures(lit("se sintió en 448 municipios del occidente.")))["municipios_afectados"] is None


def read(spark, body):
    return report.read_figures(spark.createDataFrame([(body,)], "text string"), "text").first()


def test_watched_figures(spark):
    assert len(read(spark, BULLETIN)["attempts"]) == 1 and read(spark, BULLETIN)["discarded"] is None
    row = read(spark, "Reporte: 304 personas afectadas. Desaparecidos: 426 y 134.342 viviendas averiadas.")
    assert len(row["attempts"]) == 2 and row["discarded"] == ["personas_afectadas"]
    assert (row["figures"]["personas_afectadas"], row["figures"]["desaparecidos"], row["figures"]["viviendas_averiadas"]) == (None, 426, 134342)
    assert read(spark, "![m](https://x.example/mapa-900x601.jpg) municipios afectados")["figures"]["municipios_afectados"] is None


def test_cutoff(spark):
    cases = {
        "Balance oficial de la UNGRD este 15 de agosto": "2026-08-15", "El terremoto del 10 de agosto dejó cientos de muertos": None,
        "Tras el sismo del 10 de agosto, el balance del 17 de agosto suma 289 muertos": "2026-08-17",
        "Estos son los municipios más afectados por el sismo": None, "con corte a las 6:00 a. m. del 18 de agosto de 2026": "2026-08-18",
    }
    for body, day in cases.items():
        assert one(spark, report.cutoff_day(lit(body), "2026")) == day, body


def test_closed_local_day(spark):
    for stamp, day in (("05:02", 17), ("10:30", 17), ("16:30", 18), ("23:30", 18)):
        assert one(spark, dates.closed_local_day(F.lit(f"2026-08-18 {stamp}:00").cast("timestamp_ntz"))) == dt.date(2026, 8, day)


def test_nulls_last_both_ways(spark):
    rows = spark.createDataFrame([(1, 5), (2, None), (3, 9)], "id int, v int")
    assert [r["id"] for r in media.sorted_rows(rows, "v").collect()] == [1, 3, 2]
    assert [r["id"] for r in media.sorted_rows(rows, "v", descending=True).collect()] == [3, 1, 2]
    words = spark.createDataFrame([("Zarzal",), ("Ándes",), ("Cali",)], "w string")
    assert [r["w"] for r in media.sorted_rows(words, "w", spanish=True).collect()] == ["Ándes", "Cali", "Zarzal"]


def test_increments(spark):
    rows = spark.createDataFrame([("E", 1, 100), ("E", 2, 90), ("E", 3, None), ("E", 4, 95)], "k string, day int, v int")
    assert [r["increment"] for r in registry.increments(rows, ["k"], "day", "v").orderBy("day").collect()] == [None, -10, None, None]


def test_changed_pages(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    state = old.select("k", snapshots.row_fingerprint(["k", "v"]).alias("fingerprint"))
    new = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert [r["k"] for r in snapshots.changed_pages(new, "k", ["k", "v"], state).collect()] == ["b"]
    assert snapshots.changed_pages(new, "k", ["k", "v"], state.limit(0)).count() == 2


def test_impossible_codes(spark):
    rows = [("EQ20260822COL", "m", "20260811"), ("EQ20260810COL", "x", "20260811"), ("RAROSINFECHA", "x", "20260811"), (None, "x", "20260811"), ("EQ20260815COL", "n", None)]
    df = spark.createDataFrame(rows, "event_code string, layer string, sensor_date string")
    assert [(r["event_code"], r["reason"]) for r in alerts.impossible_codes(df, "2026-08-20").collect()] == [("EQ20260822COL", "future")]
    late = spark.createDataFrame([("EQ20260815COL", "x", "20260811")], df.schema)
    assert alerts.impossible_codes(late, "2026-09-01").first()["reason"] == "after_image"


def test_no_previous_capture_raises_nothing(spark):
    rows = spark.createDataFrame([("2026-08-20", "a"), ("2026-08-20", None)], "snapshot_date string, link string")
    assert snapshots.new_items(rows, ["link"], "2026-08-20").count() == 0


def test_event_gate(spark):
    yes = "Sismo en Cali deja viviendas averiadas"
    for body, evidence in ((yes, True), ("Fábrica de chocolate en Colombia con viviendas", False), ("Terremoto en Japón deja heridos", False), ("Mapa sitio " + yes, False),
                           ("sismo ![x](https://a.example/cali.jpg)", False)):
        assert one(spark, report.is_event_evidence(lit(body))) is evidence, body


def test_liveblog(spark):
    assert one(spark, text.is_liveblog(lit("Terremoto en vivo"), lit(None))) is True
    assert one(spark, text.is_liveblog(lit("directorio de alcaldías"), lit(None))) is False


def test_place_in_file_name(spark):
    rows = [("X_COLOMBIA_PEREIRA_IMPACTMAP_1",), ("X_Colombia_LaVirginia_ImpactMap",), ("X_COLOMBIA_ANSERMA_IMPACTMAP_1",), ("X_COLOMBIA_PuebloInventado_IMPACTMAP_1",), ("ruido",)]
    places = spark.createDataFrame([("Pereira", "R"), ("La Virginia", "R"), ("Anserma", "C"), ("Ansermanuevo", "V")], "municipality string, department string")
    out = archives.place_from_name(spark.createDataFrame(rows, "f string"), "f", r"(?i)colombia_([a-z]+)_impact", places).collect()
    assert {(r["place"], r["place_origin"]) for r in out} == {
        ("Pereira", "catalogue"), ("La Virginia", "catalogue"), ("Anserma", "catalogue"), ("Pueblo Inventado", "file_name"), (None, "unknown"),
    }


def test_feed_shapes(spark):
    rss = '<rss><channel><item><title> T </title><link>https://a.example/1</link><pubDate>Sat, 22 Aug 2026 10:00:00 +0000</pubDate><source url="https://www.b.example/f">B</source></item></channel></rss>'
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">A</title><link href="https://c.example/2"/><updated>2026-08-21T01:02:03Z</updated><source><title>C</title><link href="https://www.d.example"/></source></entry></feed>'
    out = feeds.feed_entries(spark.createDataFrame([(rss,), (atom,), ("<rss><chan",)], "body string")).collect()
    assert {(r["title"], r["url"], r["published"], r["outlet"], r["outlet_domain"]) for r in out} == {
        ("T", "https://a.example/1", "2026-08-22T10:00:00", "B", "b.example"), ("A", "https://c.example/2", "2026-08-21T01:02:03", "C", "d.example"),
    }


def test_report_without_id_gets_a_stable_one(spark):
    import hashlib
    import json

    doc = {"features": [{"properties": {"time": "2026-08-11T00:00:00"}, "geometry": {"type": "Point", "coordinates": [-75.5, 4.25]}}]}
    row = documents.citizen_reports(spark.createDataFrame([(json.dumps(doc),)], "body string")).first()
    assert row["id_externo"] == hashlib.sha1(json.dumps([[-75.5, 4.25], "2026-08-11T00:00:00"]).encode()).hexdigest()[:16]


def test_outlet_behind_aggregator(spark):
    url = lit("https://news.google.com/rss/x")
    assert one(spark, web.outlet(lit(None), lit("Google News"), lit(None), url)) is None
    assert one(spark, web.outlet(lit(None), lit("La Patria"), lit(None), lit("https://lapatria.example/x"))) == "La Patria"
    assert one(spark, web.title_suffix_outlet(lit("Sismo - El Tiempo"))) == "El Tiempo"


# ---- archives ------------------------------------------------------------------------------
def _shapefile(points, deleted=(), lone=()):
    """Files of a layer of points; records in ``deleted`` are marked so, those in ``lone`` have no shape."""
    import struct

    shapes = b"".join(
        struct.pack(">ii", n + 1, 2) + struct.pack("<i", 0) if n in lone else struct.pack(">ii", n + 1, 10) + struct.pack("<idd", 1, *p) for n, p in enumerate(points)
    )
    fields = [("Main_Dmg", 8), ("ID", 4)]
    head = b"".join(n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([w, 0]) + b"\0" * 14 for n, w in fields)
    records = b"".join((b"*" if n in deleted else b" ") + f"g{n}".encode().ljust(8) + str(n).encode().rjust(4) for n in range(len(points)))
    table = b"\x03\0\0\0" + struct.pack("<IHH", len(points), 32 + len(head) + 1, 13) + b"\0" * 20 + head + b"\r" + records
    return struct.pack(">i", 9994) + b"\0" * 96 + shapes, table


def _zip(files):
    import io
    import zipfile

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return buffer.getvalue()


def test_deleted_records_and_bad_members(spark):
    """A deleted or shapeless record leaves the others their own attributes; what cannot be read is told apart."""
    points = [(float(i), -float(i)) for i in range(6)]
    shp, dbf = _shapefile(points, deleted={1, 4}, lone={2})
    plain, table = _shapefile(points)
    good = _zip({"a/L.shp": shp, "a/L.dbf": dbf, "M.shp": plain, "M.dbf": table, "P.shp": plain, "P.dbf": table, "P.prj": "PROJCS[1]", "Q.shp": b"x" * 200, "Q.dbf": table, "R.shp": plain})
    damaged = bytearray(_zip({"L.shp": shp, "L.dbf": dbf}))
    damaged[40:60] = b"\xff" * 20
    rows = [("ok", "1", good), ("bad", "2", b"no zip"), ("hurt", "3", bytes(damaged))]
    features, problems = archives.unpack(spark.createDataFrame([(p, h, bytearray(c)) for p, h, c in rows], "path string, package_sha string, content binary"), "shapefile")
    got = {(r["layer"], r["properties"]["ID"]): (r["lon"], r["lat"], r["properties"]["Main_Dmg"]) for r in features.collect()}
    assert got == {("L", str(i)): (float(i), -float(i), f"g{i}") for i in (0, 3, 5)} | {("M", str(i)): (float(i), -float(i), f"g{i}") for i in range(6)}
    told = {(r["path"], r["name"]): r["problem"] for r in problems.collect()}
    assert told["ok", "P"] == "projected" and told["ok", "Q"] == "ValueError" and told["bad", None] == "BadZipFile" and ("hurt", "L.shp") in told and len(told) == 4


def test_geojson_layers(spark):
    layer = '{"features": [{"geometry": {"type": "Point", "coordinates": [1.5, 2]}, "properties": {"DAMAGE": "x", "n": 3, "e": null}}, {"geometry": null, "properties": {"AREA_HA": 10.5}}, {"geometry": {"type": "Polygon", "coordinates": [[[0, 1]]]}, "properties": {}}]}'
    content = _zip({"v/A_UrbanP.geojson": layer, "v/B_broken.geojson": "{nothing", "v/C_empty.geojson": "{}"})
    features, problems = archives.unpack(spark.createDataFrame([("p", "1", bytearray(content))], "path string, package_sha string, content binary"), "geojson")
    got = sorted((r["layer"], r["idx"], r["geometry_type"], r["lon"], r["lat"], sorted(r["properties"].items())) for r in features.collect())
    assert got == [("UrbanP", 0, "Point", 1.5, 2.0, [("DAMAGE", "x"), ("n", "3")]), ("UrbanP", 1, None, None, None, [("AREA_HA", "10.5")]), ("UrbanP", 2, "Polygon", None, None, [])]
    assert [(r["name"], r["problem"]) for r in problems.collect()] == [("broken", "unreadable")]


def test_a_shared_address_never_multiplies_evidence(spark):
    evidence = spark.createDataFrame([(1, "http://a.example/x", "s1"), (2, "http://a.example/x", "s2"), (3, None, "s3")], "id int, url string, signature string")
    news = spark.createDataFrame([("http://a.example/x", "Z", "z"), ("http://a.example/x", "B", "b"), ("http://a.example/x", None, "a"), (None, "N", "n")], "url string, outlet string, outlet_domain string")
    out = coverage.evidence_outlets(evidence, news, F.lit("own")).select("id", "outlet", "outlet_domain").collect()
    assert sorted(map(tuple, out)) == [(1, "B", "b"), (2, "B", "b"), (3, "s3", "own")]
