"""Scalar expressions over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import query, table
from tremorlens.functions import dates, numbers, report, text, web
from tremorlens.operators.snapshots import row_fingerprint
from tremorlens.sources import archives

STRIPPED_HTML = (
    "replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?is)<script.*?</script>', ' ', 'g'), "
    "'(?is)<style.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"
)
DOC_FOLD = "lower(strip_accents(text))"


@query(
    "P01",
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN CAST(o_custkey AS DOUBLE) * 1000
      WHEN 3 THEN 0.0::DOUBLE WHEN 4 THEN NULL ELSE o_totalprice END AS value FROM orders""",
)
def p01(spark, d):
    k, kind = F.col("o_orderkey"), F.col("o_orderkey") % 6
    literal = (
        F.when(kind == 0, "NA").when(kind == 1, " - ").when(kind == 2, F.concat(F.col("o_custkey").cast("string"), F.lit(",000")))
        .when(kind == 3, "0").when(kind == 4, F.concat(k.cast("string"), F.lit("d"))).otherwise(F.format_string("%.2f", "o_totalprice"))
    )
    return table(spark, d, "orders").select(k, numbers.parse_number(literal).alias("value"))


@query(
    "P02",
    """SELECT o_orderkey, o_custkey * 1000 + o_orderkey % 1000 AS n, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_totalprice AS DOUBLE) END AS x FROM orders""",
)
def p02(spark, d):
    tail = F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0")
    mark = F.when(F.col("o_orderkey") % 2 == 0, ".").otherwise(",")
    decimal = F.replace(F.format_string("%.2f", "o_totalprice"), F.lit("."), F.lit(","))
    return table(spark, d, "orders").select(
        "o_orderkey", numbers.parse_count(F.concat(F.col("o_custkey").cast("string"), mark, tail)).alias("n"),
        numbers.parse_decimal_comma(F.when(F.col("o_orderkey") % 5 == 0, "NA").otherwise(decimal)).alias("x"),
    )


@query("P03", f"SELECT doc_id, md5({DOC_FOLD}) AS folded FROM documents")
def p03(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.fold(F.col("text")).cast("binary")).alias("folded"))


@query("P04", f"SELECT doc_id, md5(trim(regexp_replace({DOC_FOLD}, '[^a-z0-9]+', ' ', 'g'))) AS name FROM documents")
def p04(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.admin_name(F.col("text")).cast("binary")).alias("name"))


@query(
    "P05",
    f"""SELECT doc_id, md5(regexp_replace(regexp_replace({DOC_FOLD}, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')) AS slug,
      md5(regexp_replace(regexp_replace(regexp_replace({DOC_FOLD}, '[^\\x00-\\x7f]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')) AS page_slug FROM documents""",
)
def p05(spark, d):
    body = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", F.md5(text.slug(body).cast("binary")).alias("slug"), F.md5(text.page_slug(body).cast("binary")).alias("page_slug")
    )


_TITLE_SQL = (
    "array_to_string(list_transform(list_filter(string_split_regex(trim({0}), '\\s+'), lambda w: w <> ''), "
    "lambda w, i: CASE WHEN i > 1 AND lower(w) IN ('de','del','la','el','los','las','y') THEN lower(w) "
    "ELSE upper(lower(w)[1:1]) || lower(w)[2:] END), ' ')"
)


@query("P06", f"SELECT p_partkey, {_TITLE_SQL.format('p_name || chr(32) || p_type || chr(32) || chr(68) || chr(69) || chr(32) || p_brand')} AS title FROM part")
def p06(spark, d):
    name = F.concat_ws(" ", "p_name", "p_type", F.lit("DE"), "p_brand")
    return table(spark, d, "part").select("p_partkey", text.title_es(name).alias("title"))


@query(
    "P07",
    """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'X' || c_custkey ELSE lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(5, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0') END AS code FROM customer""",
)
def p07(spark, d):
    key = F.col("c_custkey").cast("string")
    return table(spark, d, "customer").select(
        "c_custkey", numbers.pad_code(F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("X"), key)).otherwise(key)).alias("code")
    )


_HOST_SQL = "nullif(regexp_replace(lower(regexp_extract({0}, '^[a-z]+://([^/:?#]+)', 1)), '^www\\.', ''), '')"


@query("P08", f"SELECT page_id, {_HOST_SQL.format('url')} AS host, regexp_matches(url, '^[a-z]+://([^/]*\\.)?example\\.net([/?#]|$)') AS aggregated FROM pages")
def p08(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select(
        "page_id", web.url_host(url).alias("host"), web.via_aggregator(url, "example.net").alias("aggregated")
    )


@query(
    "P09",
    """WITH t AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN 'Diario ' || page_id % 7 END AS declared, 'Feed ' || page_id % 5 AS feed,
      regexp_extract(html, '<title>([^<]*)</title>', 1) || CASE WHEN page_id % 2 = 0 THEN ' - La Voz ' || page_id % 9 ELSE '' END AS title FROM pages)
    SELECT page_id, coalesce(declared, CASE WHEN page_id % 4 <> 1 THEN feed END) AS outlet, CASE WHEN page_id % 2 = 0 THEN 'La Voz ' || page_id % 9 END AS suffix FROM t""",
)
def p09(spark, d):
    k = F.col("page_id")
    key = k.cast("string")
    rows = table(spark, d, "pages").select(
        k, F.when(k % 4 == 1, F.concat(F.lit("https://news.google.com/rss/"), key)).otherwise(F.col("url")).alias("url"),
        F.when(k % 3 == 0, F.concat(F.lit("Diario "), (k % 7).cast("string"))).alias("declared"),
        F.concat(F.lit("Feed "), (k % 5).cast("string")).alias("feed"),
        F.concat(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.when(k % 2 == 0, F.concat(F.lit(" - La Voz "), (k % 9).cast("string"))).otherwise("")).alias("title"),
    )
    return rows.select(
        k, web.outlet(F.col("declared"), F.col("feed"), F.lit(None).cast("string"), F.col("url")).alias("outlet"),
        web.title_suffix_outlet(F.col("title")).alias("suffix"),
    )


@query(
    "P10",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT00:00:00') AS mail, strftime(o_orderdate, '%Y-%m-%d') AS slash, strftime(o_orderdate, '%Y-%m-%d') AS run,
      CAST(o_orderdate AS DATE) AS millis, strftime(o_orderdate, '%Y-%m-%d') AS compact, 'plain text ' || o_orderkey AS other FROM orders""",
)
def p10(spark, d):
    day = F.col("o_orderdate")
    fmt = lambda pattern: F.date_format(day, pattern)
    return table(spark, d, "orders").select(
        "o_orderkey", dates.feed_stamp(fmt("E, dd MMM yyyy HH:mm:ss 'GMT'")).alias("mail"), dates.slash_day(fmt("dd/MM/yyyy")).alias("slash"),
        dates.run_day(fmt("d-M-yyyy")).alias("run"), dates.epoch_ms_day(F.unix_millis(day.cast("timestamp"))).alias("millis"),
        dates.compact_day(fmt("yyyyMMdd'T'HHmmss")).alias("compact"), dates.feed_stamp(F.concat(F.lit("plain text "), F.col("o_orderkey").cast("string"))).alias("other"),
    )


@query("P11", "SELECT event_id, CAST(ts - INTERVAL 11 HOUR AS DATE) AS closed_day FROM events")
def p11(spark, d):
    return table(spark, d, "events").select("event_id", dates.closed_local_day(F.col("ts")).alias("closed_day"))


@query(
    "P12",
    """SELECT o_orderpriority, count(*) FILTER (WHERE NOT (o_orderkey % 9 <> 0 AND o_orderdate < DATE '1998-01-01')) AS kept,
      count(*) FILTER (WHERE o_orderkey % 9 <> 0 AND o_orderdate < DATE '1998-01-01') AS cut FROM orders GROUP BY 1""",
)
def p12(spark, d):
    day = F.when(F.col("o_orderkey") % 9 != 0, F.to_date("o_orderdate"))
    early = dates.before_event(day, "1998-01-01")
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_if(~early).alias("kept"), F.count_if(early).alias("cut"))


@query(
    "P14",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 3 = 1 THEN 'B' || s_suppkey END AS first_alias,
      CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 4 = 1 THEN 'https://vendor.example/f/' || s_suppkey ELSE 'https://cdn.example/' || s_suppkey END AS link FROM supplier""",
)
def p14(spark, d):
    k = F.col("s_suppkey")
    key = k.cast("string")
    path = F.when(k % 4 == 0, F.concat(F.lit("/f/"), key, F.lit("/None"))).when(k % 4 == 1, F.concat(F.lit(" /f/"), key)).otherwise(F.concat(F.lit("https://cdn.example/"), key))
    return table(spark, d, "supplier").select(
        k, web.first_present(F.when(k % 3 == 0, F.col("s_name")).otherwise(""), F.when(k % 3 == 1, F.concat(F.lit("B"), key))).alias("first_alias"),
        web.vendor_link(path, "https://vendor.example").alias("link"),
    )


@query(
    "P15",
    """SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN NULL WHEN p_partkey % 5 < 3 THEN 'NATION_' || p_partkey % 25 ELSE 'Nuevo Pueblo' END AS place,
      CASE WHEN p_partkey % 5 = 4 THEN 'unknown' WHEN p_partkey % 5 < 3 THEN 'catalogue' ELSE 'file_name' END AS place_origin FROM part""",
)
def p15(spark, d):
    k = F.col("p_partkey")
    name = (
        F.when(k % 5 == 4, F.lit("noise")).when(k % 5 < 3, F.concat(F.lit("X_Country_nation_"), (k % 25).cast("string"), F.lit("_IMPACT_"), k.cast("string")))
        .otherwise(F.concat(F.lit("X_COUNTRY_NuevoPueblo_Impact_"), k.cast("string")))
    )
    places = table(spark, d, "nation").select(F.col("n_name").alias("municipality"), F.col("n_regionkey").cast("string").alias("department"))
    rows = table(spark, d, "part").select(k, name.alias("file"))
    return archives.place_from_name(rows, "file", r"(?i)country_([a-z0-9_]+?)_impact", places).select("p_partkey", "place", "place_origin")


@query(
    "P16",
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CAST((SELECT n_regionkey FROM nation WHERE n_nationkey = p_partkey % 25) AS VARCHAR)
        WHEN p_partkey % 10 < 9 THEN 'Dept ' || p_partkey % 10 END AS department,
      CASE WHEN p_partkey % 2 = 0 THEN 'catalogue' WHEN p_partkey % 10 < 9 THEN 'product_title' END AS department_origin FROM part""",
)
def p16(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 2 == 0, F.concat(F.lit("map_nation_"), (k % 25).cast("string"), F.lit("_end"))).otherwise(F.concat(F.lit("map_Town"), (k % 10).cast("string"), F.lit("_end")))
    places = table(spark, d, "nation").select(F.col("n_name").alias("municipality"), F.col("n_regionkey").cast("string").alias("department"))
    stated = F.concat(F.lit("Damage in Town"), (k % 10).cast("string"), F.lit(" Town, Dept "), (k % 10).cast("string"), F.lit(" Department, Country"))
    titles = table(spark, d, "part").select(F.when(k % 10 < 9, stated).when(k % 20 == 9, "Damage in general").alias("title"))
    rows = archives.place_from_name(table(spark, d, "part").select(k, name.alias("file")), "file", r"map_(\w+)_end", places)
    return archives.department_with_origin(rows, titles).select("p_partkey", "department", "department_origin")


@query(
    "P17",
    f"""SELECT page_id, md5({STRIPPED_HTML.format("html")}) AS plain, md5(html || ' ' || 'UNGRD' || page_id || ' fin') AS linkless FROM pages""",
)
def p17(spark, d):
    linked = F.concat(F.lit(" [UNGRD"), F.col("page_id").cast("string"), F.lit("](https://x.example/a-900x601.jpg) fin"))
    return table(spark, d, "pages").select(
        "page_id", F.md5(text.strip_html(F.col("html")).cast("binary")).alias("plain"),
        F.md5(F.concat(F.col("html"), text.strip_links(linked)).cast("binary")).alias("linkless"),
    )


@query("P18", "SELECT doc_id, regexp_matches(lower(text), 'thouou|und die|\\+1 \\(') AS relevant FROM documents")
def p18(spark, d):
    words = ["thouou", "Und die", "+1 ("]
    return table(spark, d, "documents").select("doc_id", text.is_relevant(F.col("text"), F.lit(None).cast("string"), words).alias("relevant"))


PROFILE = report.EventProfile(
    event_terms=["thouou", "license"], event_places=["que la"], damage_terms=["555", "heint"], generic_terms=["mit license"],
    unrelated_terms=["eaux"], context_terms=["the", "und", "la"], places=["Les", "Der"], date_pattern="2026-08|thth",
)


def _ascii(t: str, words: list[str]) -> str:
    return f"regexp_matches({t}, '(^|[^A-Za-z0-9_])(" + "|".join(words) + ")($|[^A-Za-z0-9_])')"


_PROSE = r"lower(strip_accents(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), 'https?://\S+', ' ', 'g'), '(?i)/\S*\.(?:jpe?g|png|webp|gif|svg|pdf|mp4|avif)\b', ' ', 'g')))"
GATE_SQL = f"""g AS (SELECT doc_id, text, {DOC_FOLD} AS w, {_PROSE} AS p FROM documents),
s AS (SELECT doc_id, text, w, contains(w, 'mit license') AS generic,
  (contains(substring(w, 1, 500), 'eaux') AND NOT contains(substring(w, 1, 500), 'the') AND NOT contains(substring(w, 1, 500), 'und')) AS unrelated,
  (contains(p, 'thouou') OR contains(p, 'license') OR {_ascii("p", ["que la"])}) AS event,
  (contains(w, 'the') OR contains(w, 'und') OR contains(w, 'la') OR {_ascii("p", ["les", "der"])}) AS context,
  (contains(w, '555') OR contains(w, 'heint')) AS damage, {_ascii("p", ["les", "der"])} AS place, regexp_matches(w, '2026-08|thth') AS dated FROM g),
e AS (SELECT *, (NOT generic AND NOT unrelated AND event AND context AND (damage OR place OR dated)) AS evidence FROM s)"""


@query("P19", f"WITH {GATE_SQL} SELECT doc_id, evidence FROM e")
def p19(spark, d):
    return table(spark, d, "documents").select("doc_id", report.is_event_evidence(F.col("text"), PROFILE).alias("evidence"))


_URLS = ["https://portal.gestiondelriesgo.gov.co/n/", "https://www.sgc.gov.co/", "https://www.eltiempo.com/col/", "https://www.youtube.com/watch?v=", "https://blog.example/"]
_LEVELS = ["oficial_comunicacion", "oficial_institucional", "temporal_prensa", "busqueda_web_temporal", "busqueda_web_temporal"]


def _doc_url():
    return F.concat(F.get(F.array(*[F.lit(u) for u in _URLS]), (F.col("doc_id") % 5).cast("int")), F.col("doc_id").cast("string"))


@query(
    "P20",
    "SELECT doc_id, ([" + ",".join(f"'{v}'" for v in _LEVELS) + "])[doc_id % 5 + 1] AS level FROM documents",
)
def p20(spark, d):
    return table(spark, d, "documents").select("doc_id", report.source_level(_doc_url(), F.col("text")).alias("level"))


@query(
    "P21",
    f"""WITH b AS (SELECT doc_id, text || ' ' || CASE WHEN doc_id % 3 = 0 THEN 'balance de fallecidos' WHEN doc_id % 3 = 1 THEN 'en vivo desde cali' ELSE 'nada' END AS title,
        ([{",".join(f"'{u}'" for u in _URLS)}])[doc_id % 5 + 1] || doc_id AS url FROM documents),
    t AS (SELECT doc_id, url, lower(strip_accents(title || '  ' || url)) AS x FROM b)
    SELECT doc_id, CAST({" + ".join(f"2 * CAST(contains(x, '{w}') AS INT)" for w in report.SCORE_TERMS)} + 2 * CAST(regexp_matches(x, '[0-9]') AS INT)
      + 3 * CAST(contains(x, 'colombia') OR contains(x, 'ungrd') OR contains(x, 'sgc') OR regexp_matches(x, '(^|[^a-z0-9_])cali($|[^a-z0-9_])') AS INT)
      + 4 * CAST(doc_id % 5 < 2 AS INT) + CAST(doc_id % 5 = 2 AS INT) - 6 * CAST(regexp_matches(x, '(^|[^a-z0-9_])en vivo($|[^a-z0-9_])') AS INT) AS INTEGER) AS score FROM t""",
)
def p21(spark, d):
    tail = F.when(F.col("doc_id") % 3 == 0, "balance de fallecidos").when(F.col("doc_id") % 3 == 1, "en vivo desde cali").otherwise("nada")
    profile = report.EventProfile(places=["Cali"], unrelated_terms=["zzzz-none"])
    return table(spark, d, "documents").select(
        "doc_id", report.search_score(F.concat_ws(" ", "text", tail), F.lit(None).cast("string"), _doc_url(), profile).alias("score")
    )


@query(
    "P22",
    """SELECT doc_id, (regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}\\p{M}_])(en vivo|directo|live[-_\\s]?news|última hora|ultima hora|minuto a minuto|liveblog)($|[^\\p{L}\\p{N}\\p{M}_])')
      OR doc_id % 7 = 0) AS live FROM documents""",
)
def p22(spark, d):
    tail = F.when(F.col("doc_id") % 7 == 0, "Última hora").when(F.col("doc_id") % 7 == 1, "el directorio").otherwise("")
    return table(spark, d, "documents").select("doc_id", text.is_liveblog(F.concat_ws(" ", "text", tail), F.lit(None).cast("string")).alias("live"))


@query(
    "P23",
    f"""WITH b AS (SELECT doc_id, {DOC_FOLD} || CASE doc_id % 4 WHEN 0 THEN ' ungrd y sgc' WHEN 1 THEN ' la gobernacion' WHEN 2 THEN ' sgcx' ELSE ' alcaldia y presidencia de colombia' END AS t FROM documents)
    SELECT doc_id, concat_ws(',', CASE WHEN contains(t, 'ungrd') OR contains(t, 'unidad nacional para la gestion del riesgo') THEN 'UNGRD' END,
      CASE WHEN contains(t, 'servicio geologico colombiano') OR regexp_matches(t, '(^|[^a-z0-9_])sgc($|[^a-z0-9_])') THEN 'SGC' END,
      CASE WHEN contains(t, 'presidencia de la republica') OR contains(t, 'presidencia de colombia') THEN 'presidencia' END,
      CASE WHEN contains(t, 'gobernacion') THEN 'gobernacion' END, CASE WHEN contains(t, 'alcaldia') THEN 'alcaldia' END) AS ids FROM b""",
)
def p23(spark, d):
    k = F.col("doc_id") % 4
    tail = F.when(k == 0, "UNGRD y SGC").when(k == 1, "la Gobernación").when(k == 2, "SGCx").otherwise("Alcaldía y Presidencia de Colombia")
    found = report.cited_sources(F.concat_ws(" ", "text", tail))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(found, lambda s: s["id"]), ",").alias("ids"))


@query(
    "P24",
    """SELECT doc_id, (['web','web','web','youtube','web'])[doc_id % 5 + 1] AS channel, (['UNGRD','Servicio Geológico Colombiano','El Tiempo','youtube.com','blog.example'])[doc_id % 5 + 1] AS publisher
    FROM documents""",
)
def p24(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", report.channel(_doc_url()).alias("channel"), report.publisher_name(web.url_host(_doc_url())).alias("publisher")
    )


def _bulletin():
    k = F.col("doc_id")
    dotted = F.concat((k % 90 + 1).cast("string"), F.lit("."), F.lpad((k % 1000).cast("string"), 3, "0"))
    pieces = [
        F.lit(". Balance: "), (k % 400 + 1).cast("string"), F.lit(" personas fallecidas, "), dotted, F.lit(" heridas, "), (k % 50).cast("string"),
        F.lit(" desaparecidas y "), (k % 70).cast("string"), F.lit(" personas rescatadas; "), dotted, F.lit(" viviendas averiadas, "),
        (k % 33).cast("string"), F.lit(" destruidas. Hubo "), dotted, F.lit(" familias damnificadas en "), (k % 300).cast("string"), F.lit(" municipios afectados de "),
        (k % 30).cast("string"), F.lit(" departamentos afectados"), F.when(k % 2 == 0, F.concat(F.lit(", con "), dotted, F.lit(" personas afectadas."))).otherwise("."),
    ]
    return F.concat(F.col("text"), *pieces)


@query(
    "P25",
    """WITH b AS (SELECT doc_id, (doc_id % 90 + 1) * 1000 + doc_id % 1000 AS n FROM documents)
    SELECT doc_id, doc_id % 30 AS departamentos_afectados, doc_id % 300 AS municipios_afectados, CASE WHEN doc_id % 2 = 0 THEN n END AS personas_afectadas,
      n AS familias_afectadas, n AS viviendas_averiadas, doc_id % 33 AS viviendas_destruidas, n AS heridos, doc_id % 400 + 1 AS fallecidos,
      doc_id % 50 AS desaparecidos, doc_id % 70 AS rescatados FROM b""",
)
def p25(spark, d):
    return table(spark, d, "documents").select("doc_id", report.figures(_bulletin()).alias("f")).select("doc_id", "f.*")


@query(
    "P27",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '2026-08-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') WHEN 1 THEN '2026-08-17' WHEN 3 THEN '2025-01-02' END AS cutoff,
      CASE doc_id % 4 WHEN 2 THEN 'url' ELSE 'text' END AS signal FROM documents""",
)
def p27(spark, d):
    k = F.col("doc_id")
    tail = (
        F.when(k % 4 == 0, F.concat(F.lit(". Balance oficial de la entidad este "), (k % 28 + 1).cast("string"), F.lit(" de agosto")))
        .when(k % 4 == 1, ". Tras el sismo del 10 de agosto, el balance del 17 de agosto suma 289 muertos")
        .when(k % 4 == 2, ". El terremoto del 10 de agosto dejó cientos de muertos").otherwise(". A 2 de enero de 2025 las cifras no cambian")
    )
    day = report.cutoff_day(F.concat(F.col("text"), tail), "2026")
    address = F.concat(F.lit("https://x.example/2026/08/20/"), k.cast("string"))
    rows = table(spark, d, "documents").select("doc_id", day.alias("cutoff"), address.alias("url"))
    return rows.select("doc_id", "cutoff", report.dated_cutoff(F.col("cutoff"), F.col("url"), F.lit(None).cast("string"))["signal"].alias("signal"))


@query(
    "P28",
    f"""WITH {GATE_SQL}
    SELECT doc_id, CASE WHEN contains(w, 'edan') OR contains(w, 'rud') OR contains(w, 'damnific') THEN 'oficial_posible_edan_rud'
        WHEN contains(w, 'vivienda') OR contains(w, 'afectad') OR contains(w, 'herido') OR contains(w, 'fallecid') THEN 'oficial_con_posibles_cifras'
        WHEN contains(w, 'sismo') OR contains(w, 'terremoto') OR contains(w, 'temblor') THEN 'oficial_menciona_evento' ELSE 'oficial_no_relacionado' END AS status,
      CASE WHEN evidence AND regexp_matches(text, '(?i)edan|rud|damnific|viviendas?|heridos?|fallecid') AND regexp_matches(text, '[0-9]') THEN 'media' WHEN evidence THEN 'baja' ELSE 'ninguna' END AS confidence
    FROM e""",
)
def p28(spark, d):
    body = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", report.report_status(body).alias("status"), report.report_confidence(body, PROFILE).alias("confidence")
    )


@query(
    "P28_quote",
    r"""WITH s AS (SELECT doc_id, text, list_filter(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: contains(lower(strip_accents(x)), 'thouou')) AS hits FROM documents)
    SELECT doc_id, substring(coalesce(hits[1], substring(text, 1, 240)), 1, 280) AS quote FROM s""",
)
def p28_quote(spark, d):
    return table(spark, d, "documents").select("doc_id", report.report_quote(F.col("text"), ["thouou"]).alias("quote"))


@query(
    "P34",
    "SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 OR o_orderkey % 7 = 0 THEN NULL ELSE round((o_custkey % 3) / ((o_orderkey % 7) * 1000.0::DOUBLE) * 100, 4) END AS pct FROM orders",
)
def p34(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", numbers.rate_pct((F.col("o_custkey") % 3).cast("double"), (F.col("o_orderkey") % 7 * 1000).cast("double")).alias("pct")
    )


@query(
    "P35",
    """SELECT page_id, (page_id % 3 = 0 OR page_id % 5 = 1 OR regexp_matches(url, 'rcn|semana|caracol|pulzo')) AS national FROM pages""",
)
def p35(spark, d):
    k = F.col("page_id")
    name = F.when(k % 3 == 0, "La República").otherwise("Otro")
    domain = F.when(k % 5 == 1, "diario.com.co").otherwise("x.example")
    return table(spark, d, "pages").select(k, report.is_national(name, domain, F.col("url")).alias("national"))


_ENC = "array_to_string(list_transform(string_split({0}, ''), lambda c: CASE WHEN c = ' ' THEN '%20' WHEN regexp_matches(c, '[^\\x00-\\x7f]') THEN url_encode(c) ELSE c END), '')"


@query(
    "P36",
    f"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>')) AS a,
        generate_subscripts(regexp_extract_all(html, '(?is)<a\\b[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>'), 1) AS pos FROM pages),
    h AS (SELECT page_id, url, pos, regexp_extract(a, '(?is)href=["'']([^"'']+)["'']', 1) AS href, trim({STRIPPED_HTML.format("regexp_extract(a, '(?is)^<a[^>]*>(.*?)</a>', 1)")}) AS title FROM a),
    r AS (SELECT page_id, pos, href, title, CASE WHEN regexp_matches(href, '^[a-z]+:') THEN href WHEN href LIKE '/%' THEN regexp_extract(url, '^[a-z]+://[^/?#]+') || href
        ELSE regexp_replace(regexp_extract(url, '^[^?#]*'), '[^/]*$', '') || href END AS u FROM h WHERE NOT regexp_matches(href, '^(#|mailto:|tel:)')),
    e AS (SELECT page_id, pos, {_ENC.format("u")} AS link_url, CASE WHEN title = '' THEN href ELSE title END AS link_title FROM r)
    SELECT page_id, link_url, arg_min(link_title, pos) AS link_title FROM e GROUP BY page_id, link_url""",
)
def p36(spark, d):
    return web.page_links(table(spark, d, "pages"), "page_id", "url", "html")


@query(
    "P37",
    """SELECT page_id, regexp_matches(url, '(?i)\\.(pdf|png|jpe?g|webp)(\\?|$)') OR page_id % 11 = 0 AS visual,
      regexp_extract(url, '^[a-z]+://(?:www\\.)?([^/?#]+)', 1) = 'therha.example.com' AS same_host,
      (contains(url, 'thth') AND NOT contains(url, 'xyzgeneric') AND contains(url, '/en/')) AS candidate FROM pages""",
)
def p37(spark, d):
    url = F.col("url")
    profile = report.EventProfile(
        event_terms=["thth"], event_places=["zzz"], damage_terms=["/en/"], generic_terms=["xyzgeneric"], unrelated_terms=["zzz"], places=["zzz"], date_pattern="zzz"
    )
    kind = F.when(F.col("page_id") % 11 == 0, "application/pdf").otherwise("text/html")
    # the gate drops addresses from prose, so the link text is offered without its scheme
    shown = F.replace(url, F.lit("://"), F.lit(" "))
    return table(spark, d, "pages").select(
        "page_id", web.is_visual_document(url, kind).alias("visual"), web.same_host(url, F.lit("http://www.therha.example.com/x")).alias("same_host"),
        report.is_candidate_link(shown, profile).alias("candidate"),
    )


@query(
    "P38",
    """WITH t AS (SELECT page_id, html, list_filter(string_split_regex(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda w: w <> '') AS words FROM pages),
    m AS (SELECT page_id, CAST(len(words) AS INTEGER) AS words, CAST(len(regexp_extract_all(html, '<tr[ >]')) + len(regexp_extract_all(html, '<li>')) AS INTEGER) AS rows, octet_length(encode(html)) / 1024.0::DOUBLE AS kb,
      html NOT LIKE '%<link rel="canonical"%' AS no_canonical FROM t)
    SELECT page_id, words, rows, kb, no_canonical, concat_ws(',', CASE WHEN words < 200 THEN 'words' END, CASE WHEN rows < 6 THEN 'rows' END, CASE WHEN kb > 4 THEN 'size' END, CASE WHEN no_canonical THEN 'canonical' END) AS findings FROM m""",
)
def p38(spark, d):
    out = web.page_audit(table(spark, d, "pages"), "page_id", "html", {"words": 200, "rows": 6, "kb": 4})
    return out.select("page_id", "words", "rows", "kb", "no_canonical", F.array_join("findings", ",").alias("findings"))


@query(
    "P40",
    "SELECT c_custkey, sha256(CAST(json_object('c_custkey', c_custkey, 'c_mktsegment', c_mktsegment, 'c_name', c_name, 'missing', NULL) AS VARCHAR)) AS fingerprint FROM customer",
)
def p40(spark, d):
    rows = table(spark, d, "customer").withColumn("missing", F.lit(None).cast("string"))
    return rows.select("c_custkey", row_fingerprint(["c_name", "missing", "c_custkey", "c_mktsegment"]).alias("fingerprint"))


@query(
    "P41",
    """SELECT page_id, CASE page_id % 3 WHEN 0 THEN '2026-08-' || lpad(CAST(page_id % 20 + 1 AS VARCHAR), 2, '0') || ':' || url WHEN 1 THEN 'sin-fecha:' || url ELSE url END AS item_key FROM pages""",
)
def p41(spark, d):
    k = F.col("page_id")
    source = F.when(k % 3 < 2, "daily-search").otherwise("feed")
    day = F.when(k % 3 == 0, F.concat(F.lit("2026-08-"), F.lpad((k % 20 + 1).cast("string"), 2, "0")))
    return table(spark, d, "pages").select(k, web.item_key(source, day, F.col("url"), "daily-search").alias("item_key"))


@query(
    "P42",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN '../media/' || event_id || '.JPG' WHEN 1 THEN 'https://archive.example/' || event_id || '.mp4' ELSE 'https://up.example/' || event_id || '.pdf' END AS media FROM events""",
)
def p42(spark, d):
    k = F.col("event_id")
    key = k.cast("string")
    local = F.when(k % 3 == 0, F.concat(F.lit("media/"), key, F.lit(".JPG")))
    remote = F.concat(F.lit("https://up.example/"), key, F.when(k % 3 == 1, ".mp4").otherwise(".pdf"))
    return table(spark, d, "events").select(k, web.media_reference(local, remote, "https://archive.example/").alias("media"))


@query(
    "P43",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 10:30 UTC' ELSE 'spring' END AS stamp FROM orders""",
)
def p43(spark, d):
    k = F.col("o_orderkey")
    raw = (
        F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(k % 3 == 1, F.concat(F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit(" 10:30 UTC")))
        .otherwise("spring")
    )
    return table(spark, d, "orders").select(k, dates.imagery_stamp(raw).alias("stamp"))


@query(
    "P44",
    """SELECT doc_id, CASE WHEN contains(lower(text), 'unosat') THEN 'UNITAR-UNOSAT' WHEN doc_id % 3 = 0 OR contains(lower(text), 'copernicus') THEN 'Copernicus EMS' WHEN contains(lower(text), 'echo') THEN 'EC/ECHO' ELSE 'Una fuente institucional' END AS issuer FROM documents""",
)
def p44(spark, d):
    tail = F.when(F.col("doc_id") % 3 == 0, "a COPERNICUS activation").otherwise("")
    return table(spark, d, "documents").select("doc_id", report.issuer(F.concat_ws(" ", "text", tail)).alias("issuer"))


@query("P45", "SELECT lang, 'limite_palabra_sin_enlaces' AS places_rule, 'texto_sin_enlaces_v2' AS figures_rule, count(*) AS n FROM documents GROUP BY lang")
def p45(spark, d):
    stamped = report.stamp_rules(table(spark, d, "documents"), places_rule="limite_palabra_sin_enlaces", figures_rule="texto_sin_enlaces_v2")
    return stamped.groupBy("lang", "places_rule", "figures_rule").agg(F.count("*").alias("n"))
