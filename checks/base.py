"""Registry of queries, and the roles the given tables play in them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremorlens.session import cut_lineage, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def positioned(df: DataFrame) -> DataFrame:
    """The rows of a sorted frame with their place in it, from 1.

    The sort is written once; a row's place is its place in its partition after the rows of the partitions before.
    """
    rows = cut_lineage(df.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return rows.join(before, part == F.col("_part")).withColumn("position", place).drop("_at", "_part", "_before")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---- located points of several services -------------------------------------------------
def points(spark, folder) -> DataFrame:
    label = F.col("label")
    grades = F.array(*[F.lit(g) for g in ("Destroyed", "Damaged", "Possibly damaged", "Not Applicable")])
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("lon"), F.col("embedding")[1].cast("double").alias("lat"),
        F.concat(F.lit("s"), (label % 3).cast("string")).alias("source"), F.get(grades, label % 4).alias("grade"),
        F.when(label < 9, F.concat(F.lit("P"), (label % 5).cast("string"))).alias("place"), label,
    )


POINTS_SQL = """points AS (
  SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS lon, CAST(embedding[2] AS DOUBLE) AS lat,
         's' || CAST(label % 3 AS VARCHAR) AS source,
         (['Destroyed','Damaged','Possibly damaged','Not Applicable'])[label % 4 + 1] AS grade,
         CASE WHEN label < 9 THEN 'P' || CAST(label % 5 AS VARCHAR) END AS place, label
  FROM embeddings)"""

# ---- one five-cornered zone with a hole per nation, on a 5 x 5 board ---------------------
OUTER = [(0, 0), (160, 20), (200, 140), (80, 200), (10, 120)]
HOLE = [(60, 60), (100, 60), (100, 100), (60, 100)]


def zones(spark, folder) -> DataFrame:
    k = F.col("n_nationkey")
    ox, oy, scale = (k % 5) * 150 - 400, F.floor(k / 5) * 150 - 400, k % 3 + 2

    def ring(corners):
        pairs = [
            F.format_string("%.3f %.3f", (ox + F.lit(x) * scale / 2) / 1000.0, (oy + F.lit(y) * scale / 2) / 1000.0)
            for x, y in [*corners, corners[0]]
        ]
        return F.concat(F.lit("("), F.concat_ws(", ", *pairs), F.lit(")"))

    return table(spark, folder, "nation").select(
        F.col("n_name").alias("zone"), F.concat(F.lit("POLYGON ("), ring(OUTER), F.lit(", "), ring(HOLE), F.lit(")")).alias("wkt")
    )


def _corner_values() -> str:
    rows = []
    for ring, corners in enumerate((OUTER, HOLE)):
        closed = [*corners, corners[0]]
        for i, (a, b) in enumerate(zip(closed, [closed[-1], *closed[:-1]], strict=True)):
            rows.append(f"({ring},{i},{a[0]},{a[1]},{b[0]},{b[1]})")
    return ",".join(rows)


ZONES_SQL = f"""edges AS (
  SELECT n_name AS zone, ring,
    ((n_nationkey % 5) * 150 - 400 + x * (n_nationkey % 3 + 2) / 2.0) / 1000.0 AS xi,
    ((n_nationkey // 5) * 150 - 400 + y * (n_nationkey % 3 + 2) / 2.0) / 1000.0 AS yi,
    ((n_nationkey % 5) * 150 - 400 + px * (n_nationkey % 3 + 2) / 2.0) / 1000.0 AS xj,
    ((n_nationkey // 5) * 150 - 400 + py * (n_nationkey % 3 + 2) / 2.0) / 1000.0 AS yj
  FROM nation, (VALUES {_corner_values()}) AS c(ring, i, x, y, px, py)),
boxes AS (SELECT zone, (max(xi) - min(xi)) * (max(yi) - min(yi)) AS area FROM edges WHERE ring = 0 GROUP BY zone),
crossings AS (
  SELECT p.id, e.zone, e.ring,
    sum(CASE WHEN (e.yi > p.lat) <> (e.yj > p.lat)
             AND p.lon < (e.xj - e.xi) * (p.lat - e.yi) / (e.yj - e.yi) + e.xi THEN 1 ELSE 0 END) % 2 AS odd
  FROM points p, edges e GROUP BY p.id, e.zone, e.ring),
inside AS (
  SELECT id, zone FROM crossings GROUP BY id, zone
  HAVING max(CASE WHEN ring = 0 THEN odd END) = 1 AND max(CASE WHEN ring = 1 THEN odd END) = 0),
hit AS (
  SELECT id, zone FROM (
    SELECT i.id, i.zone, row_number() OVER (PARTITION BY i.id ORDER BY b.area, i.zone) AS rn
    FROM inside i JOIN boxes b USING (zone)) WHERE rn = 1)"""


# ---- one place centre per nation ---------------------------------------------------------
def centres(spark, folder) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, folder, "nation").select(
        F.col("n_name").alias("place"), (((k % 5) * 150 - 300) / 1000.0).alias("plon"), ((F.floor(k / 5) * 150 - 300) / 1000.0).alias("plat")
    )


CENTRES_SQL = """centres AS (
  SELECT n_name AS place, ((n_nationkey % 5) * 150 - 300) / 1000.0::DOUBLE AS plon,
         ((n_nationkey // 5) * 150 - 300) / 1000.0::DOUBLE AS plat FROM nation)"""


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * "
        f"cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"
    )


# ---- daily registry ----------------------------------------------------------------------
def registry(spark, folder) -> DataFrame:
    """Orders as a registry: department and municipality per captured day."""
    return table(spark, folder, "orders").groupBy(
        F.lit("E1").alias("event_key"), F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("department"),
        F.col("o_orderpriority").alias("municipality"),
    ).agg(F.count("*").alias("families"), F.sum("o_custkey").cast("bigint").alias("persons"))


REGISTRY_SQL = """registry AS (
  SELECT 'E1' AS event_key, CAST(o_orderdate AS DATE) AS day, o_orderstatus AS department, o_orderpriority AS municipality,
         count(*) AS families, CAST(sum(o_custkey) AS BIGINT) AS persons
  FROM orders GROUP BY ALL)"""


# ---- report captures ---------------------------------------------------------------------
def captures(spark, folder) -> DataFrame:
    """Events as captures of published figures."""
    k = F.get_json_object("props", "$.k").cast("int")
    u = F.col("user_id")
    value, kind = F.col("value"), F.col("event_type")

    def scaled(factor: int):
        return F.floor(value * factor).cast("bigint")

    figures = {
        "departamentos_afectados": F.when(kind == "signup", F.floor(value / 20).cast("bigint")),
        "municipios_afectados": F.when(kind.isin("signup", "view"), F.floor(value / 4).cast("bigint")),
        "personas_afectadas": F.when(kind.isin("view", "click"), scaled(30)),
        "familias_afectadas": F.when(kind != "error", F.floor(value * (7 + k % 5)).cast("bigint")),
        "viviendas_averiadas": F.when(kind == "purchase", scaled(9)),
        "viviendas_destruidas": F.when(kind == "purchase", scaled(2)),
        "heridos": F.when(kind.isin("error", "click"), scaled(3)),
        "fallecidos": F.when(k % 4 != 0, F.floor(value).cast("bigint")),
        "desaparecidos": F.when(kind == "error", scaled(1)),
        "rescatados": F.when(kind == "error", F.floor(value / 2).cast("bigint")),
    }
    names = F.array(*[F.lit(n) for n in ("El Tiempo", "Primicias", "Clarin", "Portal")])
    return table(spark, folder, "events").select(
        F.concat(F.lit("E"), (u % 2).cast("string")).alias("event_key"), F.to_date("ts").alias("day"), F.col("event_id").alias("item_id"),
        F.col("ts").alias("captured_at"), F.when(k % 10 == 0, "Cobertura en vivo").otherwise("Balance").alias("title"),
        F.concat(F.lit("https://outlet"), (u % 4).cast("string"), F.lit(".example/"), F.col("event_id").cast("string")).alias("url"),
        F.get(names, (u % 4).cast("int")).alias("publisher_name"), F.concat(F.lit("outlet"), (u % 4).cast("string"), F.lit(".example")).alias("publisher_domain"),
        (u % 7 == 0).alias("official"), F.when(u % 14 == 0, "oficial_institucional").otherwise("temporal_prensa").alias("source_level"),
        (k % 3).cast("int").alias("n_sources"), F.lit(False).alias("is_liveblog"), F.struct(*[v.alias(n) for n, v in figures.items()]).alias("figures"),
    )


METRICS_SQL = {
    "departamentos_afectados": "CASE WHEN event_type = 'signup' THEN CAST(floor(value / 20) AS BIGINT) END",
    "municipios_afectados": "CASE WHEN event_type IN ('signup','view') THEN CAST(floor(value / 4) AS BIGINT) END",
    "personas_afectadas": "CASE WHEN event_type IN ('view','click') THEN CAST(floor(value * 30) AS BIGINT) END",
    "familias_afectadas": "CASE WHEN event_type <> 'error' THEN CAST(floor(value * (7 + k % 5)) AS BIGINT) END",
    "viviendas_averiadas": "CASE WHEN event_type = 'purchase' THEN CAST(floor(value * 9) AS BIGINT) END",
    "viviendas_destruidas": "CASE WHEN event_type = 'purchase' THEN CAST(floor(value * 2) AS BIGINT) END",
    "heridos": "CASE WHEN event_type IN ('error','click') THEN CAST(floor(value * 3) AS BIGINT) END",
    "fallecidos": "CASE WHEN k % 4 <> 0 THEN CAST(floor(value) AS BIGINT) END",
    "desaparecidos": "CASE WHEN event_type = 'error' THEN CAST(floor(value * 1) AS BIGINT) END",
    "rescatados": "CASE WHEN event_type = 'error' THEN CAST(floor(value / 2) AS BIGINT) END",
}
_BROKEN = " OR ".join(
    f"coalesce(personas_afectadas < {m}, false)" for m in ("familias_afectadas", "fallecidos", "heridos", "desaparecidos")
)
_FILLED = " + ".join(f"CASE WHEN {m} IS NULL THEN 0 ELSE 1 END" for m in METRICS_SQL)

CAPTURES_SQL = f"""raw AS (
  SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events),
captures AS (
  SELECT 'E' || CAST(user_id % 2 AS VARCHAR) AS event_key, CAST(ts AS DATE) AS day, event_id AS item_id, ts AS captured_at,
    k % 10 = 0 AS live, user_id % 4 = 0 AS national, (['El Tiempo','Primicias','Clarin','Portal'])[user_id % 4 + 1] AS outlet,
    'https://outlet' || CAST(user_id % 4 AS VARCHAR) || '.example/' || CAST(event_id AS VARCHAR) AS url,
    CASE WHEN user_id % 14 = 0 THEN 4 WHEN user_id % 7 = 0 THEN 3 WHEN k % 3 > 0 THEN 2 ELSE 0 END AS source_score,
    (user_id % 7 = 0 OR k % 3 > 0) AS attributed, {", ".join(f"{sql} AS {m}" for m, sql in METRICS_SQL.items())}
  FROM raw),
judged AS (SELECT *, ({_BROKEN}) AS broken, {_FILLED} AS filled FROM captures),
daymax AS (
  SELECT event_key, day,
    max(max(fallecidos)) OVER w AS max_fallecidos, max(max(familias_afectadas)) OVER w AS max_familias_afectadas
  FROM captures GROUP BY event_key, day
  WINDOW w AS (PARTITION BY event_key ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ranked AS (
  SELECT j.*, row_number() OVER (PARTITION BY j.event_key, j.day ORDER BY
      CASE WHEN coalesce(fallecidos < max_fallecidos * 0.9::DOUBLE, false)
             OR coalesce(familias_afectadas < max_familias_afectadas * 0.9::DOUBLE, false) THEN 1 ELSE 0 END,
      CASE WHEN fallecidos IS NULL AND familias_afectadas IS NULL THEN 1 ELSE 0 END,
      CASE WHEN broken THEN 1 ELSE 0 END, source_score DESC, CASE WHEN live THEN 1 ELSE 0 END,
      CASE WHEN national THEN 0 ELSE 1 END, filled DESC, captured_at DESC, item_id) AS rk
  FROM judged j JOIN daymax USING (event_key, day)),
long AS (
  {" UNION ALL ".join(f"SELECT event_key, day, '{m}' AS metric, {m} AS value, rk, outlet, url, attributed, "
                      + ("broken" if m == "personas_afectadas" else "false") + f" AS quarantined FROM ranked WHERE {m} IS NOT NULL"
                      for m in METRICS_SQL)}),
steps AS (
  SELECT event_key, metric, list({{'day': day, 'rk': rk, 'v': value, 'cur': CAST(NULL AS BIGINT), 'base': CAST(NULL AS BIGINT), 'taken': false,
                                   'trail': CAST([] AS STRUCT(day DATE, rk BIGINT, v BIGINT)[])}} ORDER BY day, rk) AS xs
  FROM long WHERE attributed AND NOT quarantined GROUP BY event_key, metric),
folded AS (
  SELECT event_key, metric, list_reduce(
    list_prepend({{'day': DATE '1900-01-01', 'rk': CAST(0 AS BIGINT), 'v': CAST(0 AS BIGINT), 'cur': CAST(NULL AS BIGINT),
                  'base': CAST(NULL AS BIGINT), 'taken': false, 'trail': CAST([] AS STRUCT(day DATE, rk BIGINT, v BIGINT)[])}}, xs),
    lambda a, x: CASE
      WHEN (CASE WHEN a.day = x.day THEN NOT a.taken ELSE true END)
           AND ((CASE WHEN a.day = x.day THEN a.base ELSE a.cur END) IS NULL
                OR (x.v > (CASE WHEN a.day = x.day THEN a.base ELSE a.cur END)
                    AND ((CASE WHEN a.day = x.day THEN a.base ELSE a.cur END) <= 0
                         OR x.v <= 5 * (CASE WHEN a.day = x.day THEN a.base ELSE a.cur END))))
      THEN {{'day': x.day, 'rk': x.rk, 'v': x.v, 'cur': x.v, 'base': CASE WHEN a.day = x.day THEN a.base ELSE a.cur END, 'taken': true,
            'trail': list_append(a.trail, {{'day': x.day, 'rk': x.rk, 'v': x.v}})}}
      ELSE {{'day': x.day, 'rk': x.rk, 'v': x.v, 'cur': a.cur, 'base': CASE WHEN a.day = x.day THEN a.base ELSE a.cur END,
            'taken': CASE WHEN a.day = x.day THEN a.taken ELSE false END, 'trail': a.trail}} END) AS st
  FROM steps),
accepted AS (
  SELECT event_key, metric, t.day AS day, t.v AS value, t.rk AS rk FROM (SELECT event_key, metric, unnest(st.trail) AS t FROM folded)),
series AS (
  SELECT d.event_key, d.day, m.metric,
    last_value(a.value IGNORE NULLS) OVER w AS value, last_value(a.day IGNORE NULLS) OVER w AS since
  FROM (SELECT DISTINCT event_key, day FROM captures) d
  CROSS JOIN (VALUES {",".join(f"('{m}')" for m in METRICS_SQL)}) AS m(metric)
  LEFT JOIN accepted a ON a.event_key = d.event_key AND a.day = d.day AND a.metric = m.metric
  WINDOW w AS (PARTITION BY d.event_key, m.metric ORDER BY d.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

# ---- words that serve as place names -----------------------------------------------------
# The documents are invented prose, so frequent words stand for places.
TOPONYMS = [
    ("Z1", "that"), ("Z1", "of the"), ("Z2", "und"), ("Z3", "les"), ("Z3", "de la"), ("Z4", "que"), ("Z5", "thouou"),
    ("Z6", "ré"), ("Z7", "the, in"),
]
GAZETTEER = [
    ("Alpha", "the", "erthly", True, False), ("Beta", "und", "der", True, False), ("Gamma", "de", "lès", False, False),
    ("Delta", "de", "la", True, False), ("Epsilon", "the", "of the", False, False), ("Homonym", "the", "und", False, True),
    ("Eta", "en", "que la", True, False),
]
GAZETTEER_SCHEMA = "municipality string, department string, term string, needs_department boolean, homonym boolean"


def toponyms(spark) -> DataFrame:
    from tremorlens.plans.terms import literal_terms

    return literal_terms(spark, TOPONYMS, "zone string, term string")


def gazetteer(spark) -> DataFrame:
    from tremorlens.plans.terms import literal_terms

    return literal_terms(spark, GAZETTEER, GAZETTEER_SCHEMA)


def quoted(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    return "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(quoted(v) for v in row) + ")" for row in rows)


def _fold(text: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").lower()


def _word_sql(term: str) -> str:
    import re

    edge = r"[^\p{L}\p{N}\p{M}_]"
    return f"regexp_matches(t, '(^|{edge}){re.escape(_fold(term))}($|{edge})')"


def _hits(rows: list[tuple], columns: list[str], term: int) -> str:
    """One branch per term, so that each pattern is a constant."""
    return " UNION ALL ".join(
        "SELECT doc_id, " + ", ".join(f"{quoted(row[i])} AS {c}" for i, c in enumerate(columns) if i != term) + f" FROM texts WHERE {_word_sql(row[term])}"
        for row in rows
    )


DEPARTMENTS = sorted({(row[1], row[1]) for row in GAZETTEER})
TERM_SQL = f"""texts AS (SELECT doc_id, lower(strip_accents(text)) AS t FROM documents),
zone_hits AS ({_hits(TOPONYMS, ["zone", "term"], 1)}),
place_hits AS ({_hits(GAZETTEER, ["municipality", "department", "term", "needs", "homonym"], 2)}),
backed AS (SELECT DISTINCT doc_id, department FROM ({_hits(DEPARTMENTS, ["department", "term"], 1)}))"""
