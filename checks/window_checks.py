"""Windows, orders, paging and the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import POINTS_SQL, REGISTRY_SQL, ZONES_SQL, captures, points, positioned, query, registry, table, zones
from checks.spatial_checks import GRID, GRID_SQL, grid
from tremorlens.functions import report
from tremorlens.operators import citizen, coverage, media, snapshots, spatial
from tremorlens.operators import registry as reg

PRODUCT_SQL = "prod AS (SELECT o_orderpriority AS zone, o_orderkey AS id, o_custkey % 5 AS monitoring, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 4 END AS version, CAST(o_orderdate AS DATE) AS snapshot_date FROM orders)"


def _products(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("zone"), k.alias("id"), (F.col("o_custkey") % 5).alias("monitoring"), F.when(k % 3 != 0, k % 4).alias("version"), F.to_date("o_orderdate").alias("snapshot_date")
    )


@query(
    "W01",
    f"""WITH {PRODUCT_SQL} SELECT zone, monitoring, version, id, n AS n_products FROM (SELECT *, count(*) OVER (PARTITION BY zone) AS n,
      row_number() OVER (PARTITION BY zone ORDER BY monitoring DESC, coalesce(version, 0) DESC, id DESC) AS rn FROM prod) WHERE rn = 1""",
)
def w01(spark, d):
    rows = _products(spark, d).select("zone", "id", "monitoring", "version")
    return snapshots.latest_product(rows, ["zone"], ["monitoring", "version"]).select("zone", "monitoring", "version", "id", "n_products")


@query("W02", f"WITH {PRODUCT_SQL} SELECT zone, monitoring, id FROM prod p WHERE snapshot_date = (SELECT max(snapshot_date) FROM prod q WHERE q.zone = p.zone AND q.monitoring = p.monitoring)")
def w02(spark, d):
    return snapshots.latest_per_key(_products(spark, d), ["zone", "monitoring"]).select("zone", "monitoring", "id")


@query("W03", f"WITH {PRODUCT_SQL} SELECT zone, id, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY snapshot_date, id) AS rn FROM prod) WHERE rn <= 3")
def w03(spark, d):
    return coverage.examples(_products(spark, d), ["zone"], ["snapshot_date", "id"]).select("zone", "id", "rank")


@query("W07", f"WITH {REGISTRY_SQL} SELECT department, municipality, day, families - lag(families) OVER (PARTITION BY department, municipality ORDER BY day) AS increment FROM registry")
def w07(spark, d):
    return reg.increments(registry(spark, d), ["department", "municipality"], "day", "families").select("department", "municipality", "day", "increment")


MEDIA_SQL = f"""{POINTS_SQL}, m AS (SELECT id, lon, lat, CASE WHEN id % 5 <> 0 THEN 'h' || id % 60 END AS sha FROM points),
dup AS (SELECT m.*, CASE WHEN sha IS NOT NULL AND id <> min(id) OVER (PARTITION BY sha) THEN min(id) OVER (PARTITION BY sha) END AS duplicate_of FROM m)"""


def _media(spark, d):
    rows = points(spark, d).select("id", "lon", "lat", F.when(F.col("id") % 5 != 0, F.concat(F.lit("h"), (F.col("id") % 60).cast("string"))).alias("sha"))
    return citizen.duplicate_media(rows, "id", "sha", "id")


@query("W08", f"WITH {MEDIA_SQL} SELECT id, duplicate_of FROM dup")
def w08(spark, d):
    return _media(spark, d).select("id", "duplicate_of")


@query(
    "W09",
    f"""WITH {MEDIA_SQL}, {ZONES_SQL.replace("points AS", "unused AS")},
    {GRID_SQL},
    s AS (SELECT d.id, h.zone, CAST(coalesce(f.intensity % 9 >= 5, false)::INT + (h.zone IS NOT NULL)::INT + (d.id % 4 <> 0)::INT + 2 * (d.sha IS NOT NULL AND d.duplicate_of IS NULL)::INT AS INTEGER) AS score FROM dup d LEFT JOIN hit h USING (id) LEFT JOIN felt f USING (id))
    SELECT id, zone, score, CASE WHEN id % 13 = 0 THEN 'validado' WHEN score >= 3 THEN 'coherente' ELSE 'recibido' END AS state FROM s""",
)
def w09(spark, d):
    k = F.col("id")
    placed = spatial.containing_zone(_media(spark, d), "id", "lon", "lat", zones(spark, d), "zone", "wkt")
    felt = spatial.grid_value(placed, F.col("lon"), F.col("lat"), GRID, grid(spark, d), "felt")
    ready = felt.withColumn("intensity", F.col("felt") % 9).withColumn("ts", F.when(k % 4 == 0, "2026-08-10T12:00:00").otherwise("2026-08-11T00:00:00")).withColumn(
        "state", F.when(k % 13 == 0, "validado").otherwise("recibido")
    )
    return citizen.score_reports(ready, F.lit("2026-08-10T12:34:28")).select("id", "zone", "score", "state")


@query("W10", f"WITH {PRODUCT_SQL} SELECT zone, monitoring, min(snapshot_date) AS first_seen, max(snapshot_date) AS last_seen FROM prod GROUP BY ALL")
def w10(spark, d):
    return snapshots.first_seen(_products(spark, d), ["zone", "monitoring"], "snapshot_date")


@query(
    "W11",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 7 - 3 >= 0 THEN CAST(o_orderkey % 7 - 3 AS INTEGER) END AS lag_days FROM orders""",
)
def w11(spark, d):
    k = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    published = F.concat(F.date_add(day, (k % 7 - 3).cast("int")).cast("string"), F.lit("T10:00:00"))
    return table(spark, d, "orders").select(k, report.report_lag_days(published, F.when(k % 4 != 0, day.cast("string"))).alias("lag_days"))


@query(
    "W12",
    f"""WITH {REGISTRY_SQL}, x AS (SELECT DISTINCT department, municipality, day FROM registry WHERE day >= DATE '1999-01-01'),
    g AS (SELECT department, municipality, day, lead(day) OVER (PARTITION BY department, municipality ORDER BY day) AS nx FROM x)
    SELECT department, municipality, CAST(unnest(generate_series(CAST(day + 1 AS TIMESTAMP), CAST(nx - 1 AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS lost_day FROM g WHERE nx - day > 1""",
)
def w12(spark, d):
    series = reg.since_event(registry(spark, d), "day", "1999-01-01")
    return reg.lost_days(series, ["department", "municipality"], "day")


@query(
    "W13",
    f"""WITH {REGISTRY_SQL}, c AS (SELECT 'E' || user_id % 2 AS event_key, CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'view') AS n FROM events GROUP BY ALL),
    v AS (SELECT event_key, day, CASE WHEN day < DATE '2024-01-20' THEN n END AS value FROM c), l AS (SELECT event_key, max(day) FILTER (value IS NOT NULL) AS last FROM v GROUP BY 1)
    SELECT 'E0' AS event_key, DATE '2024-01-05' AS day, 'local' AS kind UNION ALL SELECT event_key, min(day), 'first_report' FROM c GROUP BY 1 UNION ALL SELECT event_key, min(day), 'first_registry' FROM registry GROUP BY 1
    UNION ALL SELECT v.event_key, min(day), 'series_stopped' FROM v JOIN l USING (event_key) WHERE day > last GROUP BY 1""",
)
def w13(spark, d):
    rows = captures(spark, d)
    volume = table(spark, d, "events").groupBy(F.concat(F.lit("E"), (F.col("user_id") % 2).cast("string")).alias("event_key"), F.to_date("ts").alias("day")).agg(
        F.count_if(F.col("event_type") == "view").alias("n")
    ).select("event_key", "day", F.when(F.col("day") < F.lit("2024-01-20").cast("date"), F.col("n")).alias("value"))
    marks = spark.range(1).select(F.lit("E0").alias("event_key"), F.lit("2024-01-05").cast("date").alias("day"), F.lit("local").alias("kind"))
    return reg.timeline(marks, rows, registry(spark, d), volume)


# ---------------------------------------------------------------- sorts, pages, extremes
LISTED_SQL = """n AS (SELECT s_suppkey, CASE WHEN s_suppkey % 10 < 9 THEN s_acctbal END AS v FROM supplier),
t AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN '' WHEN p_partkey % 7 <> 0 THEN p_name END AS name FROM part)"""


@query(
    "L01",
    f"""WITH {LISTED_SQL}
    SELECT s_suppkey AS id, 'asc' AS direction, row_number() OVER (ORDER BY v ASC NULLS LAST, s_suppkey) AS position FROM n
    UNION ALL SELECT s_suppkey, 'desc', row_number() OVER (ORDER BY v DESC NULLS LAST, s_suppkey) FROM n
    UNION ALL SELECT p_partkey, 'text', row_number() OVER (ORDER BY nullif(name, '') ASC NULLS LAST, p_partkey) FROM t
    UNION ALL SELECT p_partkey, 'text desc', row_number() OVER (ORDER BY nullif(name, '') DESC NULLS LAST, p_partkey) FROM t
    UNION ALL SELECT p_partkey, 'es', row_number() OVER (ORDER BY nullif(name, '') ASC NULLS LAST, p_partkey) FROM t""",
)
def l01(spark, d):
    """Whole tables in each order, with the place of every row (Spanish order of these plain names is that of their letters)."""
    numbers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 10 < 9, F.col("s_acctbal")).alias("v"))
    k = F.col("p_partkey")
    names = table(spark, d, "part").select(k.alias("id"), F.when(k % 9 == 0, "").when(k % 7 != 0, F.col("p_name")).alias("v"))
    orders = {"asc": (numbers, False, False), "desc": (numbers, True, False), "text": (names, False, False), "text desc": (names, True, False), "es": (names, False, True)}
    out = None
    for direction, (rows, descending, spanish) in orders.items():
        part = positioned(media.sorted_rows(rows, "v", descending, ["id"], spanish)).select("id", F.lit(direction).alias("direction"), "position")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "L03",
    "(SELECT event_id, 'recent' AS page FROM events ORDER BY ts DESC, event_id LIMIT 200) UNION ALL (SELECT event_id, 'third' FROM events ORDER BY ts DESC, event_id OFFSET 100 LIMIT 50)",
)
def l03(spark, d):
    rows, order = table(spark, d, "events"), [F.col("ts").desc(), F.col("event_id")]
    recent = media.page(rows, order, 1, 200).select("event_id", F.lit("recent").alias("page"))
    return recent.unionByName(media.page(rows, order, 3, 50).select("event_id", F.lit("third").alias("page")))


@query("L04", "SELECT event_type, event_id, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 3")
def l04(spark, d):
    return media.top_scored(table(spark, d, "events"), ["event_type"], "value", ["event_id"], 3).select("event_type", "event_id", "rank")


@query("L05", "SELECT l_returnflag, max(l_quantity) AS l_quantity, arg_min(l_orderkey, (-l_quantity, l_orderkey)) AS l_orderkey FROM lineitem GROUP BY 1")
def l05(spark, d):
    return media.group_extreme(table(spark, d, "lineitem"), ["l_returnflag"], "l_orderkey", "l_quantity")


CORPUS_SQL = """corpus AS (SELECT 'd' || doc_id AS url, CASE WHEN doc_id % 6 <> 0 THEN CAST(DATE '2026-08-01' + CAST(doc_id % 20 AS INTEGER) AS VARCHAR) END AS day, md5(text) AS title, source AS outlet, 'documents' AS origin FROM documents
  UNION ALL SELECT 'c' || conv_id || '-' || turn, '2026-08-09', md5(text), role, 'conversations' FROM conversations UNION ALL SELECT 'b' || item_id, '2026-08-10', md5(text), NULL, 'benchmark' FROM benchmark),
flagged AS (SELECT *, coalesce(day < '2026-08-10', false) AS before_event FROM corpus)"""


def _corpus(spark, d):
    k = F.col("doc_id")
    title = F.md5(F.col("text").cast("binary")).alias("title")
    docs = table(spark, d, "documents").select(
        F.concat(F.lit("d"), k.cast("string")).alias("url"), F.when(k % 6 != 0, F.date_add(F.lit("2026-08-01").cast("date"), (k % 20).cast("int")).cast("string")).alias("day"), title, F.col("source").alias("outlet")
    )
    talks = table(spark, d, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("url"), F.lit("2026-08-09").alias("day"), title, F.col("role").alias("outlet")
    )
    bench = table(spark, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("url"), F.lit("2026-08-10").alias("day"), title, F.lit(None).cast("string").alias("outlet"))
    return media.news_corpus({"documents": docs, "conversations": talks, "benchmark": bench}, "2026-08-10")


@query("U01", f"WITH {CORPUS_SQL} SELECT * FROM flagged")
def u01(spark, d):
    return _corpus(spark, d)


@query("P12_corpus", f"WITH {CORPUS_SQL} SELECT origin, count(*) FILTER (NOT before_event) AS kept, count(*) FILTER (before_event) AS cut FROM flagged GROUP BY origin")
def p12_corpus(spark, d):
    return media.corpus_counts(_corpus(spark, d))


