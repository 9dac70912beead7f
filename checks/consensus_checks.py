"""Captures to the consolidated series."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import CAPTURES_SQL, REGISTRY_SQL, captures, query, registry, table
from tremorlens.functions import report
from tremorlens.operators import consensus

RECURSIVE = "WITH " + CAPTURES_SQL


def _ranked(spark, d):
    return consensus.with_order(captures(spark, d))


@query("W05", f"{RECURSIVE} SELECT event_key, day, max_fallecidos, max_familias_afectadas FROM daymax")
def w05(spark, d):
    return consensus.anchor_maxima(captures(spark, d))


@query("W04", f"{RECURSIVE} SELECT event_key, day, item_id, n_candidates FROM (SELECT *, count(*) OVER (PARTITION BY event_key, day) AS n_candidates FROM ranked) WHERE rk = 1")
def w04(spark, d):
    return consensus.best_of_day(_ranked(spark, d)).select("event_key", "day", "item_id", "n_candidates")


@query("W06", f"{RECURSIVE} SELECT event_key, day, metric, value, since FROM series")
def w06(spark, d):
    rows = captures(spark, d)
    accepted = consensus.accepted_values(consensus.candidates(consensus.with_order(rows)))
    return consensus.daily_series(rows, accepted).select("event_key", "day", "metric", "value", "since")


@query(
    "W06_rejected",
    f"""{RECURSIVE}, based AS (SELECT *, lag(value) OVER (PARTITION BY event_key, metric ORDER BY day) AS base FROM series),
    j AS (SELECT l.*, b.base, a.rk AS win FROM long l JOIN based b USING (event_key, day, metric) LEFT JOIN accepted a USING (event_key, day, metric)),
    r AS (SELECT event_key, day, metric, value, CASE WHEN quarantined THEN '{consensus.REASONS["incoherent"]}' WHEN NOT attributed THEN '{consensus.REASONS["unattributed"]}'
      WHEN value < base THEN '{consensus.REASONS["regress"]}' WHEN base > 0 AND value > 5 * base THEN '{consensus.REASONS["jump"]}' END AS reason
      FROM j WHERE win IS NULL OR rk < win)
    SELECT event_key, metric, reason, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM r WHERE reason IS NOT NULL GROUP BY ALL""",
)
def w06_rejected(spark, d):
    rows = captures(spark, d)
    long = consensus.candidates(consensus.with_order(rows))
    accepted = consensus.accepted_values(long)
    out = consensus.rejected_values(long, consensus.daily_series(rows, accepted), accepted)
    return out.groupBy("event_key", "metric", "reason").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(
    "A18",
    f"""{RECURSIVE}, l AS ({" UNION ALL ".join(f"SELECT event_key, day, '{m}' AS metric, {m} AS value FROM judged WHERE attributed AND NOT broken AND {m} IS NOT NULL" for m in consensus.DISPUTED)})
    SELECT event_key, day, metric, min(value) AS low, max(value) AS high, count(*) AS n FROM l GROUP BY ALL
    HAVING count(*) >= 2 AND min(value) > 0 AND max(value) > min(value) * 1.15::DOUBLE""",
)
def a18(spark, d):
    return consensus.day_disputes(captures(spark, d))


@query(
    "A25",
    f"""{RECURSIVE}, s AS (SELECT event_key, metric, day, value, lag(value) OVER w AS previous FROM series WHERE day <= DATE '2024-01-03'
      WINDOW w AS (PARTITION BY event_key, metric ORDER BY day))
    SELECT event_key, metric, day, value, previous, value - previous AS delta FROM s WHERE day = DATE '2024-01-03' AND value IS DISTINCT FROM previous""",
)
def a25(spark, d):
    rows = captures(spark, d)
    series = consensus.daily_series(rows, consensus.accepted_values(consensus.candidates(consensus.with_order(rows))))
    return consensus.balance_alert(series, "2024-01-03", "2024-01-02")


@query(
    "J21",
    f"""{RECURSIVE}, {REGISTRY_SQL},
    m AS (SELECT event_key, metric, max(value) AS value FROM series GROUP BY ALL),
    r AS (SELECT e.event_key, v.metric, v.value FROM (SELECT 'E1' AS event_key, count(*) AS n, CAST(sum(families) AS BIGINT) AS f, CAST(sum(persons) AS BIGINT) AS p FROM registry) e,
      LATERAL (VALUES ('municipios', e.n), ('familias', e.f), ('personas', e.p)) AS v(metric, value)),
    names(metric, m) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in consensus.COMPARISON)}),
    keys AS (SELECT DISTINCT event_key FROM m UNION SELECT event_key FROM r)
    SELECT keys.event_key, names.metric, r.value AS registry, m.value AS media, abs(m.value - r.value) AS difference
    FROM keys CROSS JOIN names LEFT JOIN r ON r.event_key = keys.event_key AND r.metric = names.metric
    LEFT JOIN m ON m.event_key = keys.event_key AND m.metric = names.m""",
)
def j21(spark, d):
    rows = captures(spark, d)
    series = consensus.daily_series(rows, consensus.accepted_values(consensus.candidates(consensus.with_order(rows))))
    media = series.groupBy("event_key", "metric").agg(F.max("value").alias("value"))
    total = registry(spark, d).groupBy("event_key").agg(
        F.count("*").alias("municipios"), F.sum("families").alias("familias"), F.sum("persons").alias("personas")
    )
    official = total.unpivot("event_key", ["municipios", "familias", "personas"], "metric", "value")
    return consensus.compare_sources(official, media)


@query(
    "P26",
    """WITH r AS (SELECT o_orderkey, o_custkey AS persons, (o_orderkey * 7) % 900 + 1 AS families, o_orderkey % 50 + 1 AS deaths FROM orders)
    SELECT o_orderkey, CASE WHEN persons >= families AND persons >= deaths THEN persons WHEN o_orderkey % 3 = 0 THEN 100000 END AS persons, families, deaths,
      CAST(CASE WHEN persons >= families AND persons >= deaths THEN 1 ELSE 2 END AS INTEGER) AS n_attempts,
      CASE WHEN (persons >= families AND persons >= deaths) OR o_orderkey % 3 = 0 THEN NULL ELSE 'personas_afectadas' END AS discarded FROM r""",
)
def p26(spark, d):
    k = F.col("o_orderkey")
    # the wording of an image is read only when the text without images contradicts itself
    linked = F.when(k % 3 == 0, "![100.000 personas afectadas](https://x.example/balance.jpg) ").otherwise("")
    text = F.concat(
        linked, F.col("o_custkey").cast("string"), F.lit(" personas afectadas y "), ((k * 7) % 900 + 1).cast("string"), F.lit(" familias damnificadas; "),
        (k % 50 + 1).cast("string"), F.lit(" fallecidos."),
    )
    rows = report.read_figures(table(spark, d, "orders").select("o_orderkey", text.alias("text")), "text")
    f = F.col("figures")
    return rows.select(
        "o_orderkey", f["personas_afectadas"].alias("persons"), f["familias_afectadas"].alias("families"), f["fallecidos"].alias("deaths"),
        F.size("attempts").alias("n_attempts"), F.array_join("discarded", ",").alias("discarded"),
    )

