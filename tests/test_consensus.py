"""Consolidated series: literal cases, random fold against brute force, stream against batch."""

import datetime as dt
import random
import uuid

from pyspark.sql import functions as F

from tremorlens.functions.report import FIGURES
from tremorlens.operators import consensus
from tremorlens.session import shared_dir
from tremorlens.streaming import jobs

SCHEMA = (
    "event_key string, day date, item_id bigint, captured_at timestamp, title string, url string, publisher_name string, publisher_domain string, "
    "official boolean, source_level string, n_sources int, is_liveblog boolean, figures struct<" + ",".join(f"{m}:bigint" for m in FIGURES) + ">"
)


def capture(i, day, name, figures, sources=1, official=False, live=False):
    stamp = dt.datetime.fromisoformat(f"{day}T04:00:00")
    return ("E", dt.date.fromisoformat(day), i, stamp, f"balance {name}", f"https://{name.lower()}.example/{i}", name, f"{name.lower()}.example", official,
            "temporal_prensa", sources, live, tuple(figures.get(m) for m in FIGURES))


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    ranked = consensus.with_order(df)
    long = consensus.candidates(ranked)
    accepted = consensus.accepted_values(long)
    series = consensus.daily_series(df, accepted)
    return df, ranked, long, accepted, series


def values(series, day):
    return {r["metric"]: (r["value"], str(r["since"])) for r in series.filter(F.col("day") == day).collect() if r["value"] is not None}


HIGH = dict(zip(FIGURES, [15, 450, 186016, 120328, 127557, 26945, 4187, 294, 426, 356], strict=True))


def test_no_figure_ever_decreases_and_the_rejected_are_kept(spark):
    low = {k: max(1, v // 10) for k, v in HIGH.items()}
    _, _, long, accepted, series = run(spark, [capture(1, "2026-08-18", "Bueno", HIGH), capture(2, "2026-08-19", "Viejo", low)])
    assert values(series, "2026-08-19") == {m: (v, "2026-08-18") for m, v in HIGH.items()}
    rejected = consensus.rejected_values(long, series, accepted).collect()
    assert {(r["metric"], r["value"]) for r in rejected} == set(low.items())
    assert {r["reason"] for r in rejected} == {consensus.REASONS["regress"]}


def test_a_missing_figure_keeps_its_date(spark):
    rows = [capture(1, "2026-08-15", "Uno", {"familias_afectadas": 54008, "fallecidos": 294}), capture(2, "2026-08-16", "Dos", {"fallecidos": 300})]
    assert values(run(spark, rows)[4], "2026-08-16") == {"familias_afectadas": (54008, "2026-08-15"), "fallecidos": (300, "2026-08-16")}


def test_slight_correction_is_not_penalised(spark):
    rows = [
        capture(1, "2026-08-15", "Uno", {"familias_afectadas": 54008, "fallecidos": 294}), capture(2, "2026-08-16", "X", {"fallecidos": 280, "familias_afectadas": 54008}),
    ]
    best = consensus.best_of_day(run(spark, rows)[1]).filter(F.col("day") == "2026-08-16").first()
    assert best["item_id"] == 2 and best["rank_key"]["regress"] == 0


def test_jump_and_attribution(spark):
    rows = [
        capture(1, "2026-08-15", "Uno", {"municipios_afectados": 100}), capture(2, "2026-08-16", "Salto", {"municipios_afectados": 900}),
        capture(3, "2026-08-16", "Mudo", {"municipios_afectados": 200}, sources=0),
    ]
    _, _, long, accepted, series = run(spark, rows)
    assert values(series, "2026-08-16") == {"municipios_afectados": (100, "2026-08-15")}
    assert {r["reason"] for r in consensus.rejected_values(long, series, accepted).collect()} == {consensus.REASONS["jump"], consensus.REASONS["unattributed"]}


def test_incoherent_persons_are_quarantined_alone(spark):
    rows = [capture(1, "2026-08-18", "Boletin", {"personas_afectadas": 304, "fallecidos": 400, "familias_afectadas": 10})]
    assert set(values(run(spark, rows)[4], "2026-08-18")) == {"fallecidos", "familias_afectadas"}


def test_same_day_dispute(spark):
    rows = [capture(1, "2026-08-16", "A", {"fallecidos": 181}), capture(2, "2026-08-16", "B", {"fallecidos": 294}), capture(3, "2026-08-16", "C", {"fallecidos": 18}, sources=0)]
    found = consensus.day_disputes(run(spark, rows)[0]).collect()
    assert [(r["metric"], r["low"], r["high"]) for r in found] == [("fallecidos", 181, 294)]


def random_rows(seed, n=400):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        day = f"2026-08-{rnd.randint(10, 22)}"
        figures = {m: int(10 ** rnd.uniform(0, 4)) if rnd.random() < 0.9 else 0 for m in FIGURES if rnd.random() < 0.5}
        rows.append(capture(i, day, rnd.choice(["El Tiempo", "Primicias", "X"]), figures, rnd.randint(0, 2), rnd.random() < 0.2, rnd.random() < 0.2))
    return rows


def brute(ranked_long):
    """Walk days and ranked candidates one by one."""
    out = {}
    for metric in FIGURES:
        current = None
        mine = sorted((r for r in ranked_long if r["metric"] == metric), key=lambda r: (r["day"], tuple(r["rank_key"])))
        for day in sorted({r["day"] for r in mine}):
            base = current
            for r in mine:
                if r["day"] != day or not r["attributed"] or r["quarantined"]:
                    continue
                if base is None or (r["value"] > base and not (base > 0 and r["value"] > base * 5)):
                    current = r["value"]
                    out[metric, day] = current
                    break
    return out


def test_fold_equals_brute_force(spark):
    for seed in (1, 2, 3):
        _, _, long, accepted, _ = run(spark, random_rows(seed))
        got = {(r["metric"], r["day"]): r["value"] for r in accepted.collect()}
        assert got == brute([r.asDict() for r in long.collect()])


def test_stream_equals_batch_when_nothing_is_late(spark):
    _, _, long, accepted, _ = run(spark, random_rows(7))
    folder = f"{shared_dir(spark)}/t03-{uuid.uuid4().hex}"
    fields = ("regress", "no_anchor", "incoherent", "source", "live", "national", "filled", "recency", "item_id")
    rank = F.concat_ws("|", *[F.lpad((F.col(f"rank_key.{c}") + 10**16).cast("string"), 18, "0") for c in fields])
    usable = long.filter("attributed AND NOT quarantined").select("event_key", "metric", F.col("day").cast("string").alias("day"), rank.alias("rank"), "value", "outlet")
    usable.write.parquet(folder + "/in")
    stream = spark.readStream.schema(usable.schema).parquet(folder + "/in")
    out = jobs.run_once(jobs.running_maximum(stream), folder + "/out").collect()
    assert {(r["metric"], r["day"]): r["value"] for r in out} == {(r["metric"], str(r["day"])): r["value"] for r in accepted.collect()}
