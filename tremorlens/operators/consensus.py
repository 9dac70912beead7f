"""Noisy published figures to one monotone series.

A day's candidates are inspected in rank order and the first acceptable value wins,
against a maximum that stays fixed during the day.  Acceptance depends on earlier
days, so it is a fold; what enters the fold is small: per day and metric only
distinct values, and of those only the ones that can still be the first hit for some
current maximum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorlens.functions.report import FIGURES, broken_relations, is_national
from tremorlens.functions.text import is_liveblog
from tremorlens.plans.joins import derived_join
from tremorlens.plans.rows import unnest

# Fixed values.
ANCHORS = ["fallecidos", "familias_afectadas"]
DISPUTED = ["fallecidos", "heridos", "desaparecidos", "familias_afectadas"]
JUMP_CEILING = 5
DISPUTE_MARGIN = 1.15
REGRESSION_MARGIN = 0.9
REASONS = {
    "incoherent": "cifra incoherente con el resto del mismo balance",
    "unattributed": "sin atribución oficial trazable",
    "regress": "retrocede sobre el máximo informado",
    "jump": "salto de más de 5 veces el máximo informado",
}
# Rows of the registry-versus-media comparison.
COMPARISON = [
    ("municipios", "municipios_afectados"), ("familias", "familias_afectadas"),
    ("personas", "personas_afectadas"), ("viv_destruidas", "viviendas_destruidas"),
    ("viv_averiadas", "viviendas_averiadas"), ("fallecidos", "fallecidos"),
    ("heridos", "heridos"), ("desaparecidos", "desaparecidos"),
]

KEYS = ["event_key", "day"]


def attributed(captures: DataFrame) -> Column:
    """A figure someone official stands behind, or that quotes someone official."""
    return F.coalesce(F.col("official"), F.lit(False)) | (F.coalesce(F.col("n_sources"), F.lit(0)) > 0)


def score_source() -> Column:
    official = F.coalesce(F.col("official"), F.lit(False))
    return (
        F.when(official & F.coalesce(F.col("source_level") == "oficial_institucional", F.lit(False)), 4)
        .when(official, 3).when(F.coalesce(F.col("n_sources"), F.lit(0)) > 0, 2).otherwise(0)
    )


def anchor_maxima(captures: DataFrame, anchors: list[str] = ANCHORS) -> DataFrame:
    """Greatest anchor figures of all days before each day, attributed or not."""
    daily = captures.groupBy(*KEYS).agg(*[F.max(F.col("figures")[a]).alias(a) for a in anchors])
    past = Window.partitionBy("event_key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return daily.select(*KEYS, *[F.max(a).over(past).alias(f"max_{a}") for a in anchors])


def with_order(captures: DataFrame, anchors: list[str] = ANCHORS, metrics: list[str] = FIGURES) -> DataFrame:
    """Adds ``rank_key``, an ascending struct that ranks the candidates of a day."""
    figures = F.col("figures")
    maxima = anchor_maxima(captures, anchors)
    joined = derived_join(captures, maxima, KEYS, "left")
    regress = F.lit(False)
    without = F.lit(True)
    for a in anchors:
        drop = figures[a] < F.col(f"max_{a}") * REGRESSION_MARGIN
        regress = regress | F.coalesce(drop, F.lit(False))
        without = without & figures[a].isNull()
    filled = sum((figures[m].isNotNull().cast("int") for m in metrics), F.lit(0))
    live = is_liveblog(F.col("title"), F.col("url"), F.col("is_liveblog"))
    national = is_national(F.col("publisher_name"), F.col("publisher_domain"), F.col("url"))
    latest = F.coalesce(F.unix_micros(F.col("captured_at").cast("timestamp")), F.lit(-(2**62)))
    order = F.struct(
        regress.cast("int").alias("regress"), without.cast("int").alias("no_anchor"),
        (F.size(broken_relations(figures)) > 0).cast("int").alias("incoherent"),
        (-score_source()).alias("source"), live.cast("int").alias("live"), (-national.cast("int")).alias("national"),
        (-filled).alias("filled"), (-latest).alias("recency"), F.col("item_id"),
    )
    return joined.withColumn("rank_key", order).drop(*[f"max_{a}" for a in anchors])


def best_of_day(ranked: DataFrame) -> DataFrame:
    """The day's leading capture; a min aggregate, so a busy day costs no sort."""
    rest = [c for c in ranked.columns if c not in KEYS]
    return ranked.groupBy(*KEYS).agg(F.min_by(F.struct(*rest), "rank_key").alias("_b"), F.count("*").alias("n_candidates")).select(
        *KEYS, "_b.*", "n_candidates"
    )


def candidates(ranked: DataFrame, metrics: list[str] = FIGURES) -> DataFrame:
    """One row per capture and stated figure, with the two acceptance flags."""
    broken = F.size(broken_relations(F.col("figures"))) > 0
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col("figures")[m].cast("bigint").alias("value")) for m in metrics])
    keep = [
        *KEYS, "rank_key", F.coalesce("publisher_name", "publisher_domain").alias("outlet"), "url",
        attributed(ranked).alias("attributed"), broken.alias("_broken"),
    ]
    long = unnest(ranked, keep, F.filter(entries, lambda e: e["value"].isNotNull()), "_e")
    return long.select(
        *KEYS, F.col("_e.metric").alias("metric"), F.col("_e.value").alias("value"), "rank_key", "outlet", "url",
        "attributed", (F.col("_broken") & (F.col("_e.metric") == "personas_afectadas")).alias("quarantined"),
    )


def _contenders(long: DataFrame) -> DataFrame:
    """Per day and metric, the values that can be the first hit for some maximum.

    A value only matters at its best rank.  Inside a band narrower than the ceiling, a
    value that lies between two better-ranked ones is always preceded by one of them.
    """
    best = long.filter(F.col("attributed") & ~F.col("quarantined")).groupBy(*KEYS, "metric", "value").agg(
        F.min(F.struct("rank_key", "outlet", "url")).alias("c")
    )
    band = F.when(F.col("value") > 0, F.floor(F.log(F.col("value").cast("double")) / F.log(F.lit(2.0)))).otherwise(F.lit(-1))
    earlier = Window.partitionBy(*KEYS, "metric", "_band").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    return (
        best.withColumn("_band", band)
        .withColumn("_low", F.min("value").over(earlier)).withColumn("_high", F.max("value").over(earlier))
        .filter(F.col("_low").isNull() | (F.col("value") < F.col("_low")) | (F.col("value") > F.col("_high")))
        .select(*KEYS, "metric", "value", "c")
    )


def accepted_values(long: DataFrame, ceiling: int = JUMP_CEILING) -> DataFrame:
    """The accepted changes ``(event_key, metric, day, value, outlet, url, rank_key)``."""
    import pyarrow as pa

    def run(batches):
        """Rows of a figure stream by in order; only the value in force and today's state are held."""
        figure, day, value, base, taken = None, None, None, None, False
        for batch in batches:
            kept = []
            for here, when, new in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if here != figure:
                    figure, day, value, base, taken = here, None, None, None, False
                if when != day:
                    day, base, taken = when, value, False
                accept = not taken and (base is None or (new > base and (base <= 0 or new <= base * ceiling)))
                if accept:
                    value, taken = new, True
                kept.append(accept)
            yield batch.filter(pa.array(kept, pa.bool_()))

    steps = _contenders(long).select("event_key", "metric", "day", "value", "c")
    ordered = steps.repartition("event_key", "metric").sortWithinPartitions("event_key", "metric", "day", "c", "value")
    return ordered.mapInArrow(run, steps.schema).select(
        "event_key", "metric", "day", "value", F.col("c.outlet").alias("outlet"), F.col("c.url").alias("url"), F.col("c.rank_key").alias("rank_key")
    )


def daily_series(captures: DataFrame, accepted: DataFrame, metrics: list[str] = FIGURES) -> DataFrame:
    """Every captured day and metric with the value in force, its own date and outlet.

    Days before the first accepted value carry NULL: absence, not zero.
    """
    days = captures.select(*KEYS).distinct().withColumn("metric", F.explode(F.array(*[F.lit(m) for m in metrics])))
    changes = accepted.select(*KEYS, "metric", F.struct("value", F.col("day").alias("since"), "outlet", "url").alias("_c"))
    upto = Window.partitionBy("event_key", "metric").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    filled = days.join(changes, [*KEYS, "metric"], "left").withColumn("_c", F.last("_c", ignorenulls=True).over(upto))
    return filled.select(*KEYS, "metric", "_c.*")


def rejected_values(long: DataFrame, series: DataFrame, accepted: DataFrame, ceiling: int = JUMP_CEILING) -> DataFrame:
    """Values that were inspected and turned down, each with its reason.

    Candidates ranked after the accepted one were never inspected; a value equal to the
    maximum says nothing new and stays silent.
    """
    before = Window.partitionBy("event_key", "metric").orderBy("day")
    base = series.select(*KEYS, "metric", F.lag("value").over(before).alias("base"))
    winner = accepted.select(*KEYS, "metric", F.col("rank_key").alias("_win"))
    limits = base.join(winner, [*KEYS, "metric"], "left")
    judged = derived_join(long, limits, [*KEYS, "metric"], "left")
    inspected = judged.filter(F.col("_win").isNull() | (F.col("rank_key") < F.col("_win")))
    reason = (
        F.when(F.col("quarantined"), REASONS["incoherent"])
        .when(~F.col("attributed"), REASONS["unattributed"])
        .when(F.col("value") < F.col("base"), REASONS["regress"])
        .when((F.col("base") > 0) & (F.col("value") > F.col("base") * ceiling), REASONS["jump"])
    )
    return inspected.withColumn("reason", reason).filter("reason IS NOT NULL").select(
        *KEYS, "metric", "value", "reason", "outlet", "url"
    )


def day_disputes(captures: DataFrame, metrics: list[str] = DISPUTED, margin: float = DISPUTE_MARGIN) -> DataFrame:
    """Metrics on which a day's attributed, coherent captures differ beyond the margin."""
    sound = captures.filter(attributed(captures) & (F.size(broken_relations(F.col("figures"))) == 0))
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col("figures")[m].alias("value")) for m in metrics])
    long = sound.select(*KEYS, F.explode(entries).alias("e")).select(*KEYS, "e.*").filter("value IS NOT NULL")
    spread = long.groupBy(*KEYS, "metric").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n")
    )
    return spread.filter((F.col("n") >= 2) & (F.col("low") > 0) & (F.col("high") > F.col("low") * margin))


def balance_alert(series: DataFrame, today: str, yesterday: str) -> DataFrame:
    """Latest consolidated value against the previous captured day, when it moved.

    One row per event and metric whose last day is recent and whose value changed.  Days
    after ``today`` are not known yet.
    """
    keys = ["event_key", "metric"]
    series = series.filter(F.col("day").cast("string") <= today)
    order = Window.partitionBy(*keys).orderBy("day")
    lagged = series.withColumn("previous", F.lag("value").over(order)).withColumn("n_days", F.row_number().over(order))
    last = lagged.groupBy(*keys).agg(F.max_by(F.struct("day", "value", "previous", "n_days"), "day").alias("l")).select(*keys, "l.*")
    fresh = F.col("day").cast("string").isin(today, yesterday)
    moved = (F.col("n_days") == 1) | ~F.col("value").eqNullSafe(F.col("previous"))
    return last.filter(fresh & moved).select(
        *keys, "day", "value", "previous", (F.col("value") - F.col("previous")).alias("delta")
    )


def compare_sources(registry: DataFrame, media: DataFrame, pairs: list[tuple[str, str]] = COMPARISON) -> DataFrame:
    """Figure by figure, registry total against media maximum; absent stays absent.

    ``registry`` and ``media`` are long: event_key, metric, value.
    """
    names = F.create_map(*[F.lit(v) for pair in pairs for v in pair])
    wanted = registry.select("event_key").unionByName(media.select("event_key")).distinct().select(
        "event_key", F.explode(F.array(*[F.lit(p[0]) for p in pairs])).alias("metric")
    )
    left = registry.select("event_key", "metric", F.col("value").alias("registry"))
    right = media.select("event_key", F.col("metric").alias("_m"), F.col("value").alias("media"))
    return (
        wanted.withColumn("_m", names[F.col("metric")]).join(left, ["event_key", "metric"], "left")
        .join(right, ["event_key", "_m"], "left")
        .select("event_key", "metric", "registry", "media", F.abs(F.col("media") - F.col("registry")).alias("difference"))
    )
