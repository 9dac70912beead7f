"""Headlines: one corpus, daily volume, facets, paging, source cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlens.functions.dates import before_event
from tremorlens.functions.text import fold
from tremorlens.plans.rows import unnest


def news_corpus(sources: dict[str, DataFrame], event_day: str) -> DataFrame:
    """U01 + P12: one tagged corpus; rows provably before the event are flagged, not lost."""
    out = None
    for origin, frame in sources.items():
        part = frame.select("url", "day", "title", "outlet").withColumn("origin", F.lit(origin))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("before_event", before_event(F.col("day"), event_day))


def corpus_counts(corpus: DataFrame) -> DataFrame:
    """Kept and cut rows, so the filter leaves a trace."""
    return corpus.groupBy("origin").agg(
        F.count_if(~F.col("before_event")).alias("kept"), F.count_if("before_event").alias("cut")
    )


def daily_items(items: DataFrame, day: str, source: str) -> DataFrame:
    """Items and distinct sources per dated day."""
    return items.filter(F.col(day).isNotNull()).groupBy(day).agg(
        F.count("*").alias("items"), F.count_distinct(source).alias("sources")
    )


def media_volume(captures: DataFrame, feeds: DataFrame, counters: list[str]) -> DataFrame:
    """Greatest value of each counter over captures, plus the feeds' own daily count.

    A counter nobody measured on a day stays NULL.  ``captures``: event_key, day and the
    counters; ``feeds``: event_key, day, feeds.
    """
    best = captures.groupBy("event_key", "day").agg(*[F.max(c).alias(c) for c in counters])
    return best.join(feeds, ["event_key", "day"], "full")


def ingest_summary(items: DataFrame, feeds: DataFrame) -> DataFrame:
    """Per feed, items seen and kept; a failing feed keeps its error row.

    ``items``: feed, relevant; ``feeds``: feed, error.
    """
    counted = items.groupBy("feed").agg(F.count("*").alias("items"), F.count_if("relevant").alias("kept"))
    return feeds.join(counted, "feed", "left").withColumns(
        {c: F.when(F.col("error").isNull(), F.coalesce(F.col(c), F.lit(0))) for c in ("items", "kept")}
    )


def facet_counts(rows: DataFrame, arrays: list[str], scalars: list[str]) -> DataFrame:
    """Value counts of several facets in one pass over the rows."""
    def entry(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("facet"), value.cast("string").alias("value"))

    singles = F.array(*[entry(s, F.col(s)) for s in scalars]) if scalars else F.array()
    def listing(name: str) -> Column:
        return F.transform(F.array_distinct(name), lambda v: entry(name, v))

    parts = [listing(a) for a in arrays]
    listed = unnest(rows, [], F.concat(singles, *parts) if scalars else F.concat(*parts), "_f")
    return listed.select("_f.*").filter("value IS NOT NULL").groupBy("facet", "value").agg(F.count("*").alias("n"))


def search(rows: DataFrame, text: str | None = None, columns: list[str] = (), equals: dict[str, str] | None = None,
           holds: dict[str, str] | None = None, flags: list[str] = ()) -> DataFrame:
    """Faceted search; every given condition narrows the result."""
    out = rows
    if text:
        # the literal is folded by the same expression as the column
        haystack = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
        out = out.filter(fold(haystack).contains(fold(F.lit(text))))
    for column, value in (equals or {}).items():
        out = out.filter(F.col(column) == value)
    for column, value in (holds or {}).items():
        out = out.filter(F.array_contains(column, value))
    for flag in flags:
        out = out.filter(F.col(flag))
    return out


def sorted_rows(rows: DataFrame, column: str, descending: bool = False, tie: list[str] = (), spanish: bool = False) -> DataFrame:
    """NULL or empty last in both directions, tie-break columns, Spanish text order."""
    value = F.col(column)
    if rows.schema[column].dataType.typeName() == "string":
        value = F.nullif(value, F.lit(""))
    if spanish:
        value = F.collate(value, "es")
    key = value.desc_nulls_last() if descending else value.asc_nulls_last()
    return rows.orderBy(key, *tie)


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of the ordered rows."""
    ordered = rows.orderBy(*order)
    return ordered.limit(size) if number == 1 else ordered.offset((number - 1) * size).limit(size)


def top_scored(rows: DataFrame, keys: list[str], score: str, tie: list[str], n: int = 3) -> DataFrame:
    """Best ``n`` per key by score."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), *tie)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def group_extreme(rows: DataFrame, keys: list[str], item: str, by: str) -> DataFrame:
    """The item with the greatest value; the first name wins a tie."""
    leading = F.struct(-F.col(by), F.col(item))
    return rows.groupBy(*keys).agg(F.max(by).alias(by), F.min_by(item, leading).alias(item))


def source_cards(satellite: DataFrame, registry: DataFrame, media: DataFrame, citizen: DataFrame) -> DataFrame:
    """One headline figure per family of sources, each with its own date.

    Each input: event_key, day, value.
    """
    out = None
    for name, frame in {"satellite": satellite, "registry": registry, "media": media, "citizen": citizen}.items():
        part = frame.select("event_key", F.lit(name).alias("card"), F.col("day").cast("date").alias("day"), F.col("value").cast("bigint").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out
