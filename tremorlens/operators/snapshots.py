"""Snapshot tables: latest state, differences, history guards, keyed upserts
(S01, W01, W02, W10, J14-J17, J20, J25, J27, K05, U02-U05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorlens.plans.joins import derived_join, null_safe_join, skew_join, with_scalar


def latest_snapshot(df: DataFrame, day: str = "snapshot_date") -> DataFrame:
    """Rows of the newest captured day.

    The day is a scalar subquery in a filter, so a table partitioned by ``day`` is read in that partition alone.
    """
    return df.filter(F.col(day) == df.agg(F.max(day)).scalar())


def latest_per_key(df: DataFrame, keys: list[str], day: str = "snapshot_date") -> DataFrame:
    """Rows of the newest day of each key."""
    newest = df.groupBy(*keys).agg(F.max(day).alias(day))
    return derived_join(df, newest, [*keys, day], "left_semi")


def latest_product(products: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key the row with the greatest ``order`` columns, and how many rows it beat."""
    rest = [c for c in products.columns if c not in keys]
    rank = F.struct(*[F.coalesce(F.col(c), F.lit(0)) for c in order], *[c for c in rest if c not in order])
    best = products.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), rank).alias("_best"), F.count("*").alias("n_products")
    )
    return best.select(*keys, "_best.*", "n_products")


def first_seen(df: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """Earliest sighting of each key, kept over later captures."""
    return df.groupBy(*keys).agg(F.min(stamp).alias("first_seen"), F.max(stamp).alias("last_seen"))


def previous_day(df: DataFrame, day: str, current: str) -> DataFrame:
    """Newest captured day before ``current`` (one row; NULL when there is none)."""
    return df.filter(F.col(day) < current).agg(F.max(day).alias(day))


def product_changes(
    products: DataFrame, keys: list[str], values: list[str], current: str, day: str = "snapshot_date"
) -> DataFrame:
    """Rows new or changed against the previous capture; silent without one."""
    now = products.filter(F.col(day) == current).select(*keys, *values)
    prior_day = previous_day(products, day, current)
    before = products.filter(F.col(day) == prior_day.scalar()).select(*keys, *[F.col(v).alias(f"old_{v}") for v in values])
    guarded = with_scalar(now, prior_day.select(F.col(day).alias("_prior"))).filter("_prior IS NOT NULL")
    marked = before.withColumn("_seen", F.lit(True))
    joined = null_safe_join(guarded, marked, keys, "left")
    changed = F.lit(False)
    for v in values:
        changed = changed | ~F.col(v).eqNullSafe(F.col(f"old_{v}"))
    kind = F.when(F.col("_seen").isNull(), "new").when(changed, "changed")
    return joined.withColumn("change", kind).filter("change IS NOT NULL").drop("_seen", "_prior")


def new_items(items: DataFrame, keys: list[str], current: str, day: str = "snapshot_date") -> DataFrame:
    """Items absent from the previous capture; none when nothing was captured before."""
    now = items.filter(F.col(day) == current)
    prior_day = previous_day(items, day, current)
    before = items.filter(F.col(day) == prior_day.scalar()).select(*keys).distinct()
    guarded = with_scalar(now, prior_day.select(F.col(day).alias("_prior"))).filter("_prior IS NOT NULL")
    return null_safe_join(guarded, before, keys, "left_anti").drop("_prior")


def current_package(points: DataFrame, products: DataFrame, group: str, package: str, order: list[str]) -> DataFrame:
    """Points of the package that the newest product of each group names."""
    named = products.filter(F.col(package).isNotNull())
    newest = named.groupBy(group).agg(F.max_by(package, F.struct(*order, package)).alias(package))
    return skew_join(points, newest, [group, package], "left_semi")


def referenced_packages(points: DataFrame, products: DataFrame, package: str) -> DataFrame:
    """Points of any package that a product refers to now."""
    named = products.filter(F.col(package).isNotNull()).select(package).distinct()
    return skew_join(points, named, [package], "left_semi")


def fill_from_oldest(rows: DataFrame, archive: DataFrame, key: str, day: str, columns: list[str]) -> DataFrame:
    """Empty outlet columns take the oldest archived value; filled ones stay."""
    oldest = archive.filter(F.col(columns[0]).isNotNull()).groupBy(key).agg(
        F.min_by(F.struct(*columns), F.struct(day, *columns)).alias("_old")
    )
    joined = rows.join(oldest, key, "left")
    empty = F.col(columns[0]).isNull()
    return (
        joined.withColumn("backfilled", empty & F.col("_old").isNotNull())
        .withColumns({c: F.when(empty, F.col("_old")[c]).otherwise(F.col(c)) for c in columns}).drop("_old")
    )


def row_fingerprint(columns: list[str]) -> Column:
    """Hash of the row as JSON with sorted keys, NULLs included."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def changed_pages(rows: DataFrame, key: str, columns: list[str], state: DataFrame, cap: int | None = None) -> DataFrame:
    """Rows whose fingerprint differs from the stored state ``(key, fingerprint)``."""
    marked = rows.withColumn("fingerprint", row_fingerprint(columns))
    old = state.select(key, F.col("fingerprint").alias("_old"))
    changed = marked.join(old, key, "left").filter(~F.col("fingerprint").eqNullSafe(F.col("_old"))).drop("_old")
    return changed.orderBy(key).limit(cap) if cap else changed


def vanished_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of an accumulating table that a rewrite would lose; must be empty."""
    return null_safe_join(old.select(*keys).distinct(), new.select(*keys).distinct(), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], replace: list[str] = (), fill: list[str] = (), keep: list[str] = (), order: str | None = None) -> DataFrame:
    """Merge by key with one policy per column.

    ``replace`` takes the last arrival whenever the key came in, ``fill`` keeps the stored
    value unless it is NULL and then takes the first arrival that has one, ``keep`` never
    leaves the first one.  ``order`` is the column of ``new`` that numbers arrivals; equal
    numbers (or none given) resolve by the values, so a re-run gives the same table.
    """
    columns = [*replace, *fill, *keep]
    stored, arrival = F.lit(None).cast(new.schema[order].dataType if order else "bigint"), F.col(order) if order else F.lit(0).cast("bigint")
    both = old.select(*keys, *columns, F.struct(F.lit(0).alias("new"), stored.alias("at")).alias("_turn")).unionByName(
        new.select(*keys, *columns, F.struct(F.lit(1).alias("new"), arrival.alias("at")).alias("_turn"))
    )
    tie = F.struct("_turn", *columns)
    aggregates = [F.max_by(c, tie).alias(c) for c in replace]
    aggregates += [F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), tie)).alias(c) for c in fill]
    aggregates += [F.min_by(c, tie).alias(c) for c in keep]
    return both.groupBy(*keys).agg(*aggregates)


def resync_history(dump: DataFrame, log: DataFrame, keys: list[str], replace: bool) -> DataFrame:
    """Dump rows replace stored rows, or are added only where their key is absent."""
    first, second = (dump, log) if replace else (log, dump)
    absent = null_safe_join(second, first.select(*keys).distinct(), keys, "left_anti")
    return first.unionByName(absent)


def known_ids(*sets: DataFrame) -> DataFrame:
    """Union of listed and already known identifiers."""
    out = sets[0]
    for other in sets[1:]:
        out = out.unionByName(other)
    return out.distinct()


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def carry_forward(
    previous: DataFrame, arrivals: DataFrame, key: str, search_source: str, today: str, still_valid: Column
) -> DataFrame:
    """Previous feed without today's search hits, still passing the gate, plus new keys."""
    todays = (F.col("source") == search_source) & (
        F.coalesce(F.col("search_date"), F.lit("")).isin("", today)
    )
    kept = previous.filter(~F.coalesce(todays, F.lit(False)) & still_valid)
    fresh = arrivals.join(kept.select(key).distinct(), key, "left_anti")
    return kept.unionByName(fresh)


def vanished_codes(before: DataFrame, after: DataFrame, code: str) -> DataFrame:
    """Codes of the first set that the second lacks."""
    return before.select(code).distinct().join(after.select(code).distinct(), code, "left_anti")
