"""Joins whose strategy follows the measured size of the small side.

``skew_join`` is for dimensions: counting them first is cheap.  ``derived_join`` is for
a side computed from the big one: counting it would compute it twice, so its size and
any hot key are settled by adaptive execution from the shuffle it needs anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A side is broadcast only when it is proven to hold at most so many rows and characters (as JSON).
BROADCAST_ROWS, BROADCAST_CHARS = 100_000, 32 << 20
SALTS = 16


def at_most(df: DataFrame, rows: int) -> bool:
    """True when the frame provably has no more than ``rows`` rows."""
    return df.limit(rows + 1).count() <= rows


def fits_broadcast(df: DataFrame, rows: int) -> bool:
    """True when rows and their size are both proven to be within the bounds."""
    size = df.limit(rows + 1).select(F.length(F.to_json(F.struct("*"))).alias("n")).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return size[0] <= rows and size[1] <= BROADCAST_CHARS


def skew_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    spread: Column | None = None,
    rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join that tolerates a key holding a large share of ``big``.

    Small enough: broadcast hash join, ``big`` is not shuffled at all.  Beyond the
    bound: rows of ``big`` are spread over ``salts`` buckets per key and ``small``
    (which must not itself repeat a hot key) is replicated once per bucket.  Both are
    merged: by its size as a file the small side may look fit to broadcast when its
    copies are not.
    ``how`` must preserve ``big`` only: inner, left, left_semi or left_anti.
    NULL keys of ``big`` spread over the buckets like any other key.
    """
    if fits_broadcast(small, rows):
        return big.join(F.broadcast(small), on, how)
    bucket = F.pmod(F.xxhash64(*([spread] if spread is not None else big.columns)), F.lit(salts))
    left = big.withColumn("_bucket", bucket.cast("int"))
    right = small.withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge"), [*on, "_bucket"], how).drop("_bucket")


def derived_join(big: DataFrame, derived: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join with a side aggregated from ``big`` (one row per key).

    Adaptive execution broadcasts it when the written shuffle proves small and splits
    the partitions of ``big`` that a hot (or NULL) key makes too large.
    """
    return big.join(derived, on, how)


def with_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a global aggregate to every row, as a scalar subquery.

    The aggregate runs once and its value is inlined, so nothing is joined.  All columns
    are NULL when ``one_row`` is empty.
    """
    packed = one_row.select(F.struct(*one_row.columns).alias("_s")).scalar()
    return df.withColumn("_s", packed).select(*df.columns, *[F.col("_s")[c].alias(c) for c in one_row.columns])


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join in which NULL equals NULL; the keys of ``left`` remain."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(other, condition, how).drop(*[f"_right_{k}" for k in keys])
