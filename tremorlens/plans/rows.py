"""Arrays to rows without computing the array twice.

A plain ``explode`` makes the optimizer add a "not empty" filter below it, and that
filter evaluates the array expression (a JSON parse, a scan of a text) once more.  The
outer form carries no such filter; the placeholder row of an empty array is dropped
right after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, keep: list, array: Column, name: str) -> DataFrame:
    """One row per non-NULL element."""
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def unnest_at(df: DataFrame, keep: list, array: Column, position: str, name: str) -> DataFrame:
    """One row per non-NULL element with its position."""
    return df.select(*keep, F.posexplode_outer(array).alias(position, name)).filter(F.col(name).isNotNull())


def unnest_map(df: DataFrame, keep: list, entries: Column, key: str, value: str) -> DataFrame:
    """One row per map entry."""
    return df.select(*keep, F.explode_outer(entries).alias(key, value)).filter(F.col(key).isNotNull())
