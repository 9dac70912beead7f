"""Tabular inputs and dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorlens.functions.numbers import parse_decimal_comma
from tremorlens.functions.text import fold

# Fixed values.
NULL_MARK = "\\N"
AREAS = {"Total": "population", "Cabecera Municipal": "urban", "Centros Poblados y Rural Disperso": "rural"}


def population(rows: DataFrame, year: int) -> DataFrame:
    """Area-by-year rows to one row per place.

    ``rows``: department, code, municipality, year, area, total.
    """
    keyed = rows.filter(F.col("year") == year).groupBy(
        F.concat_ws("|", F.trim(fold(F.col("municipality"))), F.trim(fold(F.col("department")))).alias("place_key"),
    )
    return keyed.agg(
        F.max("municipality").alias("municipality"), F.max("department").alias("department"), F.max("code").alias("code"),
        *[F.max(F.when(F.col("area") == area, F.col("total"))).alias(out) for area, out in AREAS.items()],
    )


def place_catalogue(rows: DataFrame) -> DataFrame:
    """Catalogue with decimal-comma coordinates, keyed ``name|department``.

    ``rows``: name, department, code, lat_text, lon_text.
    """
    named = rows.filter((F.coalesce("name", F.lit("")) != "") & (F.coalesce("department", F.lit("")) != ""))
    key = F.concat_ws("|", F.trim(fold(F.col("name"))), F.trim(fold(F.col("department"))))
    return named.select(
        key.alias("place_key"), "name", "department", "code", parse_decimal_comma(F.col("lat_text")).alias("lat"),
        parse_decimal_comma(F.col("lon_text")).alias("lon"),
    ).withColumn("no_coordinates", F.col("lat").isNull() | F.col("lon").isNull())


def read_dump(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """CSV dumps by column name; files older than a column read it as NULL.

    ``\\N`` is NULL and an empty field is an empty text, which Spark's own NULL option
    cannot tell apart, so both are settled here.
    """
    fields = T.StructType.fromDDL(schema).fields
    out = None
    for path in paths:
        raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, quote='"', escape='"', nullValue="\u0001")
        columns = []
        for f in fields:
            if f.name not in raw.columns:
                columns.append(F.lit(None).cast(f.dataType).alias(f.name))
                continue
            text = F.coalesce(F.col(f.name), F.lit(""))
            value = F.when(text != NULL_MARK, text)
            columns.append((value if isinstance(f.dataType, T.StringType) else value.try_cast(f.dataType)).alias(f.name))
        part = raw.select(*columns)
        out = part if out is None else out.unionByName(part)
    return out


def write_dump(df: DataFrame, path: str, keys: list[str], partitions: int | None = None) -> None:
    """Deterministic dump in key order, NULL as ``\\N``; files follow the key range."""
    order = [F.col(k).asc_nulls_first() for k in keys]
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    text = ranged.sortWithinPartitions(*order).select(
        *[F.coalesce(F.col(c).cast("string"), F.lit(NULL_MARK)).alias(c) for c in df.columns]
    )
    text.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")
