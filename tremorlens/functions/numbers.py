"""Null-preserving number parsing and rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Literals that declare absence.
MISSING_LITERALS = ["", "NA", "-", "None", "null"]
_DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def parse_number(text: Column) -> Column:
    """Text to double; absence stays NULL and a measured 0 stays 0."""
    clean = F.trim(text)
    digits = F.regexp_replace(clean, ",", "")
    return F.when(
        ~clean.isin(MISSING_LITERALS) & digits.rlike(_DECIMAL), digits.try_cast("double")
    )


def parse_count(text: Column) -> Column:
    """Integer with ``.`` and ``,`` taken as thousands marks."""
    digits = F.trim(F.regexp_replace(text, "[.,]", ""))
    return F.when(digits.rlike(r"^[+-]?\d+$"), digits.try_cast("bigint"))


def parse_decimal_comma(text: Column) -> Column:
    """Double written with a decimal comma."""
    dotted = F.trim(F.regexp_replace(text, ",", "."))
    return F.when(dotted.rlike(_DECIMAL), dotted.try_cast("double"))


def pad_code(code: Column, width: int = 5) -> Column:
    """Numeric codes regain their leading zeros, others stay as given."""
    clean = F.trim(F.coalesce(code.cast("string"), F.lit("")))
    short = clean.rlike(r"^\d+$") & (F.length(clean) < width)
    return F.when(short, F.lpad(clean, width, "0")).otherwise(clean)


def rate_pct(part: Column, whole: Column, digits: int = 4) -> Column:
    """Percentage, NULL when either side is missing or zero."""
    return F.when((part != 0) & (whole != 0), F.round(part / whole * 100, digits))
