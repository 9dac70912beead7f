"""Date normalisation and the closed local day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names as they appear in mail-style dates and in Spanish prose.
MONTHS_EN = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTHS_ES = [
    "enero", "febrero", "marzo", "abril", "mayo", "junio", "julio",
    "agosto", "septiembre", "octubre", "noviembre", "diciembre",
]
_MAIL_DATE = (
    r"^\s*(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4})"
    r"\s+(\d{1,2}):(\d{2})(?::(\d{2}))?"
)


def _pad2(text: Column) -> Column:
    return F.lpad(text, 2, "0")


def iso_day(year: Column, month: Column, day: Column) -> Column:
    """``yyyy-MM-dd`` text from its three parts."""
    return F.concat_ws("-", year, _pad2(month), _pad2(day))


def month_number(name: Column, names: list[str]) -> Column:
    """Two-digit month of a lower-case name, NULL when unknown."""
    position = F.array_position(F.array(*[F.lit(n) for n in names]), name)
    return F.when(position > 0, _pad2(position.cast("string")))


def feed_stamp(text: Column) -> Column:
    """P10: mail-style date to ISO text in its own clock; else first 19 characters."""
    part = [F.regexp_extract(text, _MAIL_DATE, i) for i in range(1, 7)]
    month = month_number(F.lower(part[1]), MONTHS_EN)
    clock = F.concat_ws(
        ":", _pad2(part[3]), part[4], F.when(part[5] == "", "00").otherwise(part[5])
    )
    mail = F.concat(iso_day(part[2], month, part[0]), F.lit("T"), clock)
    matched = text.rlike(_MAIL_DATE) & month.isNotNull()
    return F.when(text.isNull(), "").when(matched, mail).otherwise(F.substring(text, 1, 19))


def slash_day(text: Column) -> Column:
    """P10: ``dd/mm/yyyy`` to ``yyyy-mm-dd`` text; anything else is NULL."""
    parts = F.split(text, "/")
    return F.when(F.size(parts) == 3, F.concat_ws("-", parts[2], parts[1], parts[0]))


def run_day(text: Column) -> Column:
    """P10: ISO, ``d-m-y`` or ``d/m/y`` day to ISO text."""
    clean = F.trim(text)
    dmy = r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})$"
    return F.when(clean.rlike(r"^\d{4}-\d{2}-\d{2}$"), clean).when(
        clean.rlike(dmy),
        iso_day(*[F.regexp_extract(clean, dmy, i) for i in (3, 2, 1)]),
    )


def epoch_ms_day(millis: Column) -> Column:
    """P10: epoch milliseconds to the UTC day."""
    return F.to_date(F.timestamp_millis(millis.cast("bigint")))


def compact_day(text: Column) -> Column:
    """``yyyymmdd...`` to ISO text, NULL when fewer than eight digits lead."""
    digits = F.substring(text, 1, 8)
    return F.when(
        F.length(digits) == 8,
        F.concat_ws("-", digits.substr(1, 4), digits.substr(5, 2), digits.substr(7, 2)),
    )


def imagery_stamp(text: Column) -> Column:
    """``yyyymmdd`` or ``yyyy/mm/dd [hh:mm [UTC]]`` to one written form."""
    shape = r"^(\d{4})[/-]?(\d{2})[/-]?(\d{2})(?:[ T](\d{2}:\d{2}))?\s*(UTC)?"
    part = [F.regexp_extract(text, shape, i) for i in range(1, 6)]
    day = F.concat_ws("-", part[0], part[1], part[2])
    clock = F.when(part[3] == "", "").otherwise(
        F.concat(F.lit(" "), part[3], F.when(part[4] == "", "").otherwise(" UTC"))
    )
    return F.when(text.rlike(shape), F.concat(day, clock)).otherwise(F.nullif(text, F.lit("")))


def closed_local_day(stamp: Column, zone: str = "America/Bogota", cut_hour: int = 6) -> Column:
    """Local day that an instant (UTC, no zone) still closes before the cut."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), stamp.cast("timestamp_ntz"))
    return F.to_date(local - F.expr(f"INTERVAL {int(cut_hour)} HOURS"))


def before_event(day: Column, event_day: str) -> Column:
    """Provably earlier than the event; an undated row never is."""
    text = F.substring(day.cast("string"), 1, 10)
    return F.coalesce((text != "") & (text < event_day), F.lit(False))
