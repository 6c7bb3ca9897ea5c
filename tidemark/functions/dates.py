"""Date functions over text and UTC instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import B, E

MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
ISO = rf"{B}([0-9]{{4}})-([0-9]{{2}})-([0-9]{{2}}){E}"
MONTH_FIRST = rf"(?i){B}({MONTHS})\s+([0-9]{{1,2}}),?\s+([0-9]{{4}}){E}"
DAY_FIRST = rf"(?i){B}([0-9]{{1,2}})\s+({MONTHS})\s+([0-9]{{4}}){E}"
ANY = (
    rf"(?i)({B}[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}{E}|{B}(?:{MONTHS})\s+[0-9]{{1,2}},?\s+[0-9]{{4}}{E}"
    rf"|{B}[0-9]{{1,2}}\s+(?:{MONTHS})\s+[0-9]{{4}}{E})"
)


def _ymd(year: Column, month: Column, day: Column) -> Column:
    """ISO date of three texts; null if the day doesn't exist."""
    text = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd")


def _month_no(name: Column) -> Column:
    names = F.array(*[F.lit(m.lower()) for m in MONTHS.split("|")])
    return F.array_position(names, F.lower(name)).cast("string")


def normalise(col: Column) -> Column:
    """ISO date of a text that names one in ISO or English; else the trimmed text."""
    text = F.trim(col)
    iso = F.when(text.rlike(ISO), _ymd(*[F.regexp_extract(text, ISO, k) for k in (1, 2, 3)]))
    month = F.when(
        text.rlike(MONTH_FIRST),
        _ymd(
            F.regexp_extract(text, MONTH_FIRST, 3),
            _month_no(F.regexp_extract(text, MONTH_FIRST, 1)),
            F.regexp_extract(text, MONTH_FIRST, 2),
        ),
    )
    day = F.when(
        ~text.rlike(MONTH_FIRST) & text.rlike(DAY_FIRST),
        _ymd(
            F.regexp_extract(text, DAY_FIRST, 3),
            _month_no(F.regexp_extract(text, DAY_FIRST, 2)),
            F.regexp_extract(text, DAY_FIRST, 1),
        ),
    )
    return F.coalesce(iso, month, day, text)


def extract(col: Column) -> Column:
    """Leftmost date in a text, normalised; null if there is none."""
    found = F.nullif(F.regexp_extract(col, ANY, 1), F.lit(""))
    return F.when(found.isNotNull(), normalise(found))


def iso_millis(instant: Column) -> Column:
    """ISO text of an instant in UTC with milliseconds."""
    return F.date_format(F.date_trunc("millisecond", instant), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def is_iso_millis(col: Column) -> Column:
    """Whether a text is exactly what :func:`iso_millis` writes."""
    return F.coalesce(
        col.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}Z$")
        & (iso_millis(F.try_to_timestamp(col)) == col),
        F.lit(False),
    )


def local(instant: Column, zone: str) -> Column:
    return F.from_utc_timestamp(instant, zone)


def week_start(instant: Column, zone: str) -> Column:
    """Monday of the calendar week in a zone; fixed windows would be wrong across clock changes."""
    return F.to_date(F.date_trunc("week", local(instant, zone)))


def week_day(instant: Column, zone: str) -> Column:
    """ISO weekday in a zone, 1 for Monday."""
    return F.weekday(local(instant, zone)) + 1
