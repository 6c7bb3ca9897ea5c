"""Number functions. Rounding is half up, towards plus infinity in ties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(col: Column, places: int) -> Column:
    scale = float(10**places)
    return F.floor(col * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def decimal(col: Column) -> Column:
    """Number in a text with either decimal sign; null if there is none.

    With both signs the rightmost is the decimal one; a single kind is one only if one or two
    digits follow its last place, else it separates thousands. Digits of the whole text count.
    """
    negative = col.rlike(r"^\s*-") | col.rlike(r"^\s*\([\s\S]*\)\s*$")
    kept = F.regexp_replace(col, "[^0-9.,]", "")
    comma, dot = F.length(kept) - F.instr(F.reverse(kept), ","), F.length(kept) - F.instr(F.reverse(kept), ".")
    has_comma, has_dot = F.instr(kept, ",") > 0, F.instr(kept, ".") > 0
    both = F.when(
        comma > dot,
        # Only the first decimal sign turns into a point; a second one leaves no number.
        F.regexp_replace(F.regexp_replace(kept, r"\.", ""), "^([^,]*),", "$1."),
    ).otherwise(F.regexp_replace(kept, ",", ""))
    parts = F.split(kept, "[.,]")
    last = F.element_at(parts, -1)
    joined = F.array_join(F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 1)), "")
    single = F.when(
        (F.length(last) > 0) & (F.length(last) <= 2), F.concat(joined, F.lit("."), last)
    ).otherwise(F.array_join(parts, ""))
    text = F.when(has_comma & has_dot, both).when(has_comma | has_dot, single).otherwise(kept)
    value = F.when(text.rlike("^[0-9]*[.]?[0-9]*$") & text.rlike("[0-9]"), text.try_cast("double"))
    return F.when(negative, -value).otherwise(value)


def delta(previous: Column, current: Column) -> Column:
    """Difference to four places."""
    return half_up(current - previous, 4)


def percent(previous: Column, difference: Column) -> Column:
    """Share of the previous value to four places; null for a previous value of 0."""
    return half_up(F.try_divide(difference, previous) * F.lit(100.0), 4)


def number_text(col: Column) -> Column:
    """Shortest plain text of a number with at most four places."""
    return F.when(
        col == F.floor(col), F.floor(col).cast("bigint").cast("string")
    ).otherwise(F.regexp_replace(F.format_string("%.4f", col), "0+$", ""))


def backoff_ms(attempt: Column, first: int = 250, most: int = 2_000) -> Column:
    """Waiting time before a retry: doubles with each attempt up to ``most``."""
    return F.least(F.lit(most), F.lit(first) * F.pow(F.lit(2), attempt)).cast("int")


def clamp(col: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def transient_status(col: Column) -> Column:
    """Whether an HTTP status may be gone at the next try: 408, 429 and 500 or more; null of null."""
    return col.isin(408, 429) | (col >= 500)
