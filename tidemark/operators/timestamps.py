"""Timestamps of mixed formats, precisions and zones as one instant each.

A text is turned into a character-class shape mask of the same length ('9' digit, 'M' month
name, 'D' weekday, 'P' am or pm, 'X' zone abbreviation, 'I' IANA zone, 'a' other letters).
A distinct mask is mapped to a parser once (the places of its fields); since all texts of a
mask have their fields in the same places, they are cut and converted as NumPy columns, and
local times become instants through versioned zone transition tables.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.zones import ZoneTables, database_version, zone_names
from tidemark.operators.skew import left_join_spread
from tidemark.session import bounded_rows

#: Month names, English and German, full and short.
MONTHS = (
    ("january", "januar", "jänner", "jan"),
    ("february", "februar", "feb"),
    ("march", "märz", "maerz", "mar", "mär", "mrz"),
    ("april", "apr"),
    ("may", "mai"),
    ("june", "juni", "jun"),
    ("july", "juli", "jul"),
    ("august", "aug"),
    ("september", "sept", "sep"),
    ("october", "oktober", "oct", "okt"),
    ("november", "nov"),
    ("december", "dezember", "dec", "dez"),
)
#: Weekday names, English and German, full and short.
WEEKDAYS = (
    "monday tuesday wednesday thursday friday saturday sunday mon tue tues wed thu thur thurs fri sat sun "
    "montag dienstag mittwoch donnerstag freitag samstag sonnabend sonntag mo di mi do fr sa so"
).split()
#: Years in which a bare count since 1970 is taken for a time.
COUNT_YEARS = (2024, 2027)
#: Zone abbreviations are a small dimension; more rows than this are refused.
MAX_ABBREVIATIONS = 10_000
#: Characters of a mask up to which its parsers are remembered (memory of a worker, not a bound of texts).
_REMEMBERED = 200

_MONTH_NO = {name: i + 1 for i, names in enumerate(MONTHS) for name in names}
_WORDS = {
    **{m: "M" for m in _MONTH_NO},
    **{d: "D" for d in WEEKDAYS},
    "am": "P",
    "pm": "P",
    "at": "C",
    "um": "C",
    "uhr": "U",
    "t": "T",
    "st": "o",
    "nd": "o",
    "rd": "o",
    "th": "o",
}
_TOKEN = re.compile(r"[A-Za-z_]+(?:/[A-Za-z0-9_+\-]+)+|(?<![^\W\d_])[AaPp]\.[Mm]\.|[^\W\d_]+|[0-9]+|\s")
_PART = re.compile(r"[^\W\d_]+|[0-9]+")

_TIME = r"(?P<H>99?):(?P<N>99)(?::(?P<S>99)(?:[.,](?P<F>9+))?)?(?![9:])(?: ?(?P<P>P+))?(?: U+)?"
_ZONE = (
    r"(?: ?(?P<X>X+))?(?: ?(?P<O>[+\-−]99?(?::?99)?)(?![9:]))?"
    r"(?: ?[\[(](?P<I>I+|X+)[\])]| (?P<J>I+))?(?: ?\([aDM ]+\))?"
)
_GAP = r"(?:, | |,? C+ |,? ?T+ ?)"
_NAMED = r"(?:D+\.?,? )?"
#: Parsers as patterns of masks; the letters name the fields.
_LAYOUTS = tuple(
    re.compile(p)
    for p in (
        rf"(?P<Y>9999)(?P<s>[\-/.])(?P<m>99?)(?P=s)(?P<d>99?){_GAP}{_TIME}{_ZONE}",
        rf"(?P<Y>9999)(?P<m>99)(?P<d>99)(?:T| )(?P<H>99)(?P<N>99)(?P<S>99)?(?:[.,](?P<F>9+))?(?![9:]){_ZONE}",
        rf"(?P<Y>9999)(?P<m>99)(?P<d>99)(?:T| ){_TIME}{_ZONE}",
        rf"(?P<a>99?)(?P<s>[\-/.])(?P<b>99?)(?P=s)(?P<y>9999|99){_GAP}{_TIME}{_ZONE}",
        rf"{_NAMED}(?P<d>99?)(?:\.|oo)?[ \-](?P<M>M+)\.?,?[ \-](?P<Y>9999){_GAP}{_TIME}{_ZONE}",
        rf"{_NAMED}(?P<M>M+)\.? +(?P<d>99?)(?:oo)?,? (?P<Y>9999){_GAP}{_TIME}{_ZONE}",
        rf"{_NAMED}(?P<M>M+)\.? +(?P<d>99?) {_TIME}(?: (?P<X>X+))?(?: ?(?P<O>[+\-−]99?:?99))? (?P<Y>9999)",
    )
)
_COUNT = re.compile(r"(?P<whole>9{10}|9{13}|9{16})(?:\.(?P<part>9+))?")
_RUN = re.compile(r"[9MDPXITCo][9MDPXITCUo ,.:/+\-−()\[\]]*")


class Plan(NamedTuple):
    """Places of the fields of a mask: start and end by field name."""

    start: int
    end: int
    fields: dict[str, tuple[int, int]]


def shape_mask(text: str, abbreviations: frozenset[str]) -> str:
    """Mask of a text, character by character."""

    def letters(word: str) -> str:
        if word[0].isdigit():
            return "9" * len(word)
        if word in abbreviations or word in ("Z", "z"):
            return "X" * len(word)
        kind = _WORDS.get(word.lower(), "a")
        return kind * len(word)

    def one(m: re.Match) -> str:
        word = m.group()
        if word.isspace():
            return " "
        if "/" in word:
            if word in zone_names():
                return "I" * len(word)
            return _PART.sub(lambda p: letters(p.group()), word)
        if "." in word:
            return "P" * len(word)
        return letters(word)

    return _TOKEN.sub(one, text)


def plans_of(mask: str, whole: bool) -> tuple[Plan, ...]:
    """Parsers of a mask: of all of it, or in a text all places where one begins, in order.

    Masks of any length have parsers; only those of usual length are remembered.
    """
    return _known_plans(mask, whole) if len(mask) <= _REMEMBERED else _plans(mask, whole)


@lru_cache(maxsize=30_000)
def _known_plans(mask: str, whole: bool) -> tuple[Plan, ...]:
    return _plans(mask, whole)


def _plans(mask: str, whole: bool) -> tuple[Plan, ...]:
    found: list[Plan] = []
    if whole:
        for layout in (*_LAYOUTS, _COUNT):
            if m := layout.fullmatch(mask):
                found.append(_plan(m))
                break
        return tuple(found)
    at = 0
    while at < len(mask):
        best = None
        for layout in _LAYOUTS:
            for m in layout.finditer(mask, at):
                before = mask[m.start() - 1] if m.start() else " "
                if before not in "9.-/:" and not (before.isalpha() and mask[m.start()] != "9"):
                    if best is None or m.start() < best.start():
                        best = m
                    break
        if best is None:
            break
        found.append(_plan(best))
        at = best.start() + 1
    return tuple(found)


def _plan(m: re.Match) -> Plan:
    return Plan(m.start(), m.end(), {k: m.span(k) for k, v in m.groupdict().items() if v is not None})


def _days(year: np.ndarray, month: np.ndarray, day: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 of a Gregorian date, and whether the date exists."""
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    lengths = np.array([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])
    ok = (month >= 1) & (month <= 12) & (year >= 1)
    safe = np.where(ok, month, 1)
    ok &= (day >= 1) & (day <= lengths[safe - 1] + (leap & (safe == 2)))
    y = np.where(safe <= 2, year - 1, year)
    era, shifted = y // 400, (safe + 9) % 12
    of_era = y - era * 400
    days = era * 146_097 + of_era * 365 + of_era // 4 - of_era // 100 + (153 * shifted + 2) // 5 + day - 1 - 719_468
    return days, ok


class Converter:
    """Applies the plan of a mask to all its texts at once."""

    def __init__(self, abbreviations: dict[str, int], tables: ZoneTables) -> None:
        self.abbreviations = abbreviations | {"Z": 0, "z": 0}
        self.tables = tables

    def convert(self, texts: list[str], plan: Plan, zones: np.ndarray, orders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Microseconds since 1970 UTC and whether they are valid."""
        n = len(texts)
        codes = np.array(texts, dtype=str).view(np.uint32).reshape(n, -1).astype(np.int64) - 48
        fields = plan.fields

        def number(name: str, default: int = 0) -> np.ndarray:
            if name not in fields:
                return np.full(n, default, dtype=np.int64)
            lo, hi = fields[name]
            return codes[:, lo:hi] @ (10 ** np.arange(hi - lo - 1, -1, -1, dtype=np.int64))

        def part(name: str) -> list[str]:
            lo, hi = fields[name]
            return [t[lo:hi] for t in texts]

        def micros(name: str) -> np.ndarray:
            if name not in fields:
                return np.zeros(n, dtype=np.int64)
            lo, hi = fields[name]
            kept = min(hi - lo, 6)
            digits = codes[:, lo : lo + kept] @ (10 ** np.arange(kept - 1, -1, -1, dtype=np.int64))
            return digits * 10 ** (6 - kept)

        if "whole" in fields:
            lo, hi = fields["whole"]
            scale = {10: 1_000_000, 13: 1_000, 16: 1}[hi - lo]
            utc = number("whole") * scale
            if "part" in fields:
                utc = utc + micros("part") * scale // 1_000_000
            first, _ = _days(np.array([COUNT_YEARS[0]]), np.array([1]), np.array([1]))
            last, _ = _days(np.array([COUNT_YEARS[1] + 1]), np.array([1]), np.array([1]))
            return utc, (utc >= first[0] * 86_400_000_000) & (utc < last[0] * 86_400_000_000)

        ok = np.ones(n, dtype=bool)
        if "a" in fields:
            a, b = number("a"), number("b")
            known = (orders == "DMY") | (orders == "MDY")
            ok &= known
            day_first = orders == "DMY"
            day, month = np.where(day_first, a, b), np.where(day_first, b, a)
            lo, hi = fields["y"]
            year = number("y") + (2000 if hi - lo == 2 else 0)
        else:
            year, day = number("Y"), number("d")
            month = (
                np.array([_MONTH_NO[x.lower()] for x in part("M")], dtype=np.int64) if "M" in fields else number("m")
            )
        days, exists = _days(year, month, day)
        hour, minute, second = number("H"), number("N"), number("S")
        if "P" in fields:
            pm = np.array([x[0] in "pP" for x in part("P")])
            ok &= (hour >= 1) & (hour <= 12)
            hour = hour % 12 + 12 * pm
        ok &= exists & (hour <= 23) & (minute <= 59) & (second <= 59)
        local = ((days * 24 + hour) * 60 + minute) * 60 + second
        local = local * 1_000_000 + micros("F")

        if "O" in fields:
            text = [x.replace(":", "") for x in part("O")]
            hours = np.array([int(x[1:3]) if len(x) > 3 else int(x[1:]) for x in text], dtype=np.int64)
            if fields["O"][1] - fields["O"][0] > 3:
                width = len(text[0]) - 1
                hours = np.array([int(x[1 : width - 1]) for x in text], dtype=np.int64)
                minutes = np.array([int(x[width - 1 :]) for x in text], dtype=np.int64)
            else:
                minutes = np.zeros(n, dtype=np.int64)
            sign = np.array([-1 if x[0] in "-−" else 1 for x in text], dtype=np.int64)
            ok &= (minutes <= 59) & (hours <= 18)
            return local - sign * (hours * 60 + minutes) * 60_000_000, ok
        if "X" in fields:
            offset = np.array([self.abbreviations[x] for x in part("X")], dtype=np.int64)
            return local - offset * 60_000_000, ok
        named = part("I") if "I" in fields else part("J") if "J" in fields else zones
        utc = np.zeros(n, dtype=np.int64)
        named = np.array([x or "" for x in named], dtype=object)
        for zone in set(named):
            mine = named == zone
            if zone in self.abbreviations:
                utc[mine] = local[mine] - self.abbreviations[zone] * 60_000_000
            elif zone in zone_names():
                utc[mine] = self.tables.to_utc(local[mine], zone)
            else:
                ok &= ~mine
        return utc, ok

    def instants(self, texts: pd.Series, whole: pd.Series, zones: pd.Series, orders: pd.Series) -> pd.Series:
        """First valid instant of each text, null where there is none."""
        known = frozenset(self.abbreviations)
        result: list[int | None] = [None] * len(texts)
        zone_of, order_of = zones.to_numpy(dtype=object), orders.to_numpy(dtype=object)
        groups: dict[tuple[str, bool], list[tuple[int, str]]] = defaultdict(list)
        later: dict[int, list[tuple[str, str]]] = {}
        for i, (text, all_of_it) in enumerate(zip(texts, whole, strict=True)):
            if not text:
                continue
            if all_of_it:
                text = text.strip()
                if text:
                    groups[shape_mask(text, known), True].append((i, text))
                continue
            mask = shape_mask(text, known)
            runs = [
                (mask[m.start() : m.end()], text[m.start() : m.end()])
                for m in _RUN.finditer(mask)
                if m.end() - m.start() >= 11 and "9" in m.group()
            ]
            runs = [(a, b) for a, b in runs if plans_of(a, False)]
            if runs:
                later[i] = runs[::-1]
                a, b = later[i].pop()
                groups[a, False].append((i, b))
        while groups:
            again: dict[tuple[str, bool], list[tuple[int, str]]] = defaultdict(list)
            for (mask, all_of_it), members in groups.items():
                open_ = members
                for plan in plans_of(mask, all_of_it):
                    if not open_:
                        break
                    rows = np.array([i for i, _ in open_])
                    utc, ok = self.convert([t for _, t in open_], plan, zone_of[rows], order_of[rows])
                    for i, u, good in zip(rows.tolist(), utc.tolist(), ok.tolist(), strict=True):
                        if good:
                            result[i] = u
                    open_ = [m for m, good in zip(open_, ok, strict=True) if not good]
                for i, _ in open_:
                    if later.get(i):
                        a, b = later[i].pop()
                        again[a, False].append((i, b))
            groups = again
        return pd.Series(result, index=texts.index, dtype="Int64")


def normalise(df: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """Add ``utc_micros`` to rows (text, whole, tz_name, date_order, ...).

    ``whole``: the text must be one time; else the first time that is named in it counts.
    Null, blank and unreadable texts get null. A local time without a known zone and an
    all-numeric date without a known order get null.
    """
    known = {
        r["abbrev"]: r["offset_minutes"]
        for r in bounded_rows(abbreviations.select("abbrev", "offset_minutes"), MAX_ABBREVIATIONS, "zone_abbrevs")
        if r["abbrev"] is not None and r["offset_minutes"] is not None
    }
    version = database_version()

    def batch(texts: pd.Series, whole: pd.Series, zones: pd.Series, orders: pd.Series) -> pd.Series:
        return Converter(known, ZoneTables(version)).instants(texts, whole, zones, orders)

    udf = F.pandas_udf(batch, T.LongType())
    return df.withColumn("utc_micros", udf("text", "whole", "tz_name", "date_order"))


def instants(
    history: DataFrame, sections: DataFrame, targets: DataFrame, sites: DataFrame, abbreviations: DataFrame
) -> DataFrame:
    """Instants of both tables as distinct rows (rec_kind, rec_id, utc_micros).

    Rows without an id, a text or a time in it have none. Repeated rows count once.
    """
    places = sites.select("host", "tz_name", "date_order")
    of_target = (
        targets.filter(F.col("target_identity").isNotNull())
        .select("target_identity", "host")
        .join(places, "host")
        .select("target_identity", "tz_name", "date_order")
    )
    digit = F.col("text").rlike("[0-9]")
    dated = history.select(F.col("entry_id").alias("rec_id"), "target_identity", F.col("checked_at").alias("text")).filter(
        digit & F.col("entry_id").isNotNull()
    )
    # The conversion runs where the join leaves the rows, so a hot target is split before it.
    checks = (
        left_join_spread(dated, of_target, "target_identity", "rec_id")
        .select(F.lit("history").alias("rec_kind"), "rec_id", "text", F.lit(True).alias("whole"), "tz_name", "date_order")
    )
    named = (
        sections.select(F.col("section_id").alias("rec_id"), "host", "text")
        .filter(digit)
        .join(places, "host", "left")
        .select(F.lit("section").alias("rec_kind"), "rec_id", "text", F.lit(False).alias("whole"), "tz_name", "date_order")
    )
    return (
        normalise(checks.unionByName(named), abbreviations)
        .filter(F.col("utc_micros").isNotNull() & F.col("rec_id").isNotNull())
        .select("rec_kind", "rec_id", "utc_micros")
        .distinct()
    )
