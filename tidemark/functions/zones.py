"""Versioned zone transition tables: offsets of IANA zones as sorted arrays.

A table is built from the time zone database once per process and zone. Its version is that of
the database; :class:`ZoneTables` is given the driver's version and refuses to work with
another one, so that all executors convert alike.
"""

from __future__ import annotations

import zoneinfo
from datetime import UTC, datetime, timedelta
from functools import lru_cache
from pathlib import Path

import numpy as np

_DAY = 86_400
_FIRST, _LAST = 1970, 2060


@lru_cache(maxsize=1)
def database_version() -> str:
    """Version of the installed time zone database, or 'unknown'."""
    for folder in zoneinfo.TZPATH:
        for name in ("tzdata.zi", "+VERSION", "version"):
            path = Path(folder) / name
            if path.is_file():
                with path.open(errors="replace") as f:
                    return f.readline().strip().removeprefix("# version ").strip()
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


@lru_cache(maxsize=1)
def zone_names() -> frozenset[str]:
    return frozenset(zoneinfo.available_timezones())


@lru_cache(maxsize=2048)
def _transitions(name: str) -> tuple[np.ndarray, np.ndarray]:
    """Local seconds from which the next offset holds, and the offsets in seconds."""
    zone = zoneinfo.ZoneInfo(name)
    epoch = datetime(1970, 1, 1, tzinfo=UTC)

    def offset(second: int) -> int:
        return int((epoch + timedelta(seconds=second)).astimezone(zone).utcoffset().total_seconds())

    at = 0
    end = int((datetime(_LAST, 1, 1, tzinfo=UTC) - epoch).total_seconds())
    bounds, offsets = [], [offset(at)]
    while at < end:
        step = min(at + 7 * _DAY, end)
        if offset(step) != offsets[-1]:
            lo, hi = at, step
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if offset(mid) == offsets[-1] else (lo, mid)
            after = offset(hi)
            # A local time that occurs twice is the earlier instant and a skipped one keeps the
            # offset before the skip: either way the old offset holds up to the larger local time.
            bounds.append(hi + max(offsets[-1], after))
            offsets.append(after)
            at = hi
        else:
            at = step
    return np.array(bounds, dtype=np.int64), np.array(offsets, dtype=np.int64)


class ZoneTables:
    """Converts local times by the tables of one database version."""

    def __init__(self, version: str) -> None:
        self.version = version
        if version != database_version():
            raise RuntimeError(f"zone tables are of {database_version()}, the driver's of {version}")

    def to_utc(self, local: np.ndarray, zone: str) -> np.ndarray:
        """Local microseconds to microseconds since 1970 UTC."""
        bounds, offsets = _transitions(zone)
        index = np.searchsorted(bounds, local // 1_000_000, side="right")
        return local - offsets[index] * 1_000_000
