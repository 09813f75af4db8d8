"""Versioned zone transition tables, and conversion of local times by binary search.

A table holds, for each zone, the UTC seconds at which its offset changes and the offsets
between them, read once from the installed public time-zone database, whose version it names.
Local times outside the years of the table are converted one by one by the database itself.
"""

from __future__ import annotations

import datetime as dt
import pathlib
from dataclasses import dataclass, field
from zoneinfo import TZPATH, ZoneInfo, available_timezones

import numpy as np

_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def database_version() -> str:
    """Release of the time-zone database, ``unknown`` where the installation does not say."""
    for root in TZPATH:
        for name, mark in (("tzdata.zi", "# version "), ("+VERSION", "")):
            p = pathlib.Path(root, name)
            if p.exists():
                return p.open().readline().removeprefix(mark).strip()
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


def _offset(zone: ZoneInfo, second: int) -> int:
    at = (_EPOCH + dt.timedelta(seconds=second)).astimezone(zone)
    return int(at.utcoffset().total_seconds())


def transitions(name: str, first_year: int, last_year: int) -> tuple[np.ndarray, np.ndarray]:
    """(UTC seconds of each change, offsets before the first, between and after)."""
    zone, step = ZoneInfo(name), 7 * 86400
    start = int(dt.datetime(first_year, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    stop = int(dt.datetime(last_year + 1, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    at, offsets = [], [_offset(zone, start)]
    for lo in range(start, stop, step):
        if _offset(zone, lo + step) != offsets[-1]:
            a, b = lo, lo + step
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (mid, b) if _offset(zone, mid) == offsets[-1] else (a, mid)
            at.append(b)
            offsets.append(_offset(zone, b))
    return np.array(at, dtype=np.int64), np.array(offsets, dtype=np.int64)


@dataclass
class ZoneTable:
    """Transitions of some zones; at most all zones of the database, so small enough to broadcast."""

    version: str
    zones: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    years: tuple[int, int] = (1970, 2099)

    @classmethod
    def build(cls, names: list[str], first_year: int = 1970, last_year: int = 2099) -> ZoneTable:
        known = available_timezones()
        return cls(database_version(), {n: transitions(n, first_year, last_year) for n in names if n in known}, (first_year, last_year))

    def to_utc(self, name: str, local_us: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTC microseconds, whether exactly one instant has this local time)."""
        at, offsets = self.zones[name]
        at, offsets = at * 1_000_000, offsets * 1_000_000
        k = np.searchsorted(at, local_us)
        hits, out = np.zeros(len(local_us), dtype=np.int64), np.zeros(len(local_us), dtype=np.int64)
        lo = np.concatenate([[np.iinfo(np.int64).min], at])
        hi = np.concatenate([at, [np.iinfo(np.int64).max]])
        for d in (-1, 0, 1):
            j = k + d
            ok = (j >= 0) & (j < len(offsets))
            j = np.clip(j, 0, len(offsets) - 1)
            u = local_us - offsets[j]
            ok &= (lo[j] <= u) & (u < hi[j])
            out = np.where(ok, u, out)
            hits += ok
        once = hits == 1
        first, end = (int((dt.datetime(y, 1, 1, tzinfo=dt.timezone.utc) - _EPOCH).total_seconds()) for y in (self.years[0], self.years[1] + 1))
        margin = 2 * 86400  # of a local time against UTC
        for i in np.flatnonzero((local_us < (first + margin) * 1_000_000) | (local_us >= (end - margin) * 1_000_000)):
            out[i], once[i] = _converted(name, int(local_us[i]))
        return out, once


def _converted(name: str, local_us: int) -> tuple[int, bool]:
    """As ``ZoneTable.to_utc``, of one local time in any year that a date can have."""
    try:
        at = (_EPOCH + dt.timedelta(microseconds=local_us)).replace(tzinfo=ZoneInfo(name))
    except OverflowError:
        return 0, False
    early, late = (at.replace(fold=f).utcoffset() // dt.timedelta(microseconds=1) for f in (0, 1))
    return local_us - early, early == late  # they differ where the zone skipped or repeats a time
