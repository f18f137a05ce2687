"""Zone-offset intervals: for each region, the periods in which one offset from UTC holds, in local wall time.

The intervals are those of the public zone database's files, to the second: the changes that a file lists, and after them those of the rule
in its last line, which repeats for ever. The table's size is fixed by the database (about 600 names, some 400 different histories),
not by the data, so it may be broadcast.
"""

from __future__ import annotations

import importlib.resources
import re
import struct
from datetime import date, timedelta
from functools import lru_cache
from pathlib import Path
from zoneinfo import TZPATH, available_timezones

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Local years of the table. No file lists a change before the first or after ``RULES``; later years are read at a year of the same
#: length and first weekday among the last 28, where the rules give the same days.
FIRST_YEAR, RULES, LAST_YEAR = 1830, 2100, 2128
#: Years in a period to which intervals are exploded.
PERIOD = 4
_DAY = 86400

#: Everyday names of regions that the zone database doesn't list, in the form of :func:`zone_key`.
ALIASES = {
    "et": "America/New_York", "ct": "America/Chicago", "mt": "America/Denver", "pt": "America/Los_Angeles", "akt": "America/Anchorage", "ht": "Pacific/Honolulu",
    "eastern": "America/New_York", "central": "America/Chicago", "mountain": "America/Denver", "pacific": "America/Los_Angeles",
    "eastern time": "America/New_York", "central time": "America/Chicago", "mountain time": "America/Denver", "pacific time": "America/Los_Angeles",
    "us eastern": "America/New_York", "us central": "America/Chicago", "us mountain": "America/Denver", "us pacific": "America/Los_Angeles",
    "eastern standard time": "America/New_York", "central standard time": "America/Chicago", "mountain standard time": "America/Denver", "pacific standard time": "America/Los_Angeles",
    "gmt standard time": "Europe/London", "w. europe standard time": "Europe/Berlin", "romance standard time": "Europe/Paris", "tokyo standard time": "Asia/Tokyo",
    "aus eastern standard time": "Australia/Sydney", "china standard time": "Asia/Shanghai", "india standard time": "Asia/Kolkata",
    "uk": "Europe/London", "germany": "Europe/Berlin", "australia": "Australia/Sydney", "london": "Europe/London", "new york": "America/New_York", "z": "UTC", "utc": "UTC", "gmt": "UTC",
}


def zone_key(name: str) -> str:
    """Lower case, with underscores and runs of space as one space: the spelling by which zone names are joined."""
    return " ".join(name.lower().replace("_", " ").split())


def _file(name: str) -> bytes:
    for root in TZPATH:
        if (path := Path(root) / name).is_file():
            return path.read_bytes()
    return importlib.resources.files("tzdata").joinpath("zoneinfo", *name.split("/")).read_bytes()


def _listed(data: bytes) -> tuple[list[tuple[int, int]], int, str]:
    """(instant, offset from then on) of the changes that a zone file lists, the offset before the first, and the rule after the last."""

    def block(at: int) -> tuple[int, tuple[int, ...]]:
        n = struct.unpack(">6l", data[at + 20 : at + 44])  # counts of marks, marks, leap seconds, changes, types, letters
        return at + 44, n

    at, (_, _, leaps, times, types, letters) = block(0)
    size, rule = 4, ""
    if data[4:5] >= b"2":
        at, (utc, std, leaps, times, types, letters) = block(at + 5 * times + 6 * types + letters + 8 * leaps + block(0)[1][0] + block(0)[1][1])
        size = 8
        rule = data[at + 9 * times + 6 * types + letters + 12 * leaps + utc + std :].strip(b"\n").decode()
    when = struct.unpack(f">{times}{'q' if size == 8 else 'l'}", data[at : at + size * times])
    kind = data[at + size * times : at + (size + 1) * times]
    offsets = [struct.unpack(">l", data[at + (size + 1) * times + 6 * k :][:4])[0] for k in range(types)]
    changes = [(t, offsets[k]) for t, k in zip(when, kind)]
    return [c for c in changes if c[0] > -(2**40)], offsets[0] if not changes or changes[0][0] > -(2**40) else changes[0][1], rule


_RULE = re.compile(r"^(?:<[^>]+>|[A-Za-z]+)([-+]?[\d:]+)(?:(?:<[^>]+>|[A-Za-z]+)([-+]?[\d:]+)?,([^,]+),([^,]+))?$")


def _seconds(text: str) -> int:
    sign = -1 if text.startswith("-") else 1
    return sign * sum(int(x) * 60 ** (2 - k) for k, x in enumerate(text.lstrip("+-").split(":")))


def _ruled(when: str, year: int) -> int:
    """Local seconds since 1970 at which a rule's change comes in a year: ``Mm.w.d``, ``Jn`` or ``n``, and a time of day."""
    day, _, at = when.partition("/")
    first = date(year, 1, 1)
    if day[0] == "M":
        m, w, d = map(int, day[1:].split("."))
        start = date(year, m, 1)
        found = start + timedelta((d - start.isoweekday()) % 7 + 7 * (w - 1))
        while found.month != m:
            found -= timedelta(7)
    elif day[0] == "J":
        n = int(day[1:])
        found = first + timedelta(n - 1 + (n > 59 and (year % 4 == 0 and (year % 100 != 0 or year % 400 == 0))))
    else:
        found = first + timedelta(int(day))
    return (found - date(1970, 1, 1)).days * _DAY + (_seconds(at) if at else 7200)


@lru_cache(maxsize=None)
def _by_rule(rule: str) -> tuple[tuple[int, int], ...]:
    """(instant, offset from then on) by a rule, for the years up to ``LAST_YEAR``."""
    m = _RULE.match(rule)
    if not m:
        return ()
    usual = -_seconds(m[1])
    if not m[3]:
        return ((-(2**41), usual),)
    summer = -_seconds(m[2]) if m[2] else usual + 3600
    return tuple(sorted(x for y in range(1970, LAST_YEAR + 2) for x in ((_ruled(m[3], y) - usual, summer), (_ruled(m[4], y) - summer, usual))))


def changes(name: str) -> tuple[tuple[int, int], ...]:
    """(start in UTC seconds, offset seconds) of each period of a region."""
    listed, first, rule = _listed(_file(name))
    ends = listed[-1][0] if listed else -(2**40)
    out = [(-(2**40), first)]
    for t, offset in [*listed, *(c for c in _by_rule(rule) if c[0] > ends)]:
        if offset != out[-1][1]:
            out.append((t, offset))
    return tuple(out)


@lru_cache(maxsize=1)
def _tables() -> tuple[pa.Table, pa.Table]:
    ids: dict[tuple, int] = {}
    names: dict[str, int] = {}
    for name in sorted(available_timezones()):
        if name.startswith(("posix/", "right/")) or name in ("localtime", "Factory", "posixrules"):
            continue
        names.setdefault(zone_key(name), ids.setdefault(changes(name), len(ids)))
    for alias, name in ALIASES.items():
        if (key := zone_key(name)) in names:
            names.setdefault(alias, names[key])
    for name in sorted(names):  # the city alone, where nothing else has that name
        if "/" in name:
            names.setdefault(name.rpartition("/")[2], names[name])
    zone, start, offset = (np.array(x) for x in zip(*((z, t, o) for c, z in ids.items() for t, o in c)))
    last = np.append(zone[1:] != zone[:-1], True)
    end = np.where(last, 2**40, np.append(start[1:], 0))
    after = np.where(last, offset, np.append(offset[1:], 0))
    rows = pd.DataFrame({"zone_id": zone, "local_from": start + offset, "local_to": end + offset, "gap_to": end + np.maximum(offset, after), "offset_s": offset})
    # the periods that an interval touches
    edges = np.array([(date(y, 1, 1) - date(1970, 1, 1)).days * _DAY for y in range(FIRST_YEAR // PERIOD * PERIOD, LAST_YEAR + 2 * PERIOD, PERIOD)])
    a = np.clip(np.searchsorted(edges, rows["local_from"], side="right") - 1, 0, len(edges) - 2)
    b = np.clip(np.searchsorted(edges, rows["gap_to"], side="right") - 1, 0, len(edges) - 2)
    b[rows["gap_to"].to_numpy() < edges[0]] = a[rows["gap_to"].to_numpy() < edges[0]]
    n = b - a + 1
    rows = rows.loc[np.repeat(rows.index, n)].assign(period=np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + FIRST_YEAR // PERIOD)
    rows = rows.sort_values(["zone_id", "period", "local_from"], ignore_index=True)
    new = np.flatnonzero(rows[["zone_id", "period"]].ne(rows[["zone_id", "period"]].shift()).any(axis=1))
    spans = pa.StructArray.from_arrays([pa.array(rows[c].to_numpy("int32" if c == "offset_s" else "int64")) for c in ("local_from", "local_to", "gap_to", "offset_s")], ["local_from", "local_to", "gap_to", "offset_s"])
    spans = pa.ListArray.from_arrays(pa.array(np.append(new, len(rows)).astype("int32")), spans)
    keys = rows.iloc[new]
    known = sorted(names.items())
    return (
        pa.table({"zone_name": [k for k, _ in known], "zone_id": pa.array([v for _, v in known], pa.int32())}),
        pa.table({"zone_id": pa.array(keys["zone_id"].to_numpy("int32")), "period": pa.array(keys["period"].to_numpy("int32")), "spans": spans}),
    )


def _made(spark: SparkSession, k: int, schema: str) -> DataFrame:
    """A table of :func:`_tables`, made by one task: as rows within the plan it would be compared by every rule of the optimizer."""
    made = _tables()[k]
    return spark.range(0, 1, 1, 1).mapInArrow(lambda _: iter(made.to_batches()), schema)


def zone_names(spark: SparkSession) -> DataFrame:
    """zone_name (as :func:`zone_key`), zone_id: equal histories share an id."""
    return _made(spark, 0, "zone_name string, zone_id int")


def zone_periods(spark: SparkSession) -> DataFrame:
    """One row for each zone history and period of ``PERIOD`` local years with its offset intervals: spans array<local_from, local_to, gap_to, offset_s>.

    An interval holds in [local_from, local_to) of wall time; [local_to, gap_to) is the wall time skipped after it.
    Intervals are exploded to the periods they touch, so that a wall time finds its few candidates by equality.
    """
    return _made(spark, 1, "zone_id int, period int, spans array<struct<local_from: bigint, local_to: bigint, gap_to: bigint, offset_s: int>>")


def table_year(year: Column) -> Column:
    """The year at which a local year is looked up: itself, the first one for years before, a like one for years under rules alone."""
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    weekday = F.dayofweek(F.make_date(year, F.lit(1), F.lit(1)))
    like = {(y % 4 == 0, date(y, 1, 1).isoweekday() % 7 + 1): y for y in range(LAST_YEAR, RULES, -1)}
    pairs = F.create_map(*[F.lit(x) for (is_leap, day), y in sorted(like.items()) for x in (day + 10 * is_leap, y)])
    return F.when(year < FIRST_YEAR, FIRST_YEAR).when(year <= LAST_YEAR, year).otherwise(F.element_at(pairs, weekday + F.when(leap, 10).otherwise(0)))
