"""Text forms of dates, times and intervals: literals read on the driver, columns read and written in Spark."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import TypeMismatch

DAY = 86_400_000_000
EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
PART = {"year": ("months", 12), "mon": ("months", 1), "month": ("months", 1), "week": ("days", 7), "day": ("days", 1), "hour": ("micros", 3_600_000_000), "minute": ("micros", 60_000_000), "min": ("micros", 60_000_000), "second": ("micros", 1_000_000), "sec": ("micros", 1_000_000)}
ISO = re.compile(r"P(?:(-?\d+)Y)?(?:(-?\d+)M)?(?:(-?\d+)W)?(?:(-?\d+)D)?(?:T(?:(-?\d+)H)?(?:(-?\d+)M)?(?:(-?\d+(?:\.\d+)?)S)?)?$")


def date(text: str) -> dt.date:
    try:
        return dt.date.fromisoformat(text.strip())
    except ValueError:
        raise TypeMismatch(f"not a date: {text!r}") from None


def timestamp(text: str) -> dt.datetime:
    """A point in time; without an offset it is UTC."""
    try:
        out = dt.datetime.fromisoformat(text.strip().replace(" ", "T", 1))
    except ValueError:
        raise TypeMismatch(f"not a timestamp: {text!r}") from None
    return out.replace(tzinfo=dt.timezone.utc) if out.tzinfo is None else out.astimezone(dt.timezone.utc)


def micros_of(at: dt.datetime) -> int:
    d = at - EPOCH
    return (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds


def time(text: str) -> int:
    """Microseconds since midnight."""
    m = re.fullmatch(r"(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,6}))?)?", text.strip())
    if not m or int(m[1]) > 23 or int(m[2]) > 59 or int(m[3] or 0) > 59:
        raise TypeMismatch(f"not a time: {text!r}")
    return ((int(m[1]) * 60 + int(m[2])) * 60 + int(m[3] or 0)) * 1_000_000 + int((m[4] or "0").ljust(6, "0"))


def interval(text: str) -> tuple[int, int, int]:
    """(months, days, micros) of the verbose, clock, year-month and ISO forms."""
    out, s = {"months": 0, "days": 0, "micros": 0}, text.strip()
    if m := ISO.match(s):
        for got, unit in zip(m.groups(), ("year", "month", "week", "day", "hour", "minute", "second"), strict=True):
            kind, n = PART[unit]
            out[kind] += round(float(got or 0) * n) if "." in (got or "") else int(got or 0) * n
        return out["months"], out["days"], out["micros"]
    rest = s.lower()
    ago = rest.endswith(" ago")
    rest = rest.removesuffix(" ago").removeprefix("@ ")
    while rest := rest.strip():
        if m := re.match(r"([+-]?)(\d+):(\d{2})(?::(\d{2}(?:\.\d+)?))?(?=\s|$)", rest):
            n = (int(m[2]) * 60 + int(m[3])) * 60_000_000 + round(float(m[4] or 0) * 1e6)
            out["micros"] += -n if m[1] == "-" else n
        elif m := re.match(r"([+-]?)(\d+)-(\d+)(?=\s|$)", rest):
            n = int(m[2]) * 12 + int(m[3])
            out["months"] += -n if m[1] == "-" else n
        elif (m := re.match(r"([+-]?\d+(?:\.\d+)?)\s*([a-z]+)", rest)) and m[2].removesuffix("s") in PART:
            kind, n = PART[m[2].removesuffix("s")]
            if "." in m[1] and kind != "micros":
                raise TypeMismatch(f"a fraction of {m[2]} in {text!r}")
            out[kind] += round(float(m[1]) * n) if "." in m[1] else int(m[1]) * n
        else:
            raise TypeMismatch(f"not an interval: {text!r}")
        rest = rest[m.end() :]
    if not s:
        raise TypeMismatch("an empty interval")
    sign = -1 if ago else 1
    return sign * out["months"], sign * out["days"], sign * out["micros"]


def interval_lit(parts: tuple[int, int, int]) -> Column:
    return F.struct(F.lit(parts[0]).cast("int").alias("months"), F.lit(parts[1]).cast("int").alias("days"), F.lit(parts[2]).cast("long").alias("micros"))


def interval_key(c: Column) -> Column:
    """What intervals are compared by: months of 30 days, days of 24 hours."""
    return (c["months"].cast("decimal(20,0)") * 30 + c["days"]) * F.lit(DAY).cast("decimal(18,0)") + c["micros"]


def two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def clock(micros: Column) -> Column:
    """HH:MM:SS of microseconds since midnight."""
    s = F.floor(micros / 1_000_000)
    return F.concat(two(F.floor(s / 3600)), F.lit(":"), two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60))


def timestamp_text(c: Column) -> Column:
    """YYYY-MM-DD HH:MM:SS+00:00, whatever the session's time zone."""
    us = F.unix_micros(c)
    days = F.floor(us / DAY).cast("int")
    return F.concat(F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string"), F.lit(" "), clock(F.pmod(us, F.lit(DAY))), F.lit("+00:00"))


def interval_text(c: Column) -> Column:
    def unit(n: Column, name: str) -> Column:
        return F.when(n == 0, F.lit(None)).otherwise(F.concat(n.cast("string"), F.lit(f" {name}"), F.when(F.abs(n) == 1, F.lit("")).otherwise(F.lit("s"))))

    months, us = c["months"], c["micros"]
    years = (months / 12).cast("int")
    rest = F.abs(us)
    hours = F.floor(rest / 3_600_000_000)
    fraction = F.when(rest % 1_000_000 == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.rtrim(F.lpad((rest % 1_000_000).cast("string"), 6, "0"), F.lit("0"))))
    hms = F.concat(F.when(us < 0, F.lit("-")).otherwise(F.lit("")), F.when(hours < 100, two(hours)).otherwise(hours.cast("string")), F.lit(":"), two(F.floor(rest / 60_000_000) % 60), F.lit(":"), two(F.floor(rest / 1_000_000) % 60), fraction)
    none = (months == 0) & (c["days"] == 0) & (us == 0)
    text = F.concat_ws(" ", unit(years, "year"), unit(months % 12, "mon"), unit(c["days"], "day"), F.when(us != 0, hms))
    return F.when(c.isNull(), F.lit(None)).when(none, F.lit("00:00:00")).otherwise(text)
