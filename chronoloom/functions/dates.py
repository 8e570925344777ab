"""Date, time and zone functions over columns (X20, X22, X23, X26, X27, X30, X31, X33, X34, X36). Timestamps have no zone and are in UTC unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MINUTES = {"minute": 1, "hour": 60, "day": 1440, "week": 10080}


def plus(ts: Column, n: Column, unit: str) -> Column:
    """N may be negative."""
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), (n * _MINUTES[unit]).cast("int"))


def is_before(a: Column, b: Column, unit: str) -> Column:  # X22
    return F.date_trunc(unit, a) < F.date_trunc(unit, b)


def is_after(a: Column, b: Column, unit: str) -> Column:  # X22
    return is_before(b, a, unit)


def is_between(x: Column, lo: Column, hi: Column, kind: str = "()") -> Column:
    """Each end is open or closed."""
    return ((x >= lo) if kind[0] == "[" else (x > lo)) & ((x <= hi) if kind[1] == "]" else (x < hi))


def in_zone(ts: Column, zone: Column) -> Column:  # X27
    return F.convert_timezone(F.lit("UTC"), zone, ts)


def to_utc(ts: Column, zone: Column) -> Column:  # X27
    return F.convert_timezone(zone, F.lit("UTC"), ts)


def offset_minutes(zone: Column, at: Column) -> Column:
    """Minutes that a zone is ahead of UTC at an instant."""
    return F.timestamp_diff("MINUTE", at, in_zone(at, zone)).cast("int")


def parse_zone(iso: Column) -> Column:
    """(local timestamp, offset in minutes) of an ISO 8601 text; the offset is kept. Null for other texts."""
    ok = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?)(Z|[+-]\d{2}:?\d{2})$"
    part = lambda i: F.regexp_extract(iso, ok, i)
    zone = F.regexp_replace(part(2), ":", "")
    minutes = F.when(zone == "Z", 0).otherwise((F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int")) * F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1))
    local = F.to_timestamp_ntz(F.regexp_replace(part(1), "T", " "))
    return F.when(iso.rlike(ok), F.struct(local.alias("local"), minutes.cast("int").alias("offset_min")))


def format_zone(parsed: Column) -> Column:
    """The text of what parse_zone() gave."""
    o = parsed["offset_min"]
    sign = F.when(o < 0, "-").otherwise("+")
    return F.concat(F.date_format(parsed["local"], "yyyy-MM-dd'T'HH:mm:ss"), sign, F.format_string("%02d:%02d", F.floor(F.abs(o) / 60).cast("int"), (F.abs(o) % 60).cast("int")))


def clock12(ts: Column) -> Column:  # X31: h:mma
    return F.lower(F.date_format(ts, "h:mma"))


def clock24(ts: Column) -> Column:  # X31: HH:mm
    return F.date_format(ts, "HH:mm")


def long_day(ts: Column) -> Column:  # X31: dddd, D MMMM
    return F.date_format(ts, "EEEE, d MMMM")


#: Weekday names by locale, Sunday first (fixed values).
WEEKDAYS = {
    "en": ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"),
    "de": ("Sonntag", "Montag", "Dienstag", "Mittwoch", "Donnerstag", "Freitag", "Samstag"),
    "fr": ("dimanche", "lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi"),
    "es": ("domingo", "lunes", "martes", "miércoles", "jueves", "viernes", "sábado"),
}


def weekday_name(day: Column, locale: str = "en") -> Column:
    """Day: 0 is Sunday."""
    return F.element_at(F.array(*[F.lit(x) for x in WEEKDAYS[locale]]), day.cast("int") + 1)


def minutes_between(a: Column, b: Column) -> Column:  # X34
    return F.timestamp_diff("MINUTE", a, b)


def text_to_minutes(c: Column) -> Column:
    """X36: 'HH:mm' as minutes of the day."""
    return F.split_part(c, F.lit(":"), F.lit(1)).cast("int") * 60 + F.split_part(c, F.lit(":"), F.lit(2)).cast("int")
