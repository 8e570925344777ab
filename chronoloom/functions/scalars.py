"""Scalar functions over columns (survey ids X1 to X6, X8 to X10, X12, X14, X15, X25, X28, X29, X32, X35, X40, X41, X45; F23; K3, K6, K7); none of them uses a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slugify(c: Column) -> Column:  # X1
    return F.lower(F.regexp_replace(c, "[^a-zA-Z0-9-]", "-"))


def username_list(c: Column) -> Column:  # X2
    return F.filter(F.split(F.regexp_replace(F.lower(c), " |%20", "+"), r"\+"), lambda x: x != "")


def group_name(names: Column) -> Column:  # X3
    return F.array_join(names, ", ")


def dynamic_event_name(names: Column, slug: Column) -> Column:  # X4
    n = F.size(names)
    last = F.element_at(names, -1)
    return F.when(n == 0, slug).when(n == 1, last).otherwise(F.concat(F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(" & "), last))


def username_slug(names: Column) -> Column:  # X5
    return F.array_join(names, "+")


def event_name(template: Column, kind: Column, host: Column, guest: Column) -> Column:  # X6
    at = F.instr(template, "{USER}")
    filled = F.concat(F.substr(template, F.lit(1), at - 1), guest, F.substr(template, at + 6))
    plain = F.concat(kind, F.lit(" between "), host, F.lit(" and "), guest)
    return F.when(truthy(template).isNull(), plain).when(at > 0, filled).otherwise(template)


def is_email(c: Column) -> Column:  # X8
    return c.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")


def has_scheme(c: Column) -> Column:  # X9
    return c.rlike("^https?://")


def location_label(c: Column) -> Column:  # X10
    part = F.split_part(c, F.lit(":"), F.lit(2))
    return F.concat(F.upper(F.substring(part, 1, 1)), F.substr(part, F.lit(2)))


def app_name(kind: Column) -> Column:  # X12
    return F.replace(kind, F.lit("_"), F.lit(""))


def key_hash(c: Column) -> Column:  # X14
    return F.sha2(c, 256)


def truthy(c: Column) -> Column:  # '' counts as missing
    return F.nullif(c, F.lit(""))


def weekday(c: Column) -> Column:  # X25: 0 is Sunday
    return F.dayofweek(c) - 1


def minute_of_day(c: Column) -> Column:  # X28
    return F.hour(c) * 60 + F.minute(c)


def clock(m: Column) -> Column:  # X32
    return F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), (m % 60).cast("int"))


def clamp(c: Column, lo, hi) -> Column:  # X40
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def fee(price: Column, share: float, fixed: int) -> Column:  # X41: halves go up
    return F.floor(price * share + fixed + 0.5)


def ensure_array(c: Column) -> Column:  # X45
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.array(c))


def business_days_add(day: Column, n: Column) -> Column:  # X29: Monday to Friday, no holidays
    back = F.when(F.dayofweek(day) == 1, 2).when(F.dayofweek(day) == 7, 1).otherwise(0)
    start = F.date_sub(day, back)  # a weekend counts from its Friday
    rest = F.pmod(n, F.lit(5)).cast("int")
    wd = F.dayofweek(start) - 2  # 0 is Monday
    return F.date_add(start, (F.floor(n / 5) * 7 + rest + F.when(wd + rest > 4, 2).otherwise(0)).cast("int"))


def iso_ms(c: Column) -> Column:  # X35
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def name_uuid_v5(namespace_hex: str, name: Column) -> Column:  # X15
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), name.cast("binary")))
    variant = F.substr(F.lit("89ab"), F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def render(template: Column, **values: Column) -> Column:  # K3: plain {{name}} fields
    for name, v in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), F.coalesce(v.cast("string"), F.lit("")))
    return template


def ics_event(uid: Column, start: Column, end: Column, title: Column, attendees: Column | None = None, rule: Column | None = None, method: str | None = None) -> Column:
    """K6: an iCalendar text of one event; attendees: array of addresses; rule: FREQ=.. text or null; timestamps in UTC."""
    t = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss'Z'")
    line = lambda name, c: F.concat(F.lit(name), c, F.lit("\r\n"))
    more = [F.array_join(F.transform(attendees, lambda a: line("ATTENDEE:mailto:", a)), "")] if attendees is not None else []
    more += [F.coalesce(line("RRULE:", rule), F.lit(""))] if rule is not None else []
    head = "BEGIN:VCALENDAR\r\nVERSION:2.0\r\n" + (f"METHOD:{method}\r\n" if method else "") + "BEGIN:VEVENT\r\n"
    return F.concat(F.lit(head), line("UID:", uid), line("DTSTART:", t(start)), line("DTEND:", t(end)), line("SUMMARY:", title), *more, F.lit("END:VEVENT\r\nEND:VCALENDAR\r\n"))


def ics_rule(freq: Column, interval: Column, count: Column) -> Column:
    """K6: the rule of a recurring event (yearly 0, monthly 1, weekly 2, daily 3), null without a count."""
    name = F.element_at(F.array(*[F.lit(x) for x in ("YEARLY", "MONTHLY", "WEEKLY", "DAILY")]), freq.cast("int") + 1)
    return F.when(count.isNotNull(), F.concat(F.lit("FREQ="), name, F.lit(";INTERVAL="), interval.cast("string"), F.lit(";COUNT="), count.cast("string")))


def ics_duration(start: Column, end: Column) -> Column:
    """K6: hours and minutes of an event."""
    m = F.timestamp_diff("MINUTE", start, end)
    return F.struct(F.floor(m / 60).cast("int").alias("hours"), (m % 60).cast("int").alias("minutes"))


def without_method(ics: Column) -> Column:  # K7
    return F.regexp_replace(ics, "METHOD:[^\r\n]+\r\n", "")
