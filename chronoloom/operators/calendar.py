"""Availability algebra: working hours, slots, recurrence, booking bounds (survey ids T1 to T3, T7, T9, T12, T14, T22, T23; W3, W4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clock

HOURS = "struct<days:array<int>,start_min:int,end_min:int>"


def availability_from_schedule(df: DataFrame, keys: list[str], schedule: str) -> DataFrame:
    """Days of equal (start, end), in the order of first appearance. schedule: array by weekday of arrays of ranges."""
    each = df.select(*keys, F.posexplode(schedule).alias("day", "ranges")).select(*keys, "day", F.posexplode("ranges").alias("at", "r"))
    g = each.groupBy(*keys, F.col("r.start_min").alias("start_min"), F.col("r.end_min").alias("end_min"))
    out = g.agg(F.array_sort(F.collect_list("day")).alias("days"), F.min(F.struct("day", "at")).alias("first"))
    return out.select(*keys, "days", "start_min", "end_min", "first")


def schedule_from_availability(df: DataFrame, keys: list[str]) -> DataFrame:
    """For each key and weekday 0 to 6 the sorted ranges, an empty array where there are none."""
    days = df.select(*keys).distinct().withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(6))))
    ranges = df.select(*keys, F.explode("days").alias("day"), F.struct("start_min", "end_min").alias("r")).groupBy(*keys, "day").agg(F.array_sort(F.collect_list("r")).alias("ranges"))
    return days.join(ranges, [*keys, "day"], "left").withColumn("ranges", F.coalesce("ranges", F.array().cast("array<struct<start_min:int,end_min:int>>")))


def shifted_hours(days: Column, start: Column, end: Column, offset: Column, wrap_days: bool = False) -> Column:
    """T3 for one availability row: an array of up to two windows in minutes of the zone that is `offset` behind.

    A window that leaves the day at one end continues on the neighbouring day; such days are taken modulo 7 only with wrap_days.
    """
    s, e = start - offset, end - offset
    lo, hi = F.least(F.greatest(s, F.lit(0)), F.lit(1439)), F.least(F.greatest(e, F.lit(0)), F.lit(1439))
    move = lambda d: F.transform(days, lambda x: (F.pmod(x + d, F.lit(7)) if wrap_days else x + d).cast("int"))
    one = lambda d, a, b: F.struct(d.alias("days"), a.cast("int").alias("start_min"), b.cast("int").alias("end_min"))
    none = F.lit(None).cast(HOURS)
    same = F.when(lo != hi, one(days, lo, hi)).otherwise(none)
    before = one(move(-1), s + 1440, F.least(e + 1440, F.lit(1439)))
    after = one(move(1), F.greatest(s - 1440, F.lit(0)), e - 1440)
    other = F.when((s < 0) | (e < 0), before).when((s > 1439) | (e > 1439), after).otherwise(none)
    return F.filter(F.array(same, other), lambda x: x.isNotNull())


def working_hours(df: DataFrame, keys: list[str], offset: Column, wrap_days: bool = False) -> DataFrame:
    """Keys with days, start_min, end_min, and `hours`: all windows of a key sorted by start (stable in row order).

    df: keys, ord, days, start_min, end_min. A key whose only row has null days is open all week.
    """
    h = F.when(F.col("days").isNull(), F.array(F.struct(F.sequence(F.lit(0), F.lit(6)).alias("days"), F.lit(0).alias("start_min"), F.lit(1439).alias("end_min")).cast(HOURS))).otherwise(
        shifted_hours(F.col("days"), F.col("start_min"), F.col("end_min"), offset, wrap_days)
    )
    each = df.select(*keys, "ord", F.posexplode(h).alias("_part", "w"))
    rows = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("w.start_min").alias("start_min"), "ord", "_part", F.col("w.days").alias("days"), F.col("w.end_min").alias("end_min")))).alias("hours"))
    return rows.select(*keys, F.transform("hours", lambda x: F.struct(x["days"].alias("days"), x["start_min"].alias("start_min"), x["end_min"].alias("end_min"))).alias("hours"))


def merge_adjacent(windows: Column) -> Column:
    """Sorted windows (start_min, end_min) with those joined whose end is right before the next start."""
    empty = F.array().cast("array<struct<start_min:int,end_min:int>>")

    def step(acc, w):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start_min"].alias("start_min"), w["end_min"].alias("end_min"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end_min"] + 1 == w["start_min"]), joined).otherwise(F.concat(acc, F.array(w)))

    return F.aggregate(windows, empty, step)


def split_window(start: Column, end: Column, freq: Column, length: Column) -> Column:
    """Minutes from start in steps of freq whose slot of `length` ends by end + 1."""
    last = end + 1 - length
    return F.when(last >= start, F.sequence(start, last, freq)).otherwise(F.array().cast("array<int>"))


def slots(df: DataFrame, keys: list[str], *, day: str = "day", offset: str = "offset_min", hours: str = "hours", freq: str = "freq", length: str = "length", now_s: Column, notice: str = "notice") -> DataFrame:
    """Keys, day, slot_s (epoch seconds), one row for each bookable slot of an invitee's day.

    day: date in the invitee's zone; offset: minutes that zone is ahead of UTC; hours: windows in UTC.
    """
    local = F.flatten(F.transform(hours, lambda h: shifted_hours(h["days"], h["start_min"], h["end_min"], -F.col(offset))))
    today = F.filter(local, lambda h: F.array_contains(h["days"], F.dayofweek(day) - 1))
    pairs = merge_adjacent(F.array_sort(F.transform(today, lambda h: F.struct(h["start_min"].alias("start_min"), h["end_min"].alias("end_min")))))
    first = now_s + F.col(notice) * 60
    begin = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint") * 86400 - F.col(offset) * 60
    # the day itself must not lie before the day of now + notice
    open_ = begin + 86400 > first
    each = df.withColumns({"_open": open_, "_b": begin, "_n": first, "_pairs": pairs}).where("_open")
    each = each.withColumn("_w", F.explode("_pairs"))
    each = each.withColumn("_m", F.explode(split_window(F.col("_w.start_min"), F.col("_w.end_min"), F.col(freq), F.col(length))))
    each = each.select(*keys, F.col(day).alias("day"), F.col(length).alias("length"), "_b", "_n", "_m")
    return each.withColumn("slot_s", F.col("_b") + F.col("_m").cast("bigint") * 60).where("slot_s >= _n").select(*keys, "day", "length", "slot_s")


def slot_step(interval: Column, length: Column) -> Column:  # T9
    return F.coalesce(F.nullif(interval, F.lit(0)), length)


def expand_recurrence(df: DataFrame, start: str, freq: str, interval: str, count: str, until: str | None = None) -> DataFrame:
    """Df with `occurrence` (0, 1, ..) and `occurs` (date). freq: yearly 0, monthly 1, weekly 2, daily 3.

    Months or years without the day are skipped, and the count goes on until it is reached.
    """
    n = F.col(count)
    few = F.when(F.col(freq) >= 2, n).when((F.day(start) <= 28), n).when(F.col(freq) == 1, n * 2 + 2).otherwise(n * 8 + 8)

    def day(i):
        step = i * F.col(interval)
        return F.when(F.col(freq) == 3, F.date_add(start, step)).when(F.col(freq) == 2, F.date_add(start, step * 7)).when(F.col(freq) == 1, F.add_months(start, step)).otherwise(F.add_months(start, step * 12))

    # counted within the row, so that equal rows keep their own occurrences
    days = F.transform(F.sequence(F.lit(0), F.greatest(few - 1, F.lit(0))), day)
    days = F.filter(days, lambda d: (F.col(freq) >= 2) | (F.day(d) == F.day(start)))
    d = df.select("*", F.posexplode(F.slice(days, F.lit(1), F.greatest(n, F.lit(0)))).alias("occurrence", "occurs"))
    d = d.select(*df.columns, "occurs", "occurrence")
    if until:
        d = d.where(F.col(until).isNull() | (F.col("occurs") <= F.col(until)))
    return d


def out_of_bounds(day: Column, kind: Column, days: Column, calendar_days: Column, range_start: Column, range_end: Column, today: Column) -> Column:
    """T14 over dates in the candidate's zone: is the day outside the period in which bookings are taken?"""
    from ..functions.scalars import business_days_add

    last = F.when(calendar_days, F.date_add(today, days)).otherwise(business_days_add(today, days))
    return F.coalesce(F.when(kind == "ROLLING", day > last).when(kind == "RANGE", (day < range_start) | (day > range_end)).otherwise(F.lit(False)), F.lit(False))


def day_ranges(days: Column) -> Column:
    """Sorted weekdays as text: [1,2,3,5] is 'Mon - Wed, Fri'."""
    names = F.array(*[F.lit(x) for x in ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")])
    empty = F.array().cast("array<struct<a:int,b:int>>")

    def step(acc, d):
        last = F.try_element_at(acc, F.lit(-1))
        more = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["a"].alias("a"), d.alias("b"))))
        return F.when((F.size(acc) > 0) & (last["b"] + 1 == d), more).otherwise(F.concat(acc, F.array(F.struct(d.alias("a"), d.alias("b")))))

    runs = F.aggregate(days, empty, step)
    text = F.transform(runs, lambda r: F.when(r["a"] == r["b"], F.element_at(names, r["a"] + 1)).otherwise(F.concat(F.element_at(names, r["a"] + 1), F.lit(" - "), F.element_at(names, r["b"] + 1))))
    return F.array_join(text, ", ")


def availability_text(days: Column, start: Column, end: Column) -> Column:  # T22
    return F.concat(day_ranges(days), F.lit(", "), clock(start), F.lit(" - "), clock(end))


def day_grid(step: int = 15, after: Column | None = None, before: Column | None = None) -> Column:
    """Minutes of a day, those after `after` and before `before` where these are given."""
    grid = F.sequence(F.lit(0), F.lit(1440 - step), F.lit(step))
    if after is not None:
        grid = F.filter(grid, lambda m: after.isNull() | (m > after))
    return grid if before is None else F.filter(grid, lambda m: before.isNull() | (m < before))
