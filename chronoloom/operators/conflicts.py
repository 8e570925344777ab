"""Busy intervals and conflicts (survey ids T5, T6, T8, T17; J16; F16). Times are epoch seconds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNSET = object()


def contained(start: Column, end: Column, lo, hi) -> Column:  # F16
    return (start >= F.lit(lo)) & (end <= F.lit(hi))


def on_day(df: DataFrame, ts: str, day: str) -> DataFrame:
    """rows of a day, as bounds on the stored column."""
    first = F.lit(day).cast("date")
    return df.where((F.col(ts) >= first.cast("timestamp_ntz")) & (F.col(ts) < F.date_add(first, 1).cast("timestamp_ntz")))


def overlaps(start: Column, end: Column, lo: Column, hi: Column) -> Column:
    return (start < hi) & (end > lo)


def busy_times(bookings: DataFrame, *sources: DataFrame, lo, hi, event_type=UNSET, mode: str = "contained") -> DataFrame:
    """(host, busy_s, busy_e) of accepted or pending bookings in the range and of all external sources.

    bookings: host, status, event_type, start_s, end_s; an event_type that is UNSET drops its condition (F10).
    """
    test = contained(F.col("start_s"), F.col("end_s"), lo, hi) if mode == "contained" else overlaps(F.col("start_s"), F.col("end_s"), F.lit(lo), F.lit(hi))
    own = bookings.where(F.col("status").isin("ACCEPTED", "PENDING") & test)
    if event_type is not UNSET:
        own = own.where(F.col("event_type").eqNullSafe(F.lit(event_type)))
    own = own.select("host", F.col("start_s").alias("busy_s"), F.col("end_s").alias("busy_e"))
    return reduce(lambda a, b: a.unionByName(b.select("host", "busy_s", "busy_e")), sources, own)


def buffered(busy: DataFrame, minutes: Column) -> DataFrame:  # T6
    return busy.withColumns({"busy_s": F.col("busy_s") - minutes * 60, "busy_e": F.col("busy_e") + minutes * 60})


def remove_conflicts(slots: DataFrame, busy: DataFrame, keys: list[str], *, length: Column | int, before: int = 0, after: int = 0, last_rule: bool = True, bucket_s: int = 86400) -> DataFrame:
    """The slots that meet no busy interval. slots: keys, slot_s; busy: keys, busy_s, busy_e.

    The anti-join has an equality on (keys, day bucket), so that it shuffles and hashes instead of comparing all pairs:
    a busy interval is dealt to every bucket that it touches once widened by the slot's length and buffers.
    With last_rule, slots whose after-buffer passes the end of the last generated slot of their keys are dropped.
    """
    b, a = before * 60, after * 60
    fixed = isinstance(length, int)
    length = F.lit(length) if fixed else length
    s = slots.withColumn("_e", F.col("slot_s") + length * 60)
    if last_rule and after:
        last = s.groupBy(*keys).agg(F.max("_e").alias("_f"))
        s = s.join(last, keys).where(F.floor((F.col("_e") + a) / 60) * 60 <= F.col("_f")).drop("_f")
    # a slot is in the bucket of its start: a busy interval can meet slots that begin up to the longest slot and the buffers before it
    longest = slots.agg(F.coalesce(F.max(length * 60), F.lit(0)).cast("bigint").alias("_long"))  # one row
    own = busy.withColumn("_long", length.cast("bigint") * 60) if fixed else busy.join(F.broadcast(longest))
    first, last = F.col("busy_s") - F.col("_long") - 2 * (b + a), F.col("busy_e") + 2 * (b + a)
    own = own.withColumn("_k", F.explode(F.sequence(F.floor(first / bucket_s), F.floor(last / bucket_s))))
    own = own.select(*[F.col(k).alias(f"_{k}") for k in keys], "_k", F.col("busy_s").alias("_bs"), F.col("busy_e").alias("_be"))
    x, y = F.col("slot_s"), F.col("_e")
    hit = ((x >= F.col("_bs")) & (x < F.col("_be"))) | ((y > F.col("_bs")) & (y < F.col("_be"))) | ((F.col("_bs") > x) & (F.col("_bs") < y))
    lo, hi = F.col("_bs") - b, F.col("_be") + a
    hit = hit | ((x - b > lo) & (x - b < hi)) | ((y + a > lo) & (y + a < hi))
    s = s.withColumn("_slot_k", F.floor(F.col("slot_s") / bucket_s))
    same = reduce(lambda p, q: p & q, [F.col(k) == F.col(f"_{k}") for k in keys])
    return s.join(own, same & (F.col("_slot_k") == F.col("_k")) & hit, "left_anti").drop("_e", "_slot_k")


def is_available(candidates: DataFrame, busy: DataFrame, keys: list[str], length: Column | int) -> DataFrame:
    """Candidates with the flag `available`: no busy interval overlaps [slot_s, slot_s + length)."""
    free = remove_conflicts(candidates, busy, keys, length=length, last_rule=False).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("slot_s").alias("_s")).distinct()
    same = reduce(lambda p, q: p & q, [F.col(k) == F.col(f"_{k}") for k in keys])
    return candidates.join(free, same & (F.col("slot_s") == F.col("_s")), "left").select(*candidates.columns, F.col("_s").isNotNull().alias("available"))
