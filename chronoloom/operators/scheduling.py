"""Schedules and bookings on top of the availability algebra (T4, T16, T18, T20, T21; K1, K4, K5, K8, K10; R2, R3)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calendar import slots
from .conflicts import remove_conflicts


def resolve_schedule(event_types: DataFrame, schedules: DataFrame, availability: DataFrame, users: DataFrame) -> DataFrame:
    """T4: (event_type, user, zone, hours) by the schedule of the event type, else the user's default one, else the user's first.

    event_types: event_type, user, schedule, zone. schedules: schedule, user, zone. availability: schedule, event_type, user, days, start_min,
    end_min (one of the first three set). users: user, default_schedule, zone. Without a schedule, or with one of no rows, the event type's own rows count if
    there are any, else the user's.
    """
    first = schedules.groupBy(F.col("user").alias("_u")).agg(F.min("schedule").alias("_first"))
    u = users.select(F.col("user").alias("_uu"), "default_schedule", F.col("zone").alias("_uz"))
    e = event_types.join(u, F.col("user") == F.col("_uu"), "left").join(first, F.col("user") == F.col("_u"), "left")
    e = e.select("event_type", "user", F.coalesce("schedule", "default_schedule", "_first").alias("_s"), F.col("zone").alias("_ez"), "_uz")
    s = schedules.select(F.col("schedule").alias("_id"), F.col("zone").alias("_sz"))
    rows = F.array_sort(F.collect_list(F.struct("start_min", "end_min", "days"))).alias("rows")
    of = lambda key, name: availability.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"_{name}_k")).agg(rows.alias(f"_{name}"))
    out = e.join(s, F.col("_s") == F.col("_id"), "left").join(of("schedule", "a"), F.col("_s") == F.col("_a_k"), "left").join(of("event_type", "b"), F.col("event_type") == F.col("_b_k"), "left").join(of("user", "c"), F.col("user") == F.col("_c_k"), "left")
    return out.select("event_type", "user", F.coalesce("_sz", "_ez", "_uz").alias("zone"), F.coalesce("_a", "_b", "_c").alias("hours"))


def disabled_days(days: DataFrame, bookable: DataFrame, keys: list[str], *, first: Column, last: Column) -> DataFrame:
    """Each day of the grid with `disabled`: outside [first, last] or without a bookable slot; and the columns its month's grid leaves empty."""
    have = bookable.select(*keys, F.col("day").alias("_day")).distinct().withColumnsRenamed({k: f"_{k}" for k in keys})
    on = F.col("day") == F.col("_day")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    blank = (F.dayofweek(F.trunc("day", "month")) - 1).cast("int")
    return days.join(have, on, "left").select(*keys, "day", (F.col("_day").isNull() | ~F.col("day").between(first, last)).alias("disabled"), blank.alias("blank"))


def is_past(day: Column, now: Column) -> Column:
    """By the day, not by the instant."""
    return F.date_trunc("day", day) < F.date_trunc("day", now)


def member_slots(grid: DataFrame, busy: DataFrame, keys: list[str], *, now_s: Column, length: int) -> DataFrame:
    """The free slots of team members as an administrator sees them: no notice, slots of the step's length, no buffers."""
    g = grid.withColumns({"notice": F.lit(0), "freq": F.lit(length), "length": F.lit(length)})
    return remove_conflicts(slots(g, keys, now_s=now_s), busy, keys, length=F.lit(length), last_rule=False)


def recurring_bookings(requests: DataFrame, dates: str, length: str, key: str) -> DataFrame:
    """A booking for each date, one recurring id for all of a request, and a mail for the first only."""
    each = requests.select("*", F.posexplode(F.array_sort(dates)).alias("_i", "start"))
    end = F.col("start") + F.make_dt_interval(F.lit(0), F.lit(0), F.col(length))
    return each.select(*[c for c in requests.columns if c != dates], F.sha2(F.col(key).cast("string"), 256).alias("recurring"), "start", end.alias("end"), (F.col("_i") == 0).alias("mail"))


def insert_with_children(old: DataFrame, old_children: DataFrame, new: DataFrame, children: str, key: str, fk: str) -> tuple[DataFrame, DataFrame]:
    """K1: both tables after rows with nested children were added; the parent's key is there before."""
    kids = new.select(F.col(key).alias(fk), F.explode(children).alias("c")).select(fk, "c.*")
    return old.unionByName(new.drop(children)), old_children.unionByName(kids)


def commands(df: DataFrame, action: str, target: Column, body: Column) -> DataFrame:
    """K4, K5: the requests that an external calendar or meeting service is to get, in rows; deliver() sends them."""
    method = {"create": "POST", "update": "PATCH", "delete": "DELETE"}[action]
    return df.select(F.lit(method).alias("method"), target.alias("target"), F.when(F.lit(action != "delete"), body).alias("body"))


def deliver(df: DataFrame, send: Callable[[dict], None]) -> None:
    """Hand every row to send() on the executors, partition by partition; a lost executor's rows are sent again, so send() is to be idempotent."""

    def run(rows):
        for r in rows:
            send(r.asDict())

    df.foreachPartition(run)


def payments(bookings: DataFrame, amount: Column, fee: Column, currency: str = "usd") -> DataFrame:
    """K8: a payment row for each booking."""
    return bookings.select("id", amount.alias("amount"), fee.alias("fee"), F.lit(currency).alias("currency"), F.lit(False).alias("success"), F.lit(False).alias("refunded"))


def mails(bookings: DataFrame, attendees: str, organizer: str) -> DataFrame:
    """A message for each attendee and one for the organiser."""
    out = F.concat(F.transform(attendees, lambda a: F.struct(a.alias("to"), F.lit("attendee").alias("role"))), F.array(F.struct(F.col(organizer).alias("to"), F.lit("organizer").alias("role"))))
    return bookings.select("id", F.explode(out).alias("m")).select("id", "m.to", "m.role")


def settle(bookings: DataFrame, payments_: DataFrame, paid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R2: payments and bookings after the given payments (external) succeeded; both change together."""
    p = paid.select(F.col("external").alias("_x")).distinct()
    done = payments_.join(p, F.col("external") == F.col("_x"), "left")
    done = done.withColumn("success", F.col("success") | F.col("_x").isNotNull()).drop("_x")
    ok = done.where("success").select(F.col("booking").alias("_b")).distinct()
    b = bookings.join(ok, F.col("id") == F.col("_b"), "left")
    return b.withColumn("paid", F.col("paid") | F.col("_b").isNotNull()).drop("_b"), done


def tired(scores: DataFrame, bookings: DataFrame, threshold: float) -> DataFrame:
    """The bookings of the day of hosts whose sleep lasted less than the threshold (hours) are to be moved."""
    low = scores.where(F.col("seconds") / 3600 < threshold).select("host", F.col("day").alias("_d")).distinct()
    return bookings.join(low.withColumnRenamed("host", "_h"), (F.col("host") == F.col("_h")) & (F.col("day") == F.col("_d")), "left_semi")
