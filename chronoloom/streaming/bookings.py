"""Bookings as streams (R1, R4 to R7). Every function takes and gives DataFrames, streaming or not, so that a batch run gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def notifications(events: DataFrame, subscribers: DataFrame) -> DataFrame:
    """Each lifecycle event with the URLs of those who subscribed to its trigger: by its event type, or of its user for all types.

    events: id, trigger, user, event_type. subscribers: url, user, event_type, triggers (array), active.
    """
    s = subscribers.where("active").select("url", F.col("user").alias("_u"), F.col("event_type").alias("_t"), F.explode("triggers").alias("_trigger"))
    trigger = F.col("trigger") == F.col("_trigger")
    # a join for each kind of subscription, on all of its keys: on the trigger alone every event of it would meet every subscriber
    of_type = events.join(s.where("_t IS NOT NULL"), trigger & (F.col("event_type") == F.col("_t")))
    of_user = events.join(s.where("_t IS NULL"), trigger & (F.col("user") == F.col("_u")))
    return of_type.select("id", "trigger", "url").unionByName(of_user.select("id", "trigger", "url"))


def once(reminders: DataFrame, *keys: str, at: str = "at", late: str = "3 days") -> DataFrame:
    """A reminder that was sent is not sent again: state by key, forgotten after `late`."""
    return reminders.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys)) if reminders.isStreaming else reminders.dropDuplicates(list(keys))


def per_window(events: DataFrame, *keys: str, at: str = "at", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """An extension: events counted by window and key; late ones are dropped after the watermark."""
    e = events.withWatermark(at, late) if events.isStreaming else events
    g = e.groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("window_start"), *keys, "n")


def run_once(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, fan_out: int | None = None):
    """All that is new, as a scheduled job would take it, in batches handed to `each`; with at most fan_out tasks at once.

    The checkpoint folder keeps what was taken, so that a run that was cut off goes on where it stopped.
    """
    to = (lambda df, i: each(df.coalesce(fan_out), i)) if fan_out else each
    return stream.writeStream.foreachBatch(to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newer(df: DataFrame, seen, key: str, limit: int) -> DataFrame:
    """The next page after the last key that was seen."""
    return df.where(F.col(key) > F.lit(seen)).orderBy(key).limit(limit)
