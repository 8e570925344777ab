"""Pooling, assignment, bookings, teams, mutations (survey ids T10, T11, T15, T19; F18, F22; O7; W2; A2, A8, A12; J2, J4, J9, J10; M2, M4, M13, M14, M16, M20; U2, U6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pool(slots: DataFrame, keys: list[str], how: str, n_hosts: Column | None = None) -> DataFrame:
    """Slots of several hosts. collective: those that all n_hosts have; round_robin: all, with their hosts."""
    g = slots.groupBy(*keys, "slot_s").agg(F.array_sort(F.collect_set("host")).alias("hosts"))
    if how == "collective":
        return g.where(F.size("hosts") == n_hosts)
    if how != "round_robin":
        raise ValueError("several hosts need a scheduling type: collective or round_robin")
    return g


def least_loaded(hosts: DataFrame, bookings: DataFrame, group: list[str]) -> DataFrame:
    """Of each group the host with the fewest bookings, ties to the smallest id; hosts without any count 0."""
    load = bookings.groupBy("host").agg(F.count("*").alias("load"))
    n = hosts.join(load, "host", "left").withColumn("load", F.coalesce("load", F.lit(0)))
    return n.groupBy(*group).agg(F.min(F.struct("load", "host")).alias("m")).select(*group, F.col("m.host").alias("host"), F.col("m.load").alias("load"))


def some(df: DataFrame, child: DataFrame, on, where: Column | None = None) -> DataFrame:  # J4
    return df.join(child.where(where) if where is not None else child, on, "left_semi")


def none(df: DataFrame, child: DataFrame, on, where: Column | None = None) -> DataFrame:  # J9, J10
    return df.join(child.where(where) if where is not None else child, on, "left_anti")


def nest_many(df: DataFrame, child: DataFrame, on: str, name: str, *cols: str) -> DataFrame:
    """Df with the sorted array `name` of the children's structs, empty where there are none."""
    g = child.groupBy(on).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    out = df.join(g, on, "left")
    return out.withColumn(name, F.coalesce(name, F.array().cast(g.schema[name].dataType)))


def first_of(df: DataFrame, group: str, *order) -> DataFrame:
    """The first row of each group; rows with a null group all stay."""
    rn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    lone = df.where(F.col(group).isNull())
    return df.where(F.col(group).isNotNull()).withColumn("_rn", rn).where("_rn = 1").drop("_rn").unionByName(lone)


def list_bookings(df: DataFrame, status: str, now) -> DataFrame:
    """upcoming, recurring, past or cancelled. df: start_s, end_s, status, recurring."""
    cancelled = F.col("status").isin("CANCELLED", "REJECTED")
    t = F.lit(now)
    if status == "upcoming":
        return df.where((F.col("end_s") >= t) & ~cancelled)
    if status == "recurring":
        return df.where((F.col("end_s") >= t) & ~cancelled & F.col("recurring").isNotNull())
    if status == "past":
        return df.where((F.col("end_s") <= t) & ~cancelled)
    if status == "cancelled":
        return df.where(cancelled)
    raise ValueError(status)


def page(df: DataFrame, *order, limit: int = 10, offset: int = 0) -> DataFrame:
    """O7 without the reference's slips Q1 and Q2: `limit` rows and one sentinel row that says whether there are more."""
    return df.orderBy(*order).offset(offset).limit(limit + 1)


def due_reminders(bookings: DataFrame, ledger: DataFrame, now, intervals=(2880, 1440, 180)) -> DataFrame:
    """T15 in closed form: the largest interval not above a booking's age is due unless the ledger has it or a larger one."""
    age = F.floor((F.lit(now) - F.col("created_s")) / 60)
    due = F.coalesce(*[F.when(age >= i, i) for i in sorted(intervals, reverse=True)])
    sent = ledger.groupBy("id").agg(F.max("elapsed").alias("sent"))
    b = bookings.where(~F.col("confirmed") & ~F.col("rejected")).withColumn("due", due).where("due IS NOT NULL")
    return b.join(sent, "id", "left").where(F.col("sent").isNull() | (F.col("sent") < F.col("due"))).drop("sent")


def seat_stats(members: DataFrame, team: str = "team") -> DataFrame:
    """Members, free, missing and hidden seats, and whether the owner lacks one, by team. members: team, role, plan."""
    free, pro, owner = F.col("plan") == "FREE", F.col("plan") == "PRO", F.col("role") == "OWNER"
    return members.groupBy(team).agg(
        F.count("*").alias("total"), F.count_if(free).alias("free"), F.count_if(~owner | ~pro).alias("missing"), F.count_if(free & ~owner).alias("hidden"), F.coalesce(F.bool_or(owner & ~pro), F.lit(False)).alias("owner_missing")
    )


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:  # M2, U2: the new row wins
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:  # M4, M20: for each parent in new
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def classify(old: DataFrame, new: DataFrame, key: str) -> DataFrame:  # U6
    j = old.select(key, F.lit(True).alias("_o")).join(new.select(key, F.lit(True).alias("_n")), key, "full")
    return j.select(key, F.when(F.col("_o").isNull(), "create").when(F.col("_n").isNull(), "delete").otherwise("update").alias("change"))


def soft_delete(df: DataFrame, pred: Column) -> DataFrame:  # F22
    return df.withColumn("deleted", F.when(pred, F.lit(True)).otherwise(F.col("deleted")))


def visible(df: DataFrame) -> DataFrame:  # what readers see
    return df.where(F.col("deleted").isNull())


def duplicates(df: DataFrame, *key: str) -> DataFrame:  # M13
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def cascade(child: DataFrame, gone: DataFrame, on: str) -> DataFrame:  # M14
    return child.join(gone, on, "left_anti")


def set_state(df: DataFrame, action: str, pred: Column) -> DataFrame:
    """Confirm, reject, cancel or reschedule the bookings that match."""
    new = {"confirm": ("ACCEPTED", True, False), "reject": ("REJECTED", False, True), "cancel": ("CANCELLED", None, None), "reschedule": ("CANCELLED", None, None)}[action]
    out = df.withColumn("status", F.when(pred, new[0]).otherwise(F.col("status")))
    for name, v in (("confirmed", new[1]), ("rejected", new[2])):
        if v is not None:
            out = out.withColumn(name, F.when(pred, F.lit(v)).otherwise(F.col(name)))
    return out.withColumn("rescheduled", F.when(pred, F.lit(True)).otherwise(F.col("rescheduled"))) if action == "reschedule" else out
