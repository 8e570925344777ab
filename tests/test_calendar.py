"""The golden cases of the scheduling model: clock 2021-06-20T11:59:59Z, a Sunday."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import scalars as X
from chronoloom.operators import calendar as C
from chronoloom.operators import conflicts as B
from chronoloom.operators import people as P

NOW = int(dt.datetime(2021, 6, 20, 11, 59, 59, tzinfo=dt.timezone.utc).timestamp())
WEEK = [0, 1, 2, 3, 4, 5, 6]
SLOT = "host int, day date, offset_min int, freq int, length int, notice int, hours array<struct<days:array<int>,start_min:int,end_min:int>>"


def slots(spark, day, offset, freq, length, notice, hours):
    df = spark.createDataFrame([(1, day, offset, freq, length, notice, hours)], SLOT)
    return C.slots(df, ["host"], now_s=F.lit(NOW))


@pytest.mark.parametrize(
    "day,offset,notice,hours,count",
    [
        (21, 0, 0, (WEEK, 0, 1439), 24),  # G1
        (20, 0, 0, (WEEK, 0, 1439), 12),  # G2
        (20, 120, 0, ([0], 1380, 1439), 0),  # G3
        (20, -60, 0, ([0], 0, 60), 0),  # G4
        (21, 0, 1500, (WEEK, 0, 1439), 11),  # G5
    ],
)
def test_slots(spark, day, offset, notice, hours, count):
    assert slots(spark, dt.date(2021, 6, day), offset, 60, 60, notice, [hours]).count() == count


@pytest.mark.parametrize("freq,count", [(60, 20), (5, 239)])  # G6, G7
def test_conflicts(spark, freq, count):
    s = slots(spark, dt.date(2021, 6, 21), 0, freq, 60, 0, [(WEEK, 0, 1439)])
    day = int(dt.datetime(2021, 6, 21, tzinfo=dt.timezone.utc).timestamp())
    busy = spark.createDataFrame([(1, day + 12 * 3600 + 3000, day + 13 * 3600 + 3000)], "host int, busy_s long, busy_e long")
    assert B.remove_conflicts(s, busy, ["host"], length=F.lit(60), before=15, after=15).count() == count


@pytest.mark.parametrize(
    "offset,rows,want",
    [
        (0, [([0], 1380, 1439)], [([0], 1380, 1439)]),  # G8
        (720, [([1], 0, 1439)], [([1], 0, 719), ([0], 720, 1439)]),  # G9
        (-660, [([1], 0, 1439)], [([2], 0, 659), ([1], 660, 1439)]),  # G10
        (-60, [([0], 1380, 1439), ([1], 0, 960)], [([1], 0, 59), ([1], 60, 1020)]),  # G11
        (60, [([0], 1260, 1439), ([1], 0, 60)], [([0], 1200, 1379), ([0], 1380, 1439)]),
    ],
)
def test_working_hours(spark, offset, rows, want):
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "k int, ord int, days array<int>, start_min int, end_min int")
    got = C.working_hours(df, ["k"], F.lit(offset)).first()["hours"]
    assert [(h["days"], h["start_min"], h["end_min"]) for h in got] == want


def test_no_availability_is_open_all_week(spark):
    df = spark.createDataFrame([(1, 0, None, None, None)], "k int, ord int, days array<int>, start_min int, end_min int")
    assert C.working_hours(df, ["k"], F.lit(60)).first()["hours"][0]["days"] == WEEK


def test_schedule(spark):  # G12
    r = lambda a, b: {"start_min": a, "end_min": b}
    week = [[], [r(780, 1020)], [r(780, 1020)], [r(540, 720), r(780, 1020)], [r(540, 1020)], [r(540, 720)], []]
    df = spark.createDataFrame([(1, week), (2, [[]])], "k int, s array<array<struct<start_min:int,end_min:int>>>")
    rows = C.availability_from_schedule(df, ["k"], "s").orderBy("first").collect()
    assert [(x["days"], x["start_min"], x["end_min"]) for x in rows] == [([1, 2, 3], 780, 1020), ([3, 5], 540, 720), ([4], 540, 1020)]
    back = C.schedule_from_availability(C.availability_from_schedule(df, ["k"], "s"), ["k"]).orderBy("day").collect()
    assert [len(x["ranges"]) for x in back] == [0, 1, 1, 2, 1, 1, 0]


def test_merge_split_text(spark):
    w = F.array(*[F.struct(F.lit(a).alias("start_min"), F.lit(b).alias("end_min")) for a, b in ((0, 59), (60, 120), (200, 300))])
    row = spark.range(1).select(C.merge_adjacent(w).alias("m"), C.split_window(F.lit(0), F.lit(59), F.lit(30), F.lit(30)).alias("s"), C.day_ranges(F.array(*map(F.lit, (1, 2, 3, 5)))).alias("d"), F.size(C.day_grid()).alias("g")).first()
    assert [(x[0], x[1]) for x in row["m"]] == [(0, 120), (200, 300)] and row["s"] == [0, 30]
    assert row["d"] == "Mon - Wed, Fri" and row["g"] == 96


def test_monthly_recurrence_skips_short_months(spark):
    df = spark.createDataFrame([(dt.date(2022, 1, 31), 1, 1, 3)], "start date, freq int, every int, n int")
    assert [r["occurs"] for r in C.expand_recurrence(df, "start", "freq", "every", "n").orderBy("occurrence").collect()] == [dt.date(2022, 1, 31), dt.date(2022, 3, 31), dt.date(2022, 5, 31)]


@pytest.mark.parametrize("start", range(7))
@pytest.mark.parametrize("n", [0, 1, 3, 5, 8])
def test_business_days(spark, start, n):
    day = dt.date(2021, 6, 21) + dt.timedelta(start)
    want, left = day, n
    while left:
        want += dt.timedelta(1)
        left -= want.weekday() < 5
    if n == 0 and day.weekday() > 4:
        want = day - dt.timedelta(day.weekday() - 4)
    got = spark.range(1).select(X.business_days_add(F.lit(day), F.lit(n)).alias("d")).first()["d"]
    assert got == want


def test_least_loaded(spark):  # G14
    hosts = spark.createDataFrame([(1, "a"), (2, "a")], "host int, team string")
    taken = spark.createDataFrame([(1,), (1,)], "host int")
    assert P.least_loaded(hosts, taken, ["team"]).first()["host"] == 2


def test_same_slot_twice_is_refused(spark):  # G15
    c = spark.createDataFrame([(1, 1000), (1, 9000)], "host int, slot_s long")
    b = spark.createDataFrame([(1, 1000, 2800)], "host int, busy_s long, busy_e long")
    assert {r["slot_s"]: r["available"] for r in B.is_available(c, b, ["host"], F.lit(30)).collect()} == {1000: False, 9000: True}


def test_reminders(spark):
    b = spark.createDataFrame([(i, NOW - 60 * age, False, rej) for i, age, rej in ((1, 200, False), (2, 1500, False), (3, 3000, False), (4, 1500, False), (5, 3000, False), (6, 100, False), (7, 3000, True))], "id int, created_s long, confirmed boolean, rejected boolean")
    ledger = spark.createDataFrame([(4, 180), (5, 2880)], "id int, elapsed int")
    assert {r["id"]: r["due"] for r in P.due_reminders(b, ledger, NOW).collect()} == {1: 180, 2: 1440, 3: 2880, 4: 1440}


def test_texts(spark):
    row = spark.range(1).select(X.event_name(F.lit("Meet {USER}!"), F.lit("x"), F.lit("h"), F.lit("Ann")).alias("a"), X.event_name(F.lit(""), F.lit("30 min"), F.lit("h"), F.lit("g")).alias("b"), X.dynamic_event_name(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit("s")).alias("c"), X.location_label(F.lit("integrations:daily")).alias("d"), X.name_uuid_v5("6ba7b8119dad11d180b400c04fd430c8", F.lit("x")).alias("u")).first()
    import uuid

    assert row[:4] == ("Meet Ann!", "30 min between h and g", "a, b & c", "Daily") and row["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "x"))


def test_equal_rows_have_their_own_occurrences(spark):
    df = spark.createDataFrame([(dt.date(2022, 1, 31), 1, 1, 3)] * 2 + [(dt.date(2022, 1, 3), 2, 1, 2)] * 2 + [(dt.date(2022, 1, 3), 2, 1, 0)], "start date, freq int, every int, n int")
    got = sorted((r["start"].day, r["occurrence"], r["occurs"]) for r in C.expand_recurrence(df, "start", "freq", "every", "n").collect())
    assert got == [(3, 0, dt.date(2022, 1, 3))] * 2 + [(3, 1, dt.date(2022, 1, 10))] * 2 + [(31, i, dt.date(2022, m, 31)) for i, m in enumerate((1, 3, 5)) for _ in "ab"]
