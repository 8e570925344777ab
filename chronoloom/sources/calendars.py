"""Calendar sources (S7 to S10, S12 to S14, S17; T13; D1, D2): landed responses are parsed by expressions, live pulls go through a data source.

A landed table has one response for each row, so that reading it is a scan like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BUSY = "calendar string, busy_start timestamp_ntz, busy_end timestamp_ntz"


def instant(c: Column) -> Column:
    """An ISO 8601 text in UTC (with or without Z) as a timestamp."""
    return F.to_timestamp_ntz(F.regexp_replace(F.regexp_replace(c, "T", " "), "Z$", ""))


def free_busy(responses: DataFrame, col: str, *, selected: list[str] | None = None, others: bool = False) -> DataFrame:
    """Busy intervals of {"calendars": {id: {"busy": [{"start", "end"}]}}}.

    selected: the chosen calendars; without any, all of them, or none if only calendars of other integrations were chosen (others).
    """
    kind = "struct<calendars:map<string,struct<busy:array<struct<start:string,end:string>>>>>"
    each = responses.select(F.explode(F.from_json(col, kind)["calendars"]).alias("calendar", "v")).select("calendar", F.explode("v.busy").alias("b"))
    if selected:
        each = each.where(F.col("calendar").isin(selected))
    elif others:
        each = each.where(F.lit(False))
    return each.select("calendar", instant(F.col("b.start")).alias("busy_start"), instant(F.col("b.end")).alias("busy_end"))


def calendar_view(responses: DataFrame, col: str, *keys: str) -> DataFrame:
    """Busy intervals of {"value": [{"showAs", "start": {"dateTime"}, "end": {"dateTime"}}]} without free and working-elsewhere ones, as texts in UTC."""
    kind = "struct<value:array<struct<showAs:string,start:struct<dateTime:string>,end:struct<dateTime:string>>>>"
    each = responses.select(*keys, F.explode(F.from_json(col, kind)["value"]).alias("e")).where(~F.col("e.showAs").isin("free", "workingElsewhere"))
    return each.select(*keys, F.concat("e.start.dateTime", F.lit("Z")).alias("busy_start"), F.concat("e.end.dateTime", F.lit("Z")).alias("busy_end"))


def calendar_events(ics: Column) -> Column:
    """The VEVENT components of an iCalendar text: uid, summary, start, end, rule (a map, empty without one). Lines may be folded."""
    lines = F.regexp_replace(ics, "\r?\n[ \t]", "")
    parts = F.regexp_extract_all(lines, F.lit(r"(?s)BEGIN:VEVENT(.*?)END:VEVENT"), F.lit(1))
    field = lambda e, name: F.nullif(F.regexp_extract(e, rf"(?m)^{name}(?:;[^:\r\n]*)?:([^\r\n]*)", 1), F.lit(""))
    when = lambda c: F.coalesce(*[F.try_to_timestamp(F.regexp_replace(c, "Z$", ""), F.lit(f)).cast("timestamp_ntz") for f in ("yyyyMMdd'T'HHmmss", "yyyyMMdd")])
    rule = lambda e: F.str_to_map(F.coalesce(field(e, "RRULE"), F.lit("FREQ=NONE")), F.lit(";"), F.lit("="))
    return F.transform(parts, lambda e: F.struct(field(e, "UID").alias("uid"), field(e, "SUMMARY").alias("summary"), when(field(e, "DTSTART")).alias("start"), when(field(e, "DTEND")).alias("end"), rule(e).alias("rule")))


def first_occurrence(start: Column, rule: Column, lo: Column, hi: Column, most: int = 365) -> Column:
    """The first occurrence of a daily, weekly, monthly or yearly rule in [lo, hi], of at most `most`; null without one.

    Rules by the second, minute or hour are skipped. Without a rule the start itself counts.
    """
    freq, every = rule["FREQ"], F.coalesce(rule["INTERVAL"].try_cast("int"), F.lit(1))
    n = F.least(F.coalesce(rule["COUNT"].try_cast("int"), F.lit(most)), F.lit(most))
    until = F.try_to_timestamp(F.substring(rule["UNTIL"], 1, 8), F.lit("yyyyMMdd")).cast("timestamp_ntz")
    day = lambda days: start + F.make_dt_interval(days)
    month = lambda months: F.add_months(start.cast("date"), months).cast("timestamp_ntz") + (start - F.date_trunc("day", start).cast("timestamp_ntz"))

    def at(i):
        return F.when(freq == "DAILY", day(i * every)).when(freq == "WEEKLY", day(i * every * 7)).when(freq == "MONTHLY", month(i * every)).when(freq == "YEARLY", month(i * every * 12)).when((freq == "NONE") & (i == 0), start)

    all_ = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), at)
    whole = freq.isin("DAILY", "WEEKLY", "NONE")  # months without the day are skipped
    fits = F.filter(all_, lambda t: (t >= lo) & (t <= hi) & (until.isNull() | (t < until + F.make_dt_interval(F.lit(1)))) & (whole | (F.day(t) == F.day(start))))
    return F.array_min(fits)


def no_busy(spark: SparkSession) -> DataFrame:
    """Adapters that know no busy times."""
    return spark.createDataFrame([], BUSY)


def calendars(listed: DataFrame, components: str) -> DataFrame:
    """Only calendars that can hold events."""
    return listed.where(F.array_contains(components, "VEVENT"))


def imported_event_types(responses: DataFrame, col: str, *keys: str) -> DataFrame:
    """Event types of {"collection": [{"name", "slug", "duration"}]}."""
    kind = "struct<collection:array<struct<name:string,slug:string,duration:int>>>"
    return responses.select(*keys, F.explode(F.from_json(col, kind)["collection"]).alias("c")).select(*keys, F.col("c.name").alias("title"), "c.slug", F.col("c.duration").alias("length"))


class _Calendar(InputPartition):
    def __init__(self, name: str):
        self.name = name


class BusySource(DataSource):
    """Live busy times. Options: calendars (comma-separated ids), from, to; `pull` gives (start, end) pairs of one calendar.

    Subclass it with a `pull` of your own and register it: spark.dataSource.register(MyCalendars). Each calendar is a partition, read and
    retried on its own, so that a calendar that fails does not take others with it if `tolerant` is set.
    """

    pull: Callable[[str, str, str], Iterable[tuple]] = staticmethod(lambda calendar, lo, hi: ())

    @classmethod
    def name(cls) -> str:
        return "busy_times"

    def schema(self) -> str:
        return BUSY

    def reader(self, schema) -> DataSourceReader:
        return _BusyReader(type(self).pull, dict(self.options))


class _BusyReader(DataSourceReader):
    def __init__(self, pull, options):
        self.pull, self.options = pull, options

    def partitions(self):
        return [_Calendar(x) for x in self.options.get("calendars", "").split(",") if x]

    def read(self, partition):
        try:
            rows = list(self.pull(partition.name, self.options.get("from", ""), self.options.get("to", "")))
        except Exception:
            if self.options.get("tolerant", "false") != "true":
                raise
            rows = []
        for start, end in rows:
            yield partition.name, start, end
