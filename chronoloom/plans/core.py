"""Queries of schedules, busy times, slots, bookings, sources and event-driven behaviour, with their SQL (S, K, T, U1, A17, R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import scalars as X
from ..functions import structures as V
from ..operators import calendar as C
from ..operators import conflicts as B
from ..operators import people as P
from ..operators import scheduling as O
from ..session import epoch_s
from ..sources import calendars as K
from ..streaming import bookings as E
from .registry import BOOK, BUSY, FREE, NOW, S, SLOTS, _bookings, _busy, _free, _slots, query
from .values import _ics

# ---------------------------------------------------------------- sources

ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S')"


@query("SELECT 'cal' || user_id AS calendar, date_trunc('second', ts) AS busy_start, date_trunc('second', ts) + INTERVAL 1 HOUR AS busy_end FROM events WHERE user_id IN (1, 2, 3)")
def s7_free_busy(events):
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body = F.to_json(F.struct(F.create_map(F.concat(F.lit("cal"), F.col("user_id")), F.struct(F.array(F.struct(iso(F.col("ts")).alias("start"), iso(D.plus(F.col("ts"), F.lit(1), "hour")).alias("end"))).alias("busy"))).alias("calendars")))
    return K.free_busy(events.select(body.alias("body")), "body", selected=["cal1", "cal2", "cal3"])


@query(f"SELECT event_id, {ISO.format('ts')} || 'Z' AS busy_start, {ISO.format('ts + INTERVAL 30 MINUTE')} || 'Z' AS busy_end FROM events WHERE event_type NOT IN ('click', 'view')")
def s8_calendar_view(events):
    iso = lambda c: F.struct(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias("dateTime"))
    shown = F.when(F.col("event_type") == "click", "free").when(F.col("event_type") == "view", "workingElsewhere").otherwise("busy")
    body = F.to_json(F.struct(F.array(F.struct(shown.alias("showAs"), iso(F.col("ts")).alias("start"), iso(D.plus(F.col("ts"), F.lit(30), "minute")).alias("end"))).alias("value")))
    return K.calendar_view(events.select("event_id", body.alias("body")), "body", "event_id")


@query("SELECT 'u' || o_orderkey AS uid, o_orderpriority AS summary, o_orderdate AS start, o_orderdate + INTERVAL 90 MINUTE AS end_at, CASE WHEN o_orderkey % 2 = 0 THEN 'WEEKLY' ELSE 'NONE' END AS freq FROM orders")
def s9_s10_icalendar(orders):
    folded = F.regexp_replace(_ics(orders), "SUMMARY:(..)", "SUMMARY:$1\r\n ")
    e = orders.select(F.explode(K.calendar_events(folded)).alias("e"))
    return e.select("e.uid", "e.summary", "e.start", F.col("e.end").alias("end_at"), F.col("e.rule")["FREQ"].alias("freq"))


@query("SELECT CAST(NULL AS VARCHAR) AS calendar WHERE false")
def s12_no_busy(region):
    return K.no_busy(region.sparkSession).select("calendar")


@query("SELECT n_name FROM nation WHERE n_nationkey % 2 = 0")
def s13_calendars(nation):
    listed = nation.withColumn("components", F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("VTODO"), F.lit("VEVENT"))).otherwise(F.array(F.lit("VTODO"))))
    return K.calendars(listed, "components").select("n_name")


@query("SELECT p_brand, p_name AS title, lower(replace(p_name, ' ', '-')) AS slug, p_size AS length FROM part")
def s14_imported_event_types(part):
    item = F.struct(F.col("p_name").alias("name"), X.slugify(F.col("p_name")).alias("slug"), F.col("p_size").alias("duration"))
    body = part.groupBy("p_brand").agg(F.to_json(F.struct(F.collect_list(item).alias("collection"))).alias("body"))
    return K.imported_event_types(body, "body", "p_brand")


@query("SELECT page_id, 'u' || page_id AS who, CAST(page_id % 7 AS VARCHAR) AS kind FROM pages")
def s17_url_parameters(pages):
    url = F.concat(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("?user=u"), F.col("page_id"), F.lit("&type="), F.col("page_id") % 7, F.lit("#top"))
    p = V.query_parameters(url)
    return pages.select("page_id", p["user"].alias("who"), p["type"].alias("kind"))


# ---------------------------------------------------------------- busy times and slots


@query(f"SELECT host, start_s AS busy_s, end_s AS busy_e FROM ({BOOK}) WHERE status IN ('ACCEPTED', 'PENDING') AND id % 5 = 2 AND start_s >= 852076800 AND end_s <= 883612800 UNION ALL SELECT host, bs, be FROM ({BUSY})")
def t5_u1_busy_times(orders, events):
    year = orders.where((F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") <= F.lit("1998-01-01").cast("timestamp_ntz")))
    own = _bookings(year).withColumn("event_type", F.col("id") % 5)
    return B.busy_times(own, _busy(events), lo=852076800, hi=883612800, event_type=2)


@query(f"SELECT host, bs - 900 AS busy_s, be + 900 AS busy_e FROM ({BUSY})")
def t6_buffered(events):
    return B.buffered(_busy(events), F.lit(15))


LAST = f"SELECT host, max(s) + 1800 AS f FROM ({SLOTS}) GROUP BY host"


@query(f"SELECT s.host AS host, s.s AS slot_s FROM ({SLOTS}) s JOIN ({LAST}) l ON l.host = s.host WHERE s.s + 1800 + 1200 <= f AND NOT EXISTS (SELECT 1 FROM ({BUSY}) b WHERE b.host = s.host AND ((s.s >= bs AND s.s < be) OR (s.s + 1800 > bs AND s.s + 1800 < be) OR (bs > s.s AND bs < s.s + 1800) OR (s.s - 600 > bs - 600 AND s.s - 600 < be + 1200) OR (s.s + 3000 > bs - 600 AND s.s + 3000 < be + 1200)))")
def t8_slots_with_buffers(events):
    return B.remove_conflicts(_slots(events), _busy(events), ["host"], length=30, before=10, after=20).select("host", "slot_s")


@query(f"SELECT host, CAST(max(s) + 1800 AS BIGINT) AS last_end FROM ({SLOTS}) GROUP BY host")
def a17_last_end(events):
    return _slots(events).groupBy("host").agg((F.max("slot_s") + 1800).alias("last_end"))


@query("SELECT p_partkey, CAST(CASE WHEN p_size % 3 = 0 THEN p_size WHEN p_size % 3 = 1 THEN 15 ELSE p_size END AS INTEGER) AS step FROM part")
def t9_slot_step(part):
    given = F.when(F.col("p_size") % 3 == 0, 0).when(F.col("p_size") % 3 == 1, 15)
    return part.select("p_partkey", C.slot_step(given, F.col("p_size")).cast("int").alias("step"))


@query("SELECT c_custkey AS event_type, CASE WHEN c_custkey % 3 = 0 THEN 'Z-own' WHEN c_custkey % 3 = 1 THEN 'E' ELSE 'U' END AS zone, CASE WHEN c_custkey % 3 = 0 THEN 480 WHEN c_custkey % 3 = 1 THEN 600 ELSE 720 END AS start_min FROM customer")
def t4_schedule_resolution(customer):
    k = F.col("c_custkey")
    null = lambda t: F.lit(None).cast(t)
    event_types = customer.select(k.alias("event_type"), k.alias("user"), F.when(k % 3 == 0, k).alias("schedule"), F.when(k % 3 == 1, "E").alias("zone"))
    schedules = customer.where("c_custkey % 3 = 0").select(k.alias("schedule"), (k + 1000000).alias("user"), F.lit("Z-own").alias("zone"))
    row = lambda df, col, at: df.select(*[(k if c == col else null("long")).alias(c) for c in ("schedule", "event_type", "user")], F.sequence(F.lit(1), F.lit(5)).alias("days"), F.lit(at).alias("start_min"), F.lit(1020).alias("end_min"))
    availability = row(customer.where("c_custkey % 3 = 0"), "schedule", 480).unionByName(row(customer.where("c_custkey % 3 = 1"), "event_type", 600)).unionByName(row(customer, "user", 720))
    users = customer.select(k.alias("user"), null("long").alias("default_schedule"), F.lit("U").alias("zone"))
    out = O.resolve_schedule(event_types, schedules, availability, users)
    return out.select("event_type", "zone", F.element_at("hours", 1)["start_min"].alias("start_min"))


@query("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY d) - 1 AS INTEGER) AS occurrence, d AS occurs FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(CAST(o_orderdate AS DATE) + i * INTERVAL 1 MONTH AS DATE) AS d FROM orders, (SELECT CAST(unnest(range(0, 12)) AS INTEGER) AS i)) WHERE day(d) = day(s) QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY d) <= 4")
def t12_monthly_recurrence(orders):
    o = orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("start"), F.lit(1).alias("freq"), F.lit(1).alias("every"), F.lit(4).alias("count"))
    return C.expand_recurrence(o, "start", "freq", "every", "count").select("o_orderkey", F.col("occurrence").cast("int").alias("occurrence"), "occurs")


@query("SELECT o_orderkey, min(o_orderdate + CAST(i * 14 AS INTEGER) * INTERVAL 1 DAY) AS first FROM orders, (SELECT unnest(range(0, 10)) AS i) WHERE (o_orderkey % 2 = 0 OR i = 0) AND o_orderdate + CAST(i * 14 AS INTEGER) * INTERVAL 1 DAY BETWEEN TIMESTAMP '1997-06-01' AND TIMESTAMP '1997-12-31' GROUP BY o_orderkey")
def t13_first_occurrence(orders):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    e = orders.select("o_orderkey", F.explode(K.calendar_events(_ics(orders))).alias("e"))
    e = e.select("o_orderkey", K.first_occurrence(F.col("e.start"), F.col("e.rule"), at("1997-06-01"), at("1997-12-31")).alias("first"))
    return e.where(F.col("first").isNotNull())


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) > DATE '1998-01-14' AS rolling_out, false AS unlimited_out FROM orders")
def t14_business_days(orders):
    d, day = F.col("o_orderdate").cast("date"), lambda x: F.lit(x).cast("date")
    out = lambda kind: C.out_of_bounds(d, F.lit(kind), F.lit(9), F.lit(False), day(None), day(None), day("1998-01-01"))
    return orders.select("o_orderkey", out("ROLLING").alias("rolling_out"), out("UNLIMITED").alias("unlimited_out"))


@query(f"SELECT h.host AS host, d.day AS day, d.day < DATE '2024-01-05' OR d.day > DATE '2024-01-25' OR NOT EXISTS (SELECT 1 FROM ({FREE}) f WHERE f.host = h.host AND f.day = d.day) AS disabled, CAST(1 AS INTEGER) AS blank FROM (SELECT DISTINCT user_id AS host FROM events) h, (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) d")
def t16_disabled_days(events):
    grid = _slots(events).select("host", "day").distinct()
    day = lambda x: F.lit(x).cast("date")
    return O.disabled_days(grid, _free(events), ["host"], first=day("2024-01-05"), last=day("2024-01-25"))


@query("SELECT event_id, CAST(ts AS DATE) < DATE '2024-01-15' AS past FROM events")
def t18_past_by_day(events):
    return events.select("event_id", O.is_past(F.col("ts"), F.lit("2024-01-15 10:00:00").cast("timestamp_ntz")).alias("past"))


@query(f"SELECT host, s AS slot_s FROM (SELECT h.host, epoch_day * 86400 + m * 60 AS s FROM (SELECT DISTINCT user_id AS host FROM events) h, (SELECT DISTINCT CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS BIGINT) AS epoch_day FROM events) d, (SELECT unnest(range(600, 661, 60)) AS m) g) s WHERE NOT EXISTS (SELECT 1 FROM ({BUSY}) b WHERE b.host = s.host AND ((s.s >= bs AND s.s < be) OR (s.s + 3600 > bs AND s.s + 3600 < be) OR (bs > s.s AND bs < s.s + 3600)))")
def t20_member_slots(events):
    days = events.select(F.col("ts").cast("date").alias("day")).distinct()
    hours = F.array(F.struct(F.sequence(F.lit(0), F.lit(6)).alias("days"), F.lit(600).alias("start_min"), F.lit(719).alias("end_min")))
    members = events.select(F.col("user_id").alias("host")).distinct().crossJoin(F.broadcast(days))  # a calendar: members x days is the result's own size
    grid = members.withColumns({"offset_min": F.lit(0), "hours": hours})
    return O.member_slots(grid, _busy(events), ["host"], now_s=F.lit(0).cast("bigint"), length=60).select("host", "slot_s")


@query("SELECT o_orderkey, sha256(CAST(o_orderkey AS VARCHAR)) AS recurring, o_orderdate + CAST(i AS INTEGER) * INTERVAL 7 DAY AS start, o_orderdate + CAST(i AS INTEGER) * INTERVAL 7 DAY + INTERVAL 45 MINUTE AS end_at, i = 0 AS mail FROM orders, (SELECT unnest(range(0, 3)) AS i)")
def t21_recurring_bookings(orders):
    dates = F.transform(F.array(F.lit(2), F.lit(0), F.lit(1)), lambda i: F.col("o_orderdate") + F.make_dt_interval(i * 7))
    r = orders.select("o_orderkey", dates.alias("dates"), F.lit(45).alias("length"))
    return O.recurring_bookings(r, "dates", "length", "o_orderkey").select("o_orderkey", "recurring", "start", F.col("end").alias("end_at"), "mail")


# ---------------------------------------------------------------- sinks


@query("SELECT o_orderkey AS booking, 'c' || o_custkey AS email FROM orders UNION ALL SELECT o_orderkey, o_orderpriority FROM orders")
def k1_nested_insert(orders):
    a = F.array(F.struct(F.concat(F.lit("c"), F.col("o_custkey")).alias("email")), F.struct(F.col("o_orderpriority").alias("email")))
    new = orders.select(F.col("o_orderkey").alias("id"), a.alias("attendees"))
    old, kids = new.select("id").where("false"), new.select(F.col("id").alias("booking"), F.lit("").alias("email")).where("false")
    return O.insert_with_children(old, kids, new, "attendees", "id", "booking")[1]


@query("""SELECT 'POST' AS method, 'cal' || o_custkey AS target, '{"id":' || o_orderkey || '}' AS body FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'DELETE', 'cal' || o_custkey, NULL FROM orders WHERE o_orderstatus = 'F'""")
def k4_k5_commands(orders):
    target, body = F.concat(F.lit("cal"), F.col("o_custkey")), F.to_json(F.struct(F.col("o_orderkey").alias("id")))
    return O.commands(orders.where("o_orderstatus = 'O'"), "create", target, body).unionByName(O.commands(orders.where("o_orderstatus = 'F'"), "delete", target, body))


@query("SELECT p_partkey AS id, CAST(floor(p_retailprice) AS BIGINT) AS amount, CAST(floor(p_retailprice * 0.029 + 30 + 0.5) AS BIGINT) AS fee, 'usd' AS currency, false AS success, false AS refunded FROM part")
def k8_payments(part):
    return O.payments(part.withColumn("id", F.col("p_partkey")), F.floor("p_retailprice").cast("bigint"), X.fee(F.col("p_retailprice"), 0.029, 30).cast("bigint"))


@query("SELECT o_orderkey AS id, 'a' || o_custkey AS \"to\", 'attendee' AS role FROM orders UNION ALL SELECT o_orderkey, o_orderpriority, 'attendee' FROM orders UNION ALL SELECT o_orderkey, o_orderstatus, 'organizer' FROM orders".replace('AS "to"', "AS to_"))
def k10_mails(orders):
    b = orders.select(F.col("o_orderkey").alias("id"), F.array(F.concat(F.lit("a"), F.col("o_custkey")), F.col("o_orderpriority")).alias("guests"), "o_orderstatus")
    return O.mails(b, "guests", "o_orderstatus").withColumnRenamed("to", "to_")


# ---------------------------------------------------------------- event-driven behaviour


@query("SELECT event_id AS id, event_type AS trigger, 'https://all/' || user_id AS url FROM events WHERE event_type IN ('click', 'purchase') UNION ALL SELECT event_id, event_type, 'https://one/' || event_id % 10 FROM events WHERE event_type = 'click' AND event_id % 10 < 3")
def r1_notifications(events):
    e = events.select(F.col("event_id").alias("id"), F.col("event_type").alias("trigger"), F.col("user_id").alias("user"), (F.col("event_id") % 10).alias("event_type"))
    null = F.lit(None).cast("long")
    all_ = events.select(F.col("user_id").alias("user")).distinct().select(F.concat(F.lit("https://all/"), F.col("user")).alias("url"), "user", null.alias("event_type"), F.array(F.lit("click"), F.lit("purchase")).alias("triggers"), F.lit(True).alias("active"))
    one = e.select("event_type").distinct().select(F.concat(F.lit("https://one/"), F.col("event_type")).alias("url"), null.alias("user"), "event_type", F.array(F.lit("click")).alias("triggers"), (F.col("event_type") < 3).alias("active"))
    return E.notifications(e, all_.unionByName(one))


@query("SELECT o_orderkey, o_orderkey % 4 = 0 AS paid FROM orders")
def r2_payments_settled(orders):
    b = orders.select(F.col("o_orderkey").alias("id"), F.lit(False).alias("paid"))
    p = orders.select(F.col("o_orderkey").alias("booking"), F.concat(F.lit("pi_"), F.col("o_orderkey")).alias("external"), F.lit(False).alias("success"))
    booked, _ = O.settle(b, p, p.where("booking % 4 = 0").select("external"))
    return booked.select(F.col("id").alias("o_orderkey"), "paid")


@query("SELECT event_id FROM events WHERE (user_id, CAST(ts AS DATE)) IN (SELECT user_id, CAST(ts AS DATE) FROM events WHERE value < 20)")
def r3_tired_hosts(events):
    day = F.col("ts").cast("date").alias("day")
    scores = events.select(F.col("user_id").alias("host"), day, (F.col("value") * 3600).alias("seconds"))
    return O.tired(scores, events.select("event_id", F.col("user_id").alias("host"), day), 20.0).select("event_id")


@query("SELECT DISTINCT user_id AS id, CAST(CASE WHEN event_id % 2 = 0 THEN 180 ELSE 1440 END AS INTEGER) AS elapsed FROM events")
def r5_reminded_once(events):
    sent = events.select(F.col("user_id").alias("id"), F.when(F.col("event_id") % 2 == 0, 180).otherwise(1440).alias("elapsed"), F.col("ts").alias("at"))
    return E.once(sent, "id", "elapsed").select("id", "elapsed")


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def r_ext_per_day(events):
    w = E.per_window(events.select(F.col("ts").cast("timestamp").alias("at"), "event_type"), "event_type")
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query(f"SELECT id FROM ({BOOK}) WHERE id > 100 ORDER BY id LIMIT 10")
def r7_next_page(orders):
    return E.newer(_bookings(orders).select("id"), 100, "id", 10)
