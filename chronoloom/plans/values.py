"""Queries of the scalar functions, with their SQL (X, F10, F15, F19, F20, F23; K2, K3, K6, K7; D4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import scalars as X
from ..functions import structures as T
from ..operators import records as R
from ..session import epoch_s
from .registry import S, query

WORDS = "string_split(p_name, ' ')"


@query(f"SELECT p_partkey, array_to_string({WORDS}, ', ') AS group_name, CASE WHEN len({WORDS}) = 1 THEN {WORDS}[1] ELSE array_to_string({WORDS}[1:-2], ', ') || ' & ' || {WORDS}[-1] END AS event_slug FROM part")
def x3_x4_group_names(part):
    names = F.split("p_name", " ")
    return part.select("p_partkey", X.group_name(names).alias("group_name"), X.dynamic_event_name(names, F.col("p_type")).alias("event_slug"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_type || ' between ' || p_brand || ' and ' || p_name WHEN p_size % 3 = 1 THEN 'Meet ' || p_name || ' now' ELSE 'Plain' END AS title FROM part")
def x6_event_name(part):
    n = F.col("p_size") % 3
    return part.select("p_partkey", X.event_name(F.when(n == 0, "").when(n == 1, "Meet {USER} now").otherwise("Plain"), F.col("p_type"), F.col("p_brand"), F.col("p_name")).alias("title"))


@query("SELECT c_custkey, lower(c_name) || '@x.org' AS email, c_custkey % 2 = 0 AS valid, 'Segment ' || c_mktsegment AS label FROM customer")
def x7_x8_x10_texts(customer):
    mail = T.lower_email(F.concat(F.lit(" "), F.col("c_name"), F.lit("@X.org ")))
    return customer.select("c_custkey", mail.alias("email"), X.is_email(F.when(F.col("c_custkey") % 2 == 0, mail).otherwise(F.concat(F.lit("no "), mail))).alias("valid"), X.location_label(F.concat(F.lit("in:segment "), F.col("c_mktsegment"))).alias("label"))


@query(r"SELECT p_partkey, 'What:' || chr(10) || p_name || chr(10) || chr(10) || 'Who:' || chr(10) || p_brand || chr(10) || p_type || CASE WHEN p_size % 2 = 0 THEN chr(10) || chr(10) || 'Notes:' || chr(10) || p_size ELSE '' END AS body, replace(p_type, '_', '') || 'video' AS app FROM part")
def x11_x12_description(part):
    notes = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string"))
    return part.select("p_partkey", T.description(F.col("p_name"), F.lit(None).cast("string"), F.array("p_brand", "p_type"), F.lit(""), notes).alias("body"), X.app_name(F.concat("p_type", F.lit("_video"))).alias("app"))


@query("SELECT count(*) AS n, CAST(64 AS INTEGER) AS len FROM region")
def x13_random_tokens(region):
    t = region.select(T.random_token().alias("t"))
    return t.agg(F.count_distinct("t").alias("n"), F.max(F.length("t")).alias("len"))


UUID_HEX = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || CAST(url AS BLOB))"


@query(f"SELECT page_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', CAST((instr('0123456789abcdef', h[17:17]) - 1) % 4 AS INTEGER) + 1, 1) || h[18:20] || '-' || h[21:32] AS uid FROM (SELECT page_id, {UUID_HEX} AS h FROM pages)")
def x15_name_uuid(pages):
    return pages.select("page_id", X.name_uuid_v5("6ba7b8119dad11d180b400c04fd430c8", F.col("url")).alias("uid"))


@query("SELECT c_custkey, c_name[10:] AS rest, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS meta, c_mktsegment AS segment FROM customer")
def x16_x17_prefixes(customer):
    meta = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("metadata["), F.col("c_mktsegment"), F.lit("]"))).otherwise("other")
    return customer.select("c_custkey", T.strip_prefix(F.col("c_name"), "Customer#").alias("rest"), T.metadata_key(meta).alias("meta"), R.checked_domain(F.lower("c_mktsegment"), "AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY").alias("segment"))


@query("SELECT event_id, ts + INTERVAL 90 MINUTE AS later, ts - INTERVAL 14 DAY AS earlier, CAST(ts AS DATE) < DATE '2024-01-10' AS before_day, date_trunc('hour', ts) > TIMESTAMP '2024-01-10 05:00:00' AS after_hour, ts > TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-08' AS within FROM events")
def x20_x22_x23_dates(events):
    t, at = F.col("ts"), lambda s: F.lit(s).cast("timestamp_ntz")
    ntz = lambda c: c.cast("timestamp_ntz")
    return events.select("event_id", ntz(D.plus(t, F.lit(90), "minute")).alias("later"), ntz(D.plus(t, F.lit(-2), "week")).alias("earlier"), D.is_before(t, at("2024-01-10"), "day").alias("before_day"), D.is_after(t, at("2024-01-10 05:30:00"), "hour").alias("after_hour"), D.is_between(t, at("2024-01-05"), at("2024-01-08"), "()").alias("within"))


@query(f"SELECT event_id, CAST(z AS INTEGER) AS offset_min, {S.format('ts')} + z * 60 AS local_s, {S.format('ts')} AS back_s FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 330 ELSE -300 END AS z FROM events)")
def x26_x27_zones(events):
    zone = F.when(F.col("event_id") % 3 == 0, "UTC").when(F.col("event_id") % 3 == 1, "Asia/Kolkata").otherwise("America/New_York")
    local = D.in_zone(F.col("ts"), zone)
    return events.select("event_id", D.offset_minutes(zone, F.col("ts")).alias("offset_min"), epoch_s(local).alias("local_s"), epoch_s(D.to_utc(local, zone)).alias("back_s"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:00' AS text, CAST(120 AS INTEGER) AS offset_min FROM events")
def x30_offset_kept(events):
    p = D.parse_zone(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
    return events.select("event_id", D.format_zone(p).alias("text"), p["offset_min"].alias("offset_min"))


@query("SELECT event_id, strftime(ts, '%H:%M') AS h24, lower(strftime(ts, '%-I:%M%p')) AS h12, strftime(ts, '%A, %-d %B') AS day, strftime(ts, '%A') AS name, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso FROM events")
def x31_x33_x35_formats(events):
    t = F.col("ts")
    return events.select("event_id", D.clock24(t).alias("h24"), D.clock12(t).alias("h12"), D.long_day(t).alias("day"), D.weekday_name(X.weekday(t)).alias("name"), X.iso_ms(t).alias("iso"))


@query(f"SELECT event_id, CAST(({S.format('ts')} - 1704067200) // 60 AS BIGINT) AS minutes, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS of_day FROM events")
def x34_x36_minutes(events):
    return events.select("event_id", D.minutes_between(F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts")).alias("minutes"), D.text_to_minutes(D.clock24(F.col("ts"))).alias("of_day"))


@query("SELECT o_orderkey, CAST(d AS DATE) AS due FROM (SELECT o_orderkey, o_orderdate AS s, unnest(range(0, 15)) AS i FROM orders) t, LATERAL (SELECT s + i * INTERVAL 1 DAY AS d) WHERE isodow(d) < 6 QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY d) = 6 + CASE WHEN isodow(s) < 6 THEN 0 ELSE -1 END")
def x29_business_days(orders):
    return orders.select("o_orderkey", X.business_days_add(F.col("o_orderdate").cast("date"), F.lit(5)).alias("due"))


@query("SELECT event_id, value / 3600 AS hours, CAST(floor(value) AS BIGINT) // 7 AS whole, CAST(floor(value) AS BIGINT) % 7 AS rest FROM events")
def x42_x43_numbers(events):
    w = T.whole_and_rest(F.floor("value"), 7)
    return events.select("event_id", T.hours(F.col("value")).alias("hours"), w["whole"].alias("whole"), w["rest"].alias("rest"))


@query(f"SELECT p_partkey, array_to_string(list_reverse({WORDS}) || [p_brand], '|') AS listed, list_contains({WORDS}, 'widget') AS has, {WORDS}[1] AS head, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END AS one FROM part")
def x44_x45_arrays(part):
    w = F.split("p_name", " ")
    listed = F.flatten(F.array(F.reverse(w), X.ensure_array(F.col("p_brand"))))
    return part.select("p_partkey", F.array_join(listed, "|").alias("listed"), F.array_contains(w, "widget").alias("has"), F.element_at(F.slice(w, 1, 1), 1).alias("head"), F.array_join(X.ensure_array(F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))), ",").alias("one"))


@query("SELECT p_partkey, 'a=' || p_type || ';b=' || p_size || ';c=' || p_brand AS merged, 'a=' || p_name || ';b=' || p_size AS cut FROM part")
def x46_x47_x51_maps(part):
    m = lambda *kv: F.create_map(*[x for k, v in kv for x in (F.lit(k), v.cast("string"))])
    a, b = m(("b", F.col("p_size")), ("a", F.col("p_name"))), m(("a", F.col("p_type")), ("c", F.col("p_brand")))
    text = lambda x: F.array_join(F.transform(T.entries(x), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return part.select("p_partkey", text(T.merged(a, b)).alias("merged"), text(T.without_key(a, "z")).alias("cut"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id % 2 = 0 AS is_json, CAST(json_extract_string(props, '$.k') AS INTEGER) AS lead FROM events")
def x48_x49_x50_json(events):
    k = T.json_get(F.col("props"), "$.k", "bigint")
    return events.select("event_id", k.alias("k"), T.tolerant_json(F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise("{no json")).alias("is_json"), T.leading_int(F.concat(k.cast("string"), F.lit("px"))).alias("lead"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_name END AS a, p_brand AS b FROM part")
def x52_deep_merge(part):
    left = F.struct(F.col("p_name").alias("a"), F.col("p_brand").alias("b"))
    right = F.struct(F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("a"), F.lit(None).cast("string").alias("b"))
    return part.select("p_partkey", T.deep_merged(left, right, ("a", "b")).alias("m")).select("p_partkey", "m.a", "m.b")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) = 7 AS same FROM events")
def f15_json_equality(events):
    return events.select("event_id", T.json_equal(F.col("props"), F.lit('{ "k" :7}')).alias("same"))


@query("SELECT c_custkey, c_name LIKE '%5' AS ends, c_name LIKE 'Customer%' AS starts, c_mktsegment LIKE '%OLD%' AS has, c_custkey % 10 <> 0 AS filled, coalesce(nullif(CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END, ''), c_name) AS shown FROM customer")
def f19_f20_f23_falsy(customer):
    seg = F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_mktsegment"))
    return customer.select("c_custkey", F.endswith("c_name", F.lit("5")).alias("ends"), F.startswith("c_name", F.lit("Customer")).alias("starts"), F.contains("c_mktsegment", F.lit("OLD")).alias("has"), R.not_empty(F.col("c_custkey") % 10).alias("filled"), F.coalesce(X.truthy(seg), "c_name").alias("shown"))


@query("""SELECT event_id, '{"triggerEvent":"CREATED","createdAt":"' || strftime(ts, '%Y-%m-%d') || '","payload":{"type":"' || event_type || '","host":' || user_id || '}}' AS body, CASE WHEN event_id % 3 = 1 THEN 'application/x-www-form-urlencoded' ELSE 'application/json' END AS kind FROM events""")
def k2_payload(events):
    body = T.payload_json(F.lit("CREATED"), F.date_format("ts", "yyyy-MM-dd"), F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("host")))
    template = F.when(F.col("event_id") % 3 == 1, "a={{x}}&b=2").when(F.col("event_id") % 3 == 2, '{"a": 1}')
    return events.select("event_id", body.alias("body"), T.content_type(template).alias("kind"))


@query("SELECT event_id, 'Dear ' || user_id || ', ' || event_type || ' for ' || user_id || ' ' AS text FROM events")
def k3_d4_templates(events):
    return events.select("event_id", X.render(F.lit("Dear {{host}}, {{kind}} for {{host}} {{none}}"), host=F.col("user_id"), kind=F.col("event_type"), none=F.lit(None)).alias("text"))


ICS = "'BEGIN:VCALENDAR' || n || 'VERSION:2.0' || n || {0}'BEGIN:VEVENT' || n || 'UID:u' || o_orderkey || n || 'DTSTART:' || strftime(o_orderdate, '%Y%m%dT%H%M%SZ') || n || 'DTEND:' || strftime(o_orderdate + INTERVAL 90 MINUTE, '%Y%m%dT%H%M%SZ') || n || 'SUMMARY:' || o_orderpriority || n || 'ATTENDEE:mailto:c' || o_custkey || n || CASE WHEN o_orderkey % 2 = 0 THEN 'RRULE:FREQ=WEEKLY;INTERVAL=2;COUNT=10' || n ELSE '' END || 'END:VEVENT' || n || 'END:VCALENDAR' || n"


def _ics(orders, method=None):
    end = D.plus(F.col("o_orderdate"), F.lit(90), "minute")
    rule = X.ics_rule(F.lit(2), F.lit(2), F.when(F.col("o_orderkey") % 2 == 0, 10))
    return X.ics_event(F.concat(F.lit("u"), F.col("o_orderkey")), F.col("o_orderdate"), end, F.col("o_orderpriority"), F.array(F.concat(F.lit("c"), F.col("o_custkey"))), rule, method)


@query(f"SELECT o_orderkey, {ICS.format(chr(39) + 'METHOD:REQUEST' + chr(39) + ' || n || ')} AS mail, {ICS.format('')} AS object, CAST(1 AS INTEGER) AS hours, CAST(30 AS INTEGER) AS minutes FROM (SELECT *, chr(13) || chr(10) AS n FROM orders)")
def k6_k7_icalendar(orders):
    d = X.ics_duration(F.col("o_orderdate"), D.plus(F.col("o_orderdate"), F.lit(90), "minute"))
    mail = _ics(orders, "REQUEST")
    return orders.select("o_orderkey", mail.alias("mail"), X.without_method(mail).alias("object"), d["hours"].alias("hours"), d["minutes"].alias("minutes"))
