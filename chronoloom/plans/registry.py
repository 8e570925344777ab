"""The queries of this library by name, and the SQL that gives the same rows.

The tables stand in for the scheduling model: orders for bookings, events for busy intervals (user = host), lineitem
for child rows, customer/nation/region for people and teams, supplier for hosts, part for event types.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import calendar as C
from ..operators import conflicts as B
from ..operators import people as P
from ..session import epoch_s, load

QUERIES: dict = {}
SQL: dict = {}
MODULE_OF: dict = {}


def query(sql: str | None = None, **tables):
    """Register a function over named tables under its own name."""

    def deco(f):
        names = f.__code__.co_varnames[: f.__code__.co_argcount]
        MODULE_OF[f.__name__] = f.__module__.rpartition(".")[2]
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[load(spark, sf_dir, n) for n in names])
        if sql:
            SQL[f.__name__] = sql
        return f

    return deco


def queries() -> dict:
    from . import core, relations, values  # noqa: F401, they register their own

    return QUERIES


def oracle_sql() -> dict:
    queries()
    return SQL


S = "CAST(floor(epoch({0})) AS BIGINT)"
BUSY = "SELECT user_id AS host, CAST(floor(epoch(ts)) AS BIGINT) AS bs, CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(value * 60) AS BIGINT) AS be FROM events"
SLOTS = "SELECT h.host, d.day, epoch_day * 86400 + m * 60 AS s FROM (SELECT DISTINCT user_id AS host FROM events) h, (SELECT DISTINCT CAST(ts AS DATE) AS day, CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS BIGINT) AS epoch_day FROM events) d, (SELECT unnest(range(540, 991, 30)) AS m) g"
FREE = f"SELECT * FROM ({SLOTS}) s WHERE NOT EXISTS (SELECT 1 FROM ({BUSY}) b WHERE b.host = s.host AND ((s.s >= bs AND s.s < be) OR (s.s + 1800 > bs AND s.s + 1800 < be) OR (bs > s.s AND bs < s.s + 1800)))"


def _busy(events):
    s = epoch_s(F.col("ts"))
    return events.select(F.col("user_id").alias("host"), s.alias("busy_s"), (s + F.floor(F.col("value") * 60)).alias("busy_e"))


def _slots(events):
    days = events.select(F.col("ts").cast("date").alias("day")).distinct()
    hosts = events.select(F.col("user_id").alias("host")).distinct()
    hours = F.array(F.struct(F.sequence(F.lit(0), F.lit(6)).alias("days"), F.lit(540).alias("start_min"), F.lit(1019).alias("end_min")))
    grid = hosts.crossJoin(F.broadcast(days)).withColumns({"offset_min": F.lit(0), "hours": hours, "freq": F.lit(30), "length": F.lit(30), "notice": F.lit(0)})  # a calendar: hosts x days is the result's own size
    return C.slots(grid, ["host"], now_s=F.lit(0).cast("bigint"))


def _free(events):
    return B.remove_conflicts(_slots(events), _busy(events), ["host"], length=30)


# ---------------------------------------------------------------- sources, projections, filters


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O'")
def s1_scan(orders):
    return orders.where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def s2_unique_lookup(orders):
    return orders.where("o_orderkey = 7").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 1")
def s3_first_match(orders):
    return orders.where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey").orderBy("o_orderkey").limit(1)


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 8 AND l_suppkey > 0")
def s5_composite_lookup(lineitem):
    return lineitem.where("l_orderkey = 8 AND l_suppkey > 0").select("l_orderkey", "l_linenumber", "l_quantity")


@query(f"SELECT host, bs AS busy_s, be AS busy_e FROM ({BUSY})")
def s11_duration_to_interval(events):
    return _busy(events)


@query("SELECT x AS length, 'min-' || x AS slug, x = 15 AS is_default FROM (VALUES (15), (30), (60)) t(x)")
def s16_builtin_events(region):
    rows = region.limit(1).select(F.explode(F.array(F.lit(15), F.lit(30), F.lit(60))).alias("length"))
    return rows.select("length", F.concat(F.lit("min-"), F.col("length")).alias("slug"), (F.col("length") == 15).alias("is_default"))


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O' OR o_totalprice > 200000) AND NOT o_orderpriority = '1-URGENT'")
def f5_and_or_not(orders):
    return orders.where(((F.col("o_orderstatus") == "O") | (F.col("o_totalprice") > 200000)) & ~(F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND o_orderstatus IN ('O', 'P') AND o_orderpriority NOT IN ('5-LOW')")
def f6_f7_ranges_and_lists(orders):
    d = F.col("o_orderdate")
    return orders.where((d >= F.lit("1997-01-01").cast("timestamp_ntz")) & (d < F.lit("1998-01-01").cast("timestamp_ntz")) & F.col("o_orderstatus").isin("O", "P") & ~F.col("o_orderpriority").isin("5-LOW")).select("o_orderkey")


@query("SELECT event_id, nullif(event_type, 'click') IS DISTINCT FROM 'view' AS other FROM events")
def f9_null_aware_inequality(events):
    return events.select("event_id", (~F.nullif(F.col("event_type"), F.lit("click")).eqNullSafe(F.lit("view"))).alias("other"))


@query("SELECT c_custkey FROM customer WHERE (c_mktsegment = 'BUILDING' AND c_acctbal < 0) OR c_acctbal > 9000 OR nullif(c_mktsegment, 'MACHINERY') IS NULL")
def f11_f12_validity(customer):
    return customer.where(((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") < 0)) | (F.col("c_acctbal") > 9000) | F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY")).isNull()).select("c_custkey")


@query("SELECT user_id, list_sort(list_distinct(list(event_type))) AS kinds_list, list_contains(list(event_type), 'purchase') AS has_purchase FROM events GROUP BY user_id".replace("list_sort(list_distinct(list(event_type))) AS kinds_list, ", ""))
def f13_array_has(events):
    return events.groupBy("user_id").agg(F.array_contains(F.collect_set("event_type"), "purchase").alias("has_purchase"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50")
def f14_json_path(events):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events.where(k > 50).select("event_id", k.alias("k"))


@query(f"SELECT event_id FROM events WHERE {S.format('ts')} >= 1704326400 AND {S.format('ts')} + CAST(floor(value * 60) AS BIGINT) <= 1705190400")
def f16_containment(events):
    s, day = epoch_s(F.col("ts")), lambda d: F.lit(d).cast("timestamp_ntz")
    few = events.where((F.col("ts") >= day("2024-01-04")) & (F.col("ts") <= day("2024-01-14")))  # on the stored column, so that it reaches the scan
    return few.where(B.contained(s, s + F.floor(F.col("value") * 60), 1704326400, 1705190400)).select("event_id")


@query("SELECT event_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15'")
def f17_same_day(events):
    return B.on_day(events, "ts", "2024-01-15").select("event_id")


NOW = 883612800  # 1998-01-01
BOOK = f"SELECT o_orderkey AS id, o_custkey AS host, {S.format('o_orderdate')} AS start_s, {S.format('o_orderdate')} + 1800 AS end_s, CASE o_orderstatus WHEN 'F' THEN 'ACCEPTED' WHEN 'O' THEN 'PENDING' ELSE 'CANCELLED' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS recurring FROM orders"


def _bookings(orders):
    s = epoch_s(F.col("o_orderdate"))
    status = F.when(F.col("o_orderstatus") == "F", "ACCEPTED").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("CANCELLED")
    return orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("host"), s.alias("start_s"), (s + 1800).alias("end_s"), status.alias("status"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("recurring"))


def _of_kind(orders, kind):
    """The stored columns' own bounds, so that they reach the scan."""
    first = F.lit("1997-12-31 23:30:00").cast("timestamp_ntz")
    o = F.col("o_orderdate")
    return orders.where({"past": o <= first, "cancelled": ~F.col("o_orderstatus").isin("F", "O")}.get(kind, o >= first))


for _kind, _where in (("upcoming", f"end_s >= {NOW} AND status NOT IN ('CANCELLED', 'REJECTED')"), ("recurring", f"end_s >= {NOW} AND status NOT IN ('CANCELLED', 'REJECTED') AND recurring IS NOT NULL"), ("past", f"end_s <= {NOW} AND status NOT IN ('CANCELLED', 'REJECTED')"), ("cancelled", "status IN ('CANCELLED', 'REJECTED')")):
    QUERIES[f"f18_{_kind}"] = lambda spark, sf, kind=_kind: P.list_bookings(_bookings(_of_kind(load(spark, sf, "orders"), kind)), kind, NOW).select("id", "start_s", "status")
    SQL[f"f18_{_kind}"] = f"SELECT id, start_s, status FROM ({BOOK}) WHERE {_where}"


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'INVITEE' ELSE c_mktsegment END AS role, c_acctbal < 0 AND c_mktsegment <> 'BUILDING' AS hide FROM customer")
def f24_f25_conditional_columns(customer):
    low = F.col("c_acctbal") < 0
    return customer.select("c_custkey", F.when(low, "INVITEE").otherwise(F.col("c_mktsegment")).alias("role"), (low & (F.col("c_mktsegment") != "BUILDING")).alias("hide"))


# ---------------------------------------------------------------- joins


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j1_j25_nested_select(customer, nation, region):
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", "n_name", "r_name")


@query("SELECT o_orderkey, count(l_orderkey) AS n_lines, coalesce(string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber), '') AS line_numbers FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def j2_nest_many(orders, lineitem):
    n = P.nest_many(orders.select(F.col("o_orderkey").alias("k")), lineitem.select(F.col("l_orderkey").alias("k"), "l_linenumber"), "k", "kids", "l_linenumber")
    return n.select(F.col("k").alias("o_orderkey"), F.size("kids").cast("bigint").alias("n_lines"), F.array_join(F.transform("kids", lambda x: x["l_linenumber"].cast("string")), ",").alias("line_numbers"))


@query("SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey")
def j3_many_to_many(lineitem, part):
    return lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_brand").distinct()


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def j4_some(orders, lineitem):
    return P.some(orders, lineitem, F.col("l_orderkey") == F.col("o_orderkey"), F.col("l_returnflag") == "R").select("o_orderkey")


@query("SELECT r_regionkey FROM region WHERE EXISTS (SELECT 1 FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey AND c_acctbal > 9900)")
def j5_some_over_two_hops(region, nation, customer):
    rich = nation.join(customer.where("c_acctbal > 9900"), F.col("c_nationkey") == F.col("n_nationkey"))
    return P.some(region, rich, F.col("n_regionkey") == F.col("r_regionkey")).select("r_regionkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 11 OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey = 3) OR EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_nationkey = 5)")
def j6_disjunctive_semi_join(orders, lineitem, customer):
    mine = orders.where("o_custkey = 11").select("o_orderkey")
    lines = lineitem.where("l_suppkey = 3").select(F.col("l_orderkey").alias("o_orderkey"))
    team = orders.join(customer.where("c_nationkey = 5"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("o_orderkey")
    return P.some(orders, mine.union(lines).union(team).distinct(), "o_orderkey").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 400000)")
def j9_anti_join(customer, orders):
    return P.none(customer, orders, F.col("o_custkey") == F.col("c_custkey"), (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 400000)).select("c_custkey")


@query("SELECT c_custkey, o.o_orderkey AS last_order FROM customer JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey")
def j12_last_wins_lookup(customer, orders):
    last = orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("last_order"))
    return customer.join(last, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "last_order")


@query("SELECT p_partkey, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 50) AS selected FROM part")
def j14_existence_flag(part, lineitem):
    keys = lineitem.where("l_quantity >= 50").select("l_partkey").distinct()
    return part.join(keys, F.col("l_partkey") == F.col("p_partkey"), "left").select("p_partkey", F.col("l_partkey").isNotNull().alias("selected"))


@query("SELECT a.n_name AS n_name, b.n_name AS next_name FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1")
def j20_self_join(nation):
    a, b = nation.alias("a"), nation.alias("b")
    return a.join(b, F.col("b.n_nationkey") == F.col("a.n_nationkey") + 1).select(F.col("a.n_name").alias("n_name"), F.col("b.n_name").alias("next_name"))


@query("SELECT c_custkey, count(o_orderkey) AS urgent FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY c_custkey")
def j24_filtered_include(customer, orders):
    return customer.join(orders.where("o_orderpriority = '1-URGENT'"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("urgent"))


# ---------------------------------------------------------------- aggregation, windows, order, sets


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'P'")
def a1_count(orders):
    return orders.where("o_orderstatus = 'P'").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, count(l_orderkey) AS load FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_shipdate > TIMESTAMP '1998-01-01' GROUP BY s_suppkey")
def a2_count_per_host(supplier, lineitem):
    later = lineitem.where(F.col("l_shipdate") > F.lit("1998-01-01").cast("timestamp_ntz"))
    return supplier.join(later, F.col("l_suppkey") == F.col("s_suppkey"), "left").groupBy("s_suppkey").agg(F.count("l_orderkey").alias("load"))


@query(f"SELECT recurring, count(*) AS n FROM ({BOOK}) GROUP BY recurring")
def a3_group_count_with_null(orders):
    return _bookings(orders).groupBy("recurring").agg(F.count("*").alias("n"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS word FROM part) GROUP BY word")
def a6_explode_count(part):
    return part.select(F.explode(F.split("p_type", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


SEATS = "SELECT c_nationkey AS team, CASE WHEN c_custkey % 7 = 0 THEN 'OWNER' WHEN c_custkey % 7 < 3 THEN 'ADMIN' ELSE 'MEMBER' END AS role, CASE WHEN c_acctbal < 0 THEN 'FREE' WHEN c_acctbal < 5000 THEN 'TRIAL' ELSE 'PRO' END AS plan, c_custkey FROM customer"


def _members(customer):
    k = F.col("c_custkey") % 7
    return customer.select(F.col("c_nationkey").alias("team"), F.when(k == 0, "OWNER").when(k < 3, "ADMIN").otherwise("MEMBER").alias("role"), F.when(F.col("c_acctbal") < 0, "FREE").when(F.col("c_acctbal") < 5000, "TRIAL").otherwise("PRO").alias("plan"), "c_custkey")


@query(f"SELECT team, count(*) AS total, count_if(plan = 'FREE') AS free, count_if(role <> 'OWNER' OR plan <> 'PRO') AS missing, count_if(plan = 'FREE' AND role <> 'OWNER') AS hidden, bool_or(role = 'OWNER' AND plan <> 'PRO') AS owner_missing FROM ({SEATS}) GROUP BY team".replace("count_if(plan = 'FREE') AS", "CAST(count_if(plan = 'FREE') AS BIGINT) AS").replace("count_if(role <> 'OWNER' OR plan <> 'PRO') AS", "CAST(count_if(role <> 'OWNER' OR plan <> 'PRO') AS BIGINT) AS").replace("count_if(plan = 'FREE' AND role <> 'OWNER') AS", "CAST(count_if(plan = 'FREE' AND role <> 'OWNER') AS BIGINT) AS"))
def a8_seat_stats(customer):
    return P.seat_stats(_members(customer))


@query("SELECT o_custkey, bool_and(o_orderstatus <> 'P') AS all_settled, bool_or(o_totalprice > 250000) AS any_large FROM orders GROUP BY o_custkey")
def a10_a11_every_some(orders):
    return orders.groupBy("o_custkey").agg(F.bool_and(F.col("o_orderstatus") != "P").alias("all_settled"), F.bool_or(F.col("o_totalprice") > 250000).alias("any_large"))


@query("SELECT n_regionkey, host, load FROM (SELECT s_nationkey % 5 AS n_regionkey, s_suppkey AS host, coalesce(c, 0) AS load, row_number() OVER (PARTITION BY s_nationkey % 5 ORDER BY coalesce(c, 0), s_suppkey) AS rn FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS c FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_suppkey) ON l_suppkey = s_suppkey) WHERE rn = 1")
def t19_least_loaded(supplier, lineitem):
    hosts = supplier.select(F.col("s_suppkey").alias("host"), (F.col("s_nationkey") % 5).alias("n_regionkey"))
    return P.least_loaded(hosts, lineitem.where("l_returnflag = 'N'").select(F.col("l_suppkey").alias("host")), ["n_regionkey"])


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) > 1 AS disabled FROM part")
def w1_disabled_by_index(part):
    return part.select("p_partkey", (F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) > 1).alias("disabled"))


@query(f"SELECT id, recurring FROM (SELECT *, row_number() OVER (PARTITION BY recurring ORDER BY start_s, id) AS rn FROM ({BOOK})) WHERE rn = 1 OR recurring IS NULL")
def w2_first_of_recurring(orders):
    return P.first_of(_bookings(orders), "recurring", "start_s", "id").select("id", "recurring")


@query("SELECT team, c_custkey, row_number() OVER (PARTITION BY team ORDER BY CASE role WHEN 'OWNER' THEN 2 WHEN 'ADMIN' THEN 1 ELSE 0 END DESC, c_custkey) AS rank_no FROM (" + SEATS + ")")
def o4_role_order(customer):
    rank = F.when(F.col("role") == "OWNER", 2).when(F.col("role") == "ADMIN", 1).otherwise(0)
    rn = F.row_number().over(Window.partitionBy("team").orderBy(rank.desc(), "c_custkey"))
    return _members(customer).select("team", "c_custkey", rn.alias("rank_no"))


@query(f"SELECT id, start_s FROM ({BOOK}) WHERE end_s >= {NOW} AND status NOT IN ('CANCELLED', 'REJECTED') ORDER BY start_s, id LIMIT 11 OFFSET 20")
def o7_page(orders):
    return P.page(P.list_bookings(_bookings(orders), "upcoming", NOW).select("id", "start_s"), "start_s", "id", limit=10, offset=20)


@query("SELECT user_id AS host, 'event' AS kind FROM events UNION ALL SELECT o_custkey, 'order' FROM orders")
def u1_union_all(events, orders):
    return events.select(F.col("user_id").alias("host"), F.lit("event").alias("kind")).unionByName(orders.select(F.col("o_custkey").alias("host"), F.lit("order").alias("kind")))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_size + 100 ELSE p_size END AS p_size FROM part")
def u2_m2_upsert(part):
    old = part.select("p_partkey", "p_size")
    return P.upsert(old, old.where("p_partkey % 4 = 0").withColumn("p_size", F.col("p_size") + 100), "p_partkey")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'delete' WHEN p_partkey < 0 THEN 'create' ELSE 'update' END AS change FROM part UNION ALL SELECT -p_partkey, 'create' FROM part WHERE p_partkey % 5 = 1")
def u6_three_way_diff(part):
    old = part.select("p_partkey")
    new = old.where("p_partkey % 3 <> 0").union(old.where("p_partkey % 5 = 1").select((-F.col("p_partkey")).alias("p_partkey")))
    return P.classify(old, new, "p_partkey")


# ---------------------------------------------------------------- scalars


@query(r"SELECT page_id, lower(regexp_replace(url, '[^a-zA-Z0-9-]', '-', 'g')) AS slug, regexp_matches(url, '^https?://') AS has_scheme, sha256(url) AS key_hash FROM pages")
def x1_x9_x14_strings(pages):
    return pages.select("page_id", X.slugify(F.col("url")).alias("slug"), X.has_scheme(F.col("url")).alias("has_scheme"), X.key_hash(F.col("url")).alias("key_hash"))


@query("SELECT p_partkey, list_extract(string_split(lower(p_name), ' '), 1) AS first_name, array_to_string(list_filter(string_split(replace(lower(p_name), ' ', '+'), '+'), lambda x: x <> ''), '+') AS slug FROM part")
def x2_x5_usernames(part):
    u = X.username_list(F.col("p_name"))
    return part.select("p_partkey", F.element_at(u, 1).alias("first_name"), X.username_slug(u).alias("slug"))


@query("SELECT event_id, dayofweek(ts) AS wd, hour(ts) * 60 + minute(ts) AS minute_of_day, printf('%02d:%02d', CAST(hour(ts) AS INTEGER), CAST(minute(ts) AS INTEGER)) AS clock, CAST(epoch(date_trunc('month', ts)) AS BIGINT) AS month_s FROM events".replace("dayofweek(ts) AS wd", "CAST(dayofweek(ts) AS INTEGER) AS wd").replace("hour(ts) * 60 + minute(ts) AS", "CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS"))
def x21_x25_x28_x32_dates(events):
    t = F.col("ts")
    return events.select("event_id", X.weekday(t).alias("wd"), X.minute_of_day(t).alias("minute_of_day"), X.clock(X.minute_of_day(t)).alias("clock"), epoch_s(F.date_trunc("month", t).cast("timestamp_ntz")).alias("month_s"))


@query("SELECT p_partkey, greatest(10, least(40, p_size)) AS clamped, CAST(floor(p_retailprice * 0.029 + 30 + 0.5) AS BIGINT) AS fee FROM part")
def x40_x41_math(part):
    return part.select("p_partkey", X.clamp(F.col("p_size"), 10, 40).alias("clamped"), X.fee(F.col("p_retailprice"), 0.029, 30).cast("bigint").alias("fee"))


# ---------------------------------------------------------------- calendar


@query("SELECT c_custkey, day, start_min, end_min FROM (SELECT c_custkey, o, CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS d, CAST(greatest(540 - o, 0) AS INTEGER) AS s0, o AS off FROM (SELECT c_custkey, (c_nationkey - 12) * 60 AS o FROM customer)) t, LATERAL (SELECT d AS day, CAST(least(greatest(540 - o, 0), 1439) AS INTEGER) AS start_min, CAST(least(greatest(1020 - o, 0), 1439) AS INTEGER) AS end_min WHERE least(greatest(540 - o, 0), 1439) <> least(greatest(1020 - o, 0), 1439) UNION ALL SELECT d - 1, CAST(540 - o + 1440 AS INTEGER), CAST(least(1020 - o + 1440, 1439) AS INTEGER) WHERE 540 - o < 0 OR 1020 - o < 0 UNION ALL SELECT d + 1, CAST(greatest(540 - o - 1440, 0) AS INTEGER), CAST(1020 - o - 1440 AS INTEGER) WHERE NOT (540 - o < 0 OR 1020 - o < 0) AND (540 - o > 1439 OR 1020 - o > 1439)) x")
def t3_working_hours(customer):
    a = customer.select("c_custkey", ((F.col("c_nationkey") - 12) * 60).alias("o"), F.lit(0).alias("ord"), F.sequence(F.lit(1), F.lit(5)).alias("days"), F.lit(540).alias("start_min"), F.lit(1020).alias("end_min"))
    h = C.working_hours(a, ["c_custkey"], F.col("o"))
    return h.select("c_custkey", F.explode("hours").alias("h")).select("c_custkey", F.explode("h.days").alias("day"), "h.start_min", "h.end_min")


@query(f"SELECT host, s AS slot_s FROM ({SLOTS})")
def t7_slots(events):
    return _slots(events).select("host", "slot_s")


@query(f"SELECT host, s AS slot_s FROM ({FREE})")
def t8_bookable_slots(events):
    return _free(events).select("host", "slot_s")


TEAM = "(SELECT *, CAST(floor(host / 4) AS BIGINT) AS team FROM ({0}))"


@query(f"SELECT f.team AS team, s AS slot_s FROM {TEAM.format(FREE)} f JOIN (SELECT team, count(DISTINCT host) AS n FROM {TEAM.format('SELECT user_id AS host FROM events')} GROUP BY team) t ON t.team = f.team GROUP BY f.team, s, n HAVING count(DISTINCT host) = n")
def t10_collective(events):
    team = F.floor(F.col("host") / 4).cast("bigint").alias("team")
    size = events.select(F.col("user_id").alias("host")).select("host", team).groupBy("team").agg(F.count_distinct("host").alias("n"))
    return P.pool(_free(events).select("*", team).join(size, "team"), ["team", "n"], "collective", F.col("n")).select("team", "slot_s")


@query(f"SELECT s AS slot_s, string_agg(DISTINCT CAST(host AS VARCHAR), ',' ORDER BY CAST(host AS VARCHAR)) AS hosts FROM ({FREE}) GROUP BY s")
def t11_round_robin(events):
    p = P.pool(_free(events), [], "round_robin")
    return p.select("slot_s", F.array_join(F.array_sort(F.transform("hosts", lambda h: h.cast("string"))), ",").alias("hosts"))


@query("SELECT o_orderkey, CAST(i AS INTEGER) AS occurrence, CAST(CAST(o_orderdate AS DATE) + CAST(i * 14 AS INTEGER) AS DATE) AS occurs FROM orders, (SELECT unnest(range(0, 6)) AS i)")
def t12_weekly_recurrence(orders):
    o = orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("start"), F.lit(2).alias("freq"), F.lit(2).alias("every"), F.lit(6).alias("count"))
    return C.expand_recurrence(o, "start", "freq", "every", "count").select("o_orderkey", F.col("occurrence").cast("int").alias("occurrence"), "occurs")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) > DATE '1998-01-31' AS rolling_out, CAST(o_orderdate AS DATE) < DATE '1997-01-01' OR CAST(o_orderdate AS DATE) > DATE '1997-12-31' AS range_out FROM orders")
def t14_out_of_bounds(orders):
    d, day = F.col("o_orderdate").cast("date"), lambda x: F.lit(x).cast("date")
    roll = C.out_of_bounds(d, F.lit("ROLLING"), F.lit(30), F.lit(True), day(None), day(None), day("1998-01-01"))
    return orders.select("o_orderkey", roll.alias("rolling_out"), C.out_of_bounds(d, F.lit("RANGE"), F.lit(0), F.lit(True), day("1997-01-01"), day("1997-12-31"), day("1998-01-01")).alias("range_out"))


@query(f"WITH b AS (SELECT id, (1706745600 - s) // 60 AS age FROM (SELECT event_id AS id, {S.format('ts')} AS s FROM events WHERE event_type = 'click')), l AS (SELECT id, max(e) AS sent FROM (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 180 ELSE 2880 END AS e FROM events WHERE event_id % 2 = 0) GROUP BY id), d AS (SELECT id, CASE WHEN age >= 2880 THEN 2880 WHEN age >= 1440 THEN 1440 WHEN age >= 180 THEN 180 END AS due FROM b) SELECT d.id AS id, due FROM d LEFT JOIN l ON l.id = d.id WHERE due IS NOT NULL AND (sent IS NULL OR sent < due)")
def t15_reminders(events):
    b = events.where("event_type = 'click'").select(F.col("event_id").alias("id"), epoch_s(F.col("ts")).alias("created_s"), F.lit(False).alias("confirmed"), F.lit(False).alias("rejected"))
    ledger = events.where("event_id % 2 = 0").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, 180).otherwise(2880).alias("elapsed"))
    return P.due_reminders(b, ledger, 1706745600).select("id", "due")


@query(f"SELECT event_id, NOT EXISTS (SELECT 1 FROM ({BUSY}) b WHERE b.host = user_id AND ((c >= bs AND c < be) OR (c + 900 > bs AND c + 900 < be) OR (bs > c AND bs < c + 900))) AS available FROM (SELECT event_id, user_id, {S.format('ts')} - 1200 AS c FROM events)")
def t17_is_available(events):
    cand = events.select("event_id", F.col("user_id").alias("host"), (epoch_s(F.col("ts")) - 1200).alias("slot_s"))
    return B.is_available(cand, _busy(events), ["host"], 15).select("event_id", "available")


# ---------------------------------------------------------------- mutations


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_totalprice < 100000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def m1_m9_update(orders):
    return orders.select("o_orderkey", F.when((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") < 100000), "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 2 = 1 UNION ALL SELECT DISTINCT l_orderkey, 99 FROM lineitem WHERE l_orderkey % 2 = 0")
def m4_replace_children(lineitem):
    old = lineitem.select("l_orderkey", "l_linenumber")
    return P.replace_children(old, old.where("l_orderkey % 2 = 0").select("l_orderkey").distinct().withColumn("l_linenumber", F.lit(99)), "l_orderkey")


@query("SELECT c_custkey, (CAST(c_acctbal AS BIGINT) % 1440 + 1440) % 1440 // 60 * 60 AS start_min FROM customer")
def m7_minutes_to_hour(customer):
    m = F.pmod(F.rint("c_acctbal").cast("bigint"), F.lit(1440))  # a half to the even number, as SQL's cast
    return customer.select("c_custkey", (F.floor(m / 60) * 60).cast("bigint").alias("start_min"))


@query("SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY o_custkey, o_orderpriority HAVING count(*) > 1")
def m13_duplicate_keys(orders):
    return P.duplicates(orders, "o_custkey", "o_orderpriority")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def m14_cascade(lineitem, orders):
    gone = orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return P.cascade(lineitem, gone, "l_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 150000)")
def f22_soft_delete(orders):
    d = orders.withColumn("deleted", F.lit(None).cast("boolean"))
    return P.visible(P.soft_delete(d, (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 150000))).select("o_orderkey")
