"""Rows and relations: lookups, column sets, joins by relation, counts, order and limits, sets of rows, mutations (S4, S6, S15; F2, F3, F20, F21, F26 to F28; J7, J8, J11, J13, J15, J19 to J23, J25; A4, A5, A7, A9, A14 to A16; W5 to W7; O1 to O12; U5, U7, U8; M3, M5, M6, M8, M11, M12, M14, M15, M17 to M20).

All of them are plans over whole tables; none collects rows. A table is never updated in place: a mutation is a function from the old rows to the new ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def must_exist(df: DataFrame, pred: Column, what: str = "row") -> DataFrame:
    """One row that matches; reading the result fails where there is none."""
    one = df.where(pred).limit(1).agg(F.first(F.struct(*df.columns)).alias("r"))
    found = F.when(F.col("r").isNull(), F.raise_error(F.lit(f"no {what} found"))).otherwise(F.col("r"))
    return one.select(found.alias("r")).select("r.*")


def hop(df: DataFrame, parent: DataFrame, on: Column) -> DataFrame:
    """The parents of the given rows."""
    return parent.join(df, on, "left_semi")


def include(df: DataFrame, parent: DataFrame, on: Column, name: str) -> DataFrame:
    """All columns and the parent as a struct, null where there is none."""
    p = parent.select(F.struct(*parent.columns).alias(name), *[F.col(c).alias(f"_p_{c}") for c in parent.columns])
    return df.join(p, on, "left").select(*df.columns, name)


def omit(df: DataFrame, *cols: str) -> DataFrame:  # F3
    return df.drop(*cols)


def pick(df: DataFrame, *cols: str) -> DataFrame:  # F3
    return df.select(*[c for c in cols if c in df.columns])


def not_empty(c: Column) -> Column:
    """neither null nor the empty string, zero or false."""
    return F.coalesce(~c.cast("string").isin("", "0", "0.0", "false"), F.lit(False))


def shown(df: DataFrame, hidden: Column, plan: Column | None = None) -> DataFrame:
    """rows that are not hidden, and with `plan` none of free members."""
    out = df.where(~F.coalesce(hidden, F.lit(False)))
    return out if plan is None else out.where(plan != "FREE")


def may_act(df: DataFrame, me: int, owner: Column, kind: Column, members: DataFrame, event: Column) -> DataFrame:
    """rows of which `me` is the owner, or a member of their collective event. members: event, user."""
    mine = members.where(F.col("user") == me).select(F.col("event").alias("_event")).distinct()
    return df.join(mine, event == F.col("_event"), "left").where((owner == me) | ((kind == "COLLECTIVE") & F.col("_event").isNotNull())).select(*df.columns)


def account_conflict(username: Column, email: Column, password: Column, new_name: Column, new_email: Column) -> Column:  # F27
    return F.coalesce(username == new_name, F.lit(False)) | F.coalesce((email == new_email) & password.isNotNull() & username.isNotNull(), F.lit(False))


def unexpired(df: DataFrame, expires: Column, now) -> DataFrame:  # F28
    return df.where(expires >= F.lit(now))


def trial_is_over(plan: Column, created: Column, ends: Column, now: Column, days: int = 14) -> Column:  # F12
    return (plan == "TRIAL") & F.coalesce(((created < now - F.make_dt_interval(F.lit(days))) & ends.isNull()) | (ends < now), F.lit(False))


def having_some(df: DataFrame, child: DataFrame, on: Column, field: Column) -> DataFrame:  # J7: NOT every(field = null)
    return df.join(child.where(field.isNotNull()), on, "left_semi")


def without_parent(df: DataFrame, fk: str) -> DataFrame:  # J8
    return df.where(F.col(fk).isNull())


def without_enough(df: DataFrame, child: DataFrame, key: str, child_key: str, least: int = 1) -> DataFrame:
    """Rows with fewer than `least` children, as a count over a left join (the children are counted first)."""
    n = child.groupBy(F.col(child_key).alias("_k")).agg(F.count("*").alias("_n"))
    return df.join(n, F.col(key) == F.col("_k"), "left").where(F.coalesce("_n", F.lit(0)) < least).select(*df.columns)


def lookup(df: DataFrame, other: DataFrame, key: str, other_key: str, *cols: str) -> DataFrame:
    """Columns found in another table by id, null where it has none."""
    o = other.select(F.col(other_key).alias("_k"), *cols)
    return df.join(o, F.col(key) == F.col("_k"), "left").drop("_k")


def with_credentials(apps: DataFrame, credentials: DataFrame, kind: str, *, synthetic: Column) -> DataFrame:
    """Each app with the sorted ids of its credentials, and 0 for a synthetic one where the app needs none."""
    g = credentials.groupBy(kind).agg(F.array_sort(F.collect_list("credential")).alias("ids"))
    own = F.coalesce("ids", F.array().cast(g.schema["ids"].dataType))
    zero = F.array(F.lit(0).cast(g.schema["ids"].dataType.elementType))
    return apps.join(g, kind, "left").withColumn("ids", F.when(synthetic, F.concat(own, zero)).otherwise(own))


def member_of(df: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """Rows whose (composite) key is in another table."""
    return df.join(keys.select(*on).distinct(), list(on), "left_semi")


def both_users(df: DataFrame, users: DataFrame, a: str, b: str, key: str, name: str) -> DataFrame:
    """Two foreign keys to one table: names as a_name and b_name."""
    u, v = (users.select(F.col(key).alias(f"_{x}"), F.col(name).alias(f"{x}_name")) for x in (a, b))
    return df.join(u, F.col(a) == F.col(f"_{a}"), "left").join(v, F.col(b) == F.col(f"_{b}"), "left").drop(f"_{a}", f"_{b}")


def first_match(df: DataFrame, group: str, order: str, *cols: str) -> DataFrame:
    """Of each group the row with the least `order`, null last, by partial minima."""
    return df.groupBy(group).agg(F.min(F.struct(F.col(order).isNull().alias("_n"), order, *cols)).alias("m")).select(group, f"m.{order}", *[f"m.{c}" for c in cols])


def unsponsored(users: DataFrame, metadata: Column, key: str, subscriptions: DataFrame, on: str) -> DataFrame:
    """Users without the key in their JSON and without a row in the landed subscriptions."""
    return users.where(F.get_json_object(metadata, f"$.{key}").isNull()).join(subscriptions.select(on).distinct(), on, "left_anti")


def flagged_first(df: DataFrame, group: str, flag: str, order: str, *cols: str) -> DataFrame:
    """Of each group the first flagged row, else the first."""
    rank = F.when(F.coalesce(F.col(flag), F.lit(False)), 0).otherwise(1)
    return df.groupBy(group).agg(F.min(F.struct(rank.alias("_f"), order, *cols)).alias("m")).select(group, f"m.{order}", *[f"m.{c}" for c in cols])


def reversed_positions(df: DataFrame, group: str, ids: str) -> DataFrame:
    """Each id of a list with its place in the reversed list."""
    return df.select(group, F.posexplode(F.reverse(ids)).alias("position", "id"))


def moved(df: DataFrame, group: str, position: str, which: Column, step: int) -> DataFrame:
    """The chosen rows (one of a group) swap places with their neighbour `step` places on."""
    w = Window.partitionBy(group).orderBy(position)
    chosen = F.coalesce(which, F.lit(False))
    before, after = F.lag(chosen.cast("int"), step).over(w), F.lead(F.col(position), step).over(w)
    own = F.lag(F.col(position), step).over(w)
    new = F.when(chosen & after.isNotNull(), after).when(before == 1, own).otherwise(F.col(position))
    return df.withColumn("_new", new).withColumn(position, F.col("_new")).drop("_new")


def ordered(df: DataFrame, *order, limit: int | None = None) -> DataFrame:
    """Rows in an order that has no ties left, and the first of them."""
    out = df.orderBy(*order)
    return out if limit is None else out.limit(limit)


def is_subset(ids: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """One row: are all ids among the allowed ones?"""
    return ids.select(key).join(allowed.select(key).distinct(), key, "left_anti").agg((F.count("*") == 0).alias("subset"))


def attendees(invitee: Column, guests: Column, team: Column) -> Column:
    """U8: invitee, guests and team members in this order; repeated ones stay."""
    none = F.array().cast("array<string>")
    return F.concat(F.array(invitee), F.coalesce(guests, none), F.coalesce(team, none))


def distinct_in_order(df: DataFrame, value: str, order: str, group: str) -> DataFrame:
    """The distinct values of each group by first appearance."""
    first = df.groupBy(group, value).agg(F.min(order).alias("_o"))
    g = first.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_o", value))).alias("v"))
    return g.select(group, F.transform("v", lambda x: x[value]).alias(value))


def to_map(df: DataFrame, group: str, key: str, value: str, order: str) -> DataFrame:
    """A map for each group; of a key that repeats the last in order wins."""
    last = df.groupBy(group, key).agg(F.max(F.struct(order, value)).alias("_m"))
    return last.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), F.col(f"_m.{value}"))))).alias("map"))


# ---------------------------------------------------------------- mutations


def delete_where(df: DataFrame, pred: Column) -> DataFrame:
    """M3: rows of which the predicate is not true stay."""
    return df.where(~F.coalesce(pred, F.lit(False)))


def set_links(old: DataFrame, new: DataFrame, parent: str, touched: DataFrame) -> DataFrame:
    """M5: the links of the touched parents are those of new, also where these are none."""
    return old.join(touched.select(parent).distinct(), parent, "left_anti").unionByName(new)


def batch(tables: dict[str, DataFrame], *steps) -> dict[str, DataFrame]:
    """M6: steps (table name, function of all tables) in order, each seeing those before it; all are plans until one is written."""
    out = dict(tables)
    for name, step in steps:
        out[name] = step(out)
    return out


def default_rows(parents: DataFrame, rows: DataFrame, key: str, row_key: str, **defaults: Column) -> DataFrame:
    """M8: rows, and one of default values for each parent that has none."""
    new = without_enough(parents, rows, key, row_key).select(F.col(key).alias(row_key), *[v.alias(k) for k, v in defaults.items()])
    return rows.unionByName(new, allowMissingColumns=True)


def checked_domain(c: Column, *domain: str) -> Column:
    """The value in upper case if it is in the domain; reading any other but null fails."""
    v = F.upper(c)
    return F.when(v.isNull() | v.isin(*domain), v).otherwise(F.raise_error(F.concat(F.lit("not in the domain: "), v)))


def backfill(df: DataFrame, col: str, value) -> DataFrame:  # M12
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(value)) if col in df.columns else F.lit(value))


def set_null(child: DataFrame, gone: DataFrame, fk: str, key: str) -> DataFrame:
    """Foreign keys to deleted parents become null."""
    g = gone.select(F.col(key).alias("_g")).distinct()
    out = child.join(g, F.col(fk) == F.col("_g"), "left")
    return out.withColumn(fk, F.when(F.col("_g").isNull(), F.col(fk))).select(*child.columns)


def repointed(child: DataFrame, moves: DataFrame, fk: str) -> DataFrame:
    """Foreign keys follow moves (old, new)."""
    out = child.join(moves.select("old", "new"), F.col(fk) == F.col("old"), "left")
    return out.withColumn(fk, F.coalesce("new", fk)).select(*child.columns)


def linked_by_value(child: DataFrame, parents: DataFrame, value: str, parent_value: str, slug: str, fk: str) -> DataFrame:
    """The foreign key is the slug of the parent with the same value; others keep theirs."""
    p = parents.groupBy(F.col(parent_value).alias("_v")).agg(F.min(slug).alias("_s"))
    return child.join(p, F.col(value) == F.col("_v"), "left").withColumn(fk, F.coalesce("_s", fk)).select(*child.columns)


def audited(log: DataFrame, actions: DataFrame, **values: Column) -> DataFrame:
    """The log and a row for each action."""
    return log.unionByName(actions.select(*[v.alias(k) for k, v in values.items()]))


def seats_settled(members: DataFrame, team: str = "team") -> DataFrame:
    """Free members other than the owner of a team whose owner pays become paying members, with the team as sponsor."""
    paid = members.where("role = 'OWNER' AND plan = 'PRO'").select(F.col(team).alias("_t")).distinct()
    hit = F.col("_t").isNotNull() & (F.col("plan") == "FREE") & (F.col("role") != "OWNER")
    return members.join(paid, F.col(team) == F.col("_t"), "left").withColumn("sponsor", F.when(hit, F.col(team))).withColumn("plan", F.when(hit, "PRO").otherwise(F.col("plan"))).drop("_t")


def replace_week(old: DataFrame, new: DataFrame, key: str, schedule: str) -> DataFrame:
    """The availability of the users in new becomes that of their schedule, which must have 7 days."""
    from .calendar import availability_from_schedule

    week = F.when(F.size(schedule) == 7, F.col(schedule)).otherwise(F.raise_error(F.lit("a schedule has 7 days")))
    rows = availability_from_schedule(new.withColumn(schedule, week), [key], schedule).drop("first")
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(rows)
