"""The 32 data-quality rules over the operational tables.

A rule takes the tables by name and returns its violations as (violation_type, entity_id, at): the kind of violation,
the id of the row that shows it, and the instant at which it does, null unless the rule tests instants. An empty result
passes. Children are counted before they are joined to parents, and events meet periods in joins that carry an equality
of keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import active_at, contained_in, overlaps
from tidemark.operators.quality import after_closure, summary
from tidemark.operators.temporal import boundaries, during

Tables = Mapping[str, DataFrame]
RULES: dict[str, Callable[[Tables], DataFrame]] = {}

# The plans' ids by rank, and the events that change a plan.
RANKS = {"PLAN_FREE": 0, "PLAN_STANDARD": 1, "PLAN_PREMIUM": 2}
FREE = "PLAN_FREE"
# Periods of a key that an event may meet as one array.
MANY = 256
# Shuffled bytes at which adaptive execution stops joining partitions; sorted ids and times take over ten times that in memory.
PARTITION = 4 << 20
# Whether Spark removes the shuffled files of a query at its end, not when the driver's memory is next cleared.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Rules that are computed at the same time: one rule's planning then leaves no cores idle.
AT_ONCE = 3
PLAN_CHANGES = ("subscription_upgraded", "subscription_downgraded", "subscription_cancelled", "subscription_reactivated")


def rule(name: str) -> Callable:
    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        RULES[name] = f
        return f

    return add


# ---------------------------------------------------------------- building blocks


def found(df: DataFrame, kind: str, entity: str, at: str | None = None) -> DataFrame:
    when = F.col(at) if at else F.lit(None)
    return df.select(F.lit(kind).alias("violation_type"), F.col(entity).cast("string").alias("entity_id"), when.cast("timestamp_ntz").alias("at"))


def together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def differ(a: str, b: str) -> Column:
    return ~F.col(a).eqNullSafe(F.col(b))


def of_type(df: DataFrame, *types: str) -> DataFrame:
    return df.where(F.col("event_type").isin(*types))


def lacking(left: DataFrame, right: DataFrame, **on: str) -> DataFrame:
    """Rows of left without a row of right; ``on`` gives left column=right column."""
    keys = right.select(*[F.col(b).alias(f"_{a}") for a, b in on.items()])
    return left.join(keys.hint("merge"), [F.col(a) == F.col(f"_{a}") for a in on], "left_anti")


def counted(left: DataFrame, right: DataFrame, name: str, **on: str) -> DataFrame:
    """left with the number of matching rows of right, which are counted before the join."""
    n = right.groupBy(*[F.col(b).alias(f"_{a}") for a, b in on.items()]).agg(F.count("*").alias("_n"))
    joined = left.join(n.hint("merge"), [F.col(a) == F.col(f"_{a}") for a in on], "left")
    return joined.withColumn(name, F.coalesce("_n", F.lit(0))).drop("_n", *[f"_{a}" for a in on])


def repeated(df: DataFrame, name: str) -> DataFrame:
    """The different rows of df, with the number of times that each occurs."""
    return df.groupBy(*df.columns).agg(F.count("*").alias(name))


def event_stats(parent: DataFrame, events: DataFrame, key: str, first: str, last: str) -> DataFrame:
    """parent with firsts, lasts (numbers of events of two types), first_time and last_time; parents without events stay."""
    is_first, is_last = F.col("event_type") == first, F.col("event_type") == last
    stats = events.groupBy(F.col(key).alias("_key")).agg(
        F.count_if(is_first).alias("firsts"), F.count_if(is_last).alias("lasts"),
        F.min(F.when(is_first, F.col("event_time"))).alias("first_time"), F.max(F.when(is_last, F.col("event_time"))).alias("last_time"),
    )
    joined = parent.join(stats.hint("merge"), F.col(key) == F.col("_key"), "left").drop("_key")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("firsts", "lasts")})


def arrays_of(periods: DataFrame, on: list[str], **fields: str) -> tuple[DataFrame, DataFrame | None]:
    """(on, held): the periods of each key with MANY of them at most, as an array of (fields); and the other keys, or None.

    Whether there are others is asked at once, from the counts by key alone.
    """
    rows = periods.dropna(subset=on).select(*on, F.struct(*[F.col(c).alias(name) for name, c in fields.items()]).alias("_p"))
    crowded = rows.groupBy(*on).agg(F.count("*").alias("_k")).where(F.col("_k") > MANY).select(*on)
    if crowded.isEmpty():
        crowded = None
    else:
        rows = rows.join(crowded.hint("merge"), on, "left_anti")
    return rows.groupBy(*on).agg(F.collect_list("_p").alias("held")), crowded


def active(events: DataFrame, periods: DataFrame, on: list[str], period_id: str, name: str, event_id: str = "event_id", time: str = "event_time", many: bool = False) -> DataFrame:
    """events with the number of periods with equal keys that hold their time; null keys meet none, repeated ids count apart.

    An event meets its key's periods as one array, so events are moved once and never grouped. Keys with more than MANY periods
    go the other way (``many``): events are joined to single periods, and counted.
    """
    if not many:
        held, crowded = arrays_of(periods, on, id=period_id, since="valid_from", until="valid_to")
        plain = events if crowded is None else events.join(crowded.hint("merge"), on, "left_anti")
        keyed = held.select(*[F.col(c).alias(f"_{c}") for c in on], "held")
        here = F.filter("held", lambda p: active_at(F.col(time), p["since"], p["until"]))
        ids = F.size(F.array_compact(F.array_distinct(F.transform(here, lambda p: p["id"]))))
        out = plain.join(keyed.hint("merge"), [F.col(c) == F.col(f"_{c}") for c in on], "left")
        out = out.withColumn(name, F.when(F.col("held").isNull(), 0).otherwise(ids).cast("long")).drop("held", *[f"_{c}" for c in on])
        if crowded is None:
            return out
        return out.unionByName(active(events.join(crowded.hint("merge"), on, "left_semi"), periods, on, period_id, name, event_id, time, many=True))
    key = list(dict.fromkeys([event_id, time, *on]))
    inside = during(events.select(*key).distinct(), periods.select(*on, F.col(period_id).alias("_period"), "valid_from", "valid_to"), on, time=time)
    n = inside.groupBy(*[F.col(c).alias(f"_{c}") for c in key]).agg(F.count_distinct("_period").alias("_n"))
    joined = events.join(n, [F.col(c) == F.col(f"_{c}") for c in key], "left")
    return joined.withColumn(name, F.coalesce("_n", F.lit(0))).drop("_n", *[f"_{c}" for c in key])


def entitled(events: DataFrame, t: Tables, counted_by: list[str], name: str, event_id: str = "event_id", time: str = "event_time", many: bool = False) -> DataFrame:
    """events with the number of their account's plan periods (or of pairs with entitlements) that give their feature at their time.

    Events meet the periods of their account's plans as one array, and then the entitlements of all plans to their feature as
    another: they are moved once, for the accounts, and never grouped; the entitlements are a catalogue and broadcast. Accounts and features with more than MANY go the other way (``many``):
    events meet their account's plans first, and then the entitlements of those plans to their feature, never all features.
    """
    plans = t["subscription_plan_period"].select("account_id", "plan_id", "subscription_plan_period_id", "valid_from", "valid_to")
    given = t["plan_feature_entitlement_period"].select("plan_id", "feature_id", "entitlement_period_id", "valid_from", "valid_to")
    if not many:
        of_account, many_plans = arrays_of(plans, ["account_id"], plan="plan_id", id="subscription_plan_period_id", since="valid_from", until="valid_to")
        of_feature, many_given = arrays_of(given, ["feature_id"], plan="plan_id", id="entitlement_period_id", since="valid_from", until="valid_to")
        plain, others = events, []
        for crowded, on in ((many_plans, "account_id"), (many_given, "feature_id")):
            if crowded is not None:
                others.append(plain.join(crowded.hint("merge"), on, "left_semi"))
                plain = plain.join(crowded.hint("merge"), on, "left_anti")
        out = plain.join(of_account.select(F.col("account_id").alias("_a"), F.col("held").alias("_plans")).hint("merge"), F.col("account_id") == F.col("_a"), "left")
        out = out.join(F.broadcast(of_feature.select(F.col("feature_id").alias("_f"), F.col("held").alias("_given"))), F.col("feature_id") == F.col("_f"), "left")
        now = lambda column: F.filter(column, lambda p: active_at(F.col(time), p["since"], p["until"]))
        # a count of distinct ids leaves out nulls, as does one of pairs
        pair = lambda p, g: F.struct(*[(p if c == "subscription_plan_period_id" else g)["id"].alias(c) for c in counted_by])
        pairs = F.flatten(F.transform(now("_plans"), lambda p: F.transform(F.filter(now("_given"), lambda g: g["plan"] == p["plan"]), lambda g: pair(p, g))))
        whole = F.filter(pairs, lambda x: reduce(Column.__and__, [x[c].isNotNull() for c in counted_by]))
        none = F.col("_plans").isNull() | F.col("_given").isNull()
        out = out.withColumn(name, F.when(none, 0).otherwise(F.size(F.array_distinct(whole))).cast("long")).drop("_a", "_plans", "_f", "_given")
        return reduce(DataFrame.unionByName, [entitled(x, t, counted_by, name, event_id, time, many=True) for x in others], out)
    key = [event_id, time, "account_id", "feature_id"]
    held = during(events.select(*key).distinct(), plans, ["account_id"], time=time).drop("valid_from", "valid_to")
    n = during(held, given, ["plan_id", "feature_id"], time=time).groupBy(*[F.col(c).alias(f"_{c}") for c in key]).agg(F.count_distinct(*counted_by).alias("_n"))
    joined = events.join(n, [F.col(c) == F.col(f"_{c}") for c in key], "left")
    return joined.withColumn(name, F.coalesce("_n", F.lit(0))).drop("_n", *[f"_{c}" for c in key])


def history(periods: DataFrame, key: str, period_id: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """periods with is_first, is_last and gap: whether the period starts elsewhere than the one before it ended."""
    by = Window.partitionBy(key).orderBy(start, period_id)
    rows = periods.withColumns({"_before": F.lag(period_id).over(by), "_end": F.lag(end).over(by), "_after": F.lead(period_id).over(by)})
    gap = F.col("_before").isNotNull() & differ("_end", start)
    return rows.withColumns({"is_first": F.col("_before").isNull(), "is_last": F.col("_after").isNull(), "gap": gap}).drop("_before", "_end", "_after")


def common(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """The time that two periods with equal keys share, with all columns of both."""
    r = right.withColumnsRenamed({on: "_on", "valid_from": "_from", "valid_to": "_to"})
    both = left.join(r, [F.col(on) == F.col("_on"), overlaps(F.col("valid_from"), F.col("valid_to"), F.col("_from"), F.col("_to"))])
    return both.withColumns({"valid_from": F.greatest("valid_from", "_from"), "valid_to": F.least("valid_to", "_to")}).drop("_on", "_from", "_to")


def edges(periods: DataFrame, *keys: str) -> DataFrame:
    """(keys, at) of all starts and ends."""
    return periods.select(*keys, F.explode(F.array("valid_from", "valid_to")).alias("at")).where("at is not null")


def member_periods(t: Tables) -> DataFrame:
    return t["user_account_membership_period"].join(t["user_account_membership"], "membership_id")


def role_periods(t: Tables, *roles: str) -> DataFrame:
    """The time in which a membership and one of the roles hold together."""
    role = t["user_account_role_assignment_period"].where(F.lower("role").isin(*roles)).select("membership_id", "role_period_id", "valid_from", "valid_to")
    return common(member_periods(t), role, "membership_id")


def paid_periods(t: Tables) -> DataFrame:
    return t["subscription_plan_period"].join(t["plan_catalog"].where("plan_name <> 'free'").select("plan_id"), "plan_id")


def own_website(events: DataFrame, t: Tables) -> DataFrame:
    """events with ``owned``: whether the event's website is one of its account's."""
    w = t["website"].select(F.col("website_id").alias("_website"), F.col("account_id").alias("_account"))
    same = [F.col("website_id") == F.col("_website"), F.col("account_id") == F.col("_account")]
    return events.join(w.hint("merge"), same, "left").withColumn("owned", F.col("_website").isNotNull()).drop("_website", "_account")


def closures(t: Tables) -> DataFrame:
    return of_type(t["account_lifecycle_event"], "account_closure").groupBy("account_id").agg(F.min("event_time").alias("closure_time"))


# ---------------------------------------------------------------- accounts and websites


@rule("DQ-01")
def _(t: Tables) -> DataFrame:
    """Roles lie in membership periods and cover them without gaps."""
    members = t["user_account_membership_period"]
    roles = t["user_account_role_assignment_period"].select("role_period_id", "membership_id", F.col("valid_from").alias("role_from"), F.col("valid_to").alias("role_to"))
    starts = (F.col("role_from") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("role_from") < F.col("valid_to")))
    ends = F.col("role_to").isNull() | F.col("valid_to").isNull() | (F.col("role_to") <= F.col("valid_to"))
    inside = members.join(roles, "membership_id").where(starts & ends)
    inside = history(inside, "membership_period_id", "role_period_id", "role_from", "role_to")
    to_start = inside.where("role_from = valid_from")
    to_end = inside.where(F.col("is_last") & F.col("role_to").eqNullSafe(F.col("valid_to")))
    return together(
        found(lacking(roles, inside, role_period_id="role_period_id"), "role_period_outside_membership", "role_period_id"),
        found(lacking(members, to_start, membership_period_id="membership_period_id"), "membership_role_start_gap", "membership_period_id"),
        found(inside.where("gap"), "membership_role_internal_gap", "role_period_id"),
        found(lacking(members, to_end, membership_period_id="membership_period_id"), "membership_role_end_gap", "membership_period_id"),
    )


@rule("DQ-02")
def _(t: Tables) -> DataFrame:
    """An owner is active at every instant of an active account; tested at all starts and ends, between which nothing changes."""
    alive = t["account_lifecycle_period"].where("lifecycle_state = 'active'").select("account_lifecycle_period_id", "account_id", "valid_from", "valid_to")
    role = t["user_account_role_assignment_period"].join(t["user_account_membership"], "membership_id")
    points = edges(member_periods(t), "account_id").union(edges(role, "account_id")).distinct()
    within = during(points, alive, ["account_id"], time="at").select("account_lifecycle_period_id", "account_id", "at")
    tested = within.union(alive.select("account_lifecycle_period_id", "account_id", "valid_from")).distinct()
    owners = role_periods(t, "owner").select("account_id", "valid_from", "valid_to")
    return found(during(tested, owners, ["account_id"], time="at", how="left_anti"), "account_without_owner", "account_id", "at")


@rule("DQ-03")
def _(t: Tables) -> DataFrame:
    """Lifecycle events of accounts and memberships agree with their periods."""
    accounts = event_stats(t["account"], t["account_lifecycle_event"], "account_id", "account_created", "account_closure")
    on, off = F.col("lifecycle_state") == "active", F.col("lifecycle_state") == "closed"
    periods = t["account_lifecycle_period"].groupBy("account_id").agg(
        F.count_if(on).alias("active_n"), F.count_if(off).alias("closed_n"),
        F.min(F.when(on, F.col("valid_from"))).alias("active_from"), F.max(F.when(on, F.col("valid_to"))).alias("active_to"),
        F.min(F.when(off, F.col("valid_from"))).alias("closed_from"), F.max(F.when(off, F.col("valid_to"))).alias("closed_to"),
    )
    accounts = accounts.join(periods, "account_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("active_n", "closed_n")})
    open_ = (F.col("lasts") == 0) & (F.col("active_to").isNotNull() | (F.col("closed_n") != 0))
    shut = (F.col("lasts") == 1) & (differ("active_to", "last_time") | (F.col("closed_n") != 1) | differ("closed_from", "last_time") | F.col("closed_to").isNotNull())
    wrong = (F.col("firsts") != 1) | (F.col("lasts") > 1) | (F.col("active_n") != 1) | differ("active_from", "first_time") | open_ | shut
    starts = t["user_account_membership_period"].groupBy("membership_id").agg(F.min("valid_from").alias("start"))
    joined = of_type(t["user_account_membership_event"], "user_joined_account").groupBy("membership_id").agg(F.count("*").alias("n"), F.min("event_time").alias("joined"))
    members = t["user_account_membership"].join(starts, "membership_id", "left").join(joined, "membership_id", "left")
    unlike = F.col("start").isNull() | (F.coalesce("n", F.lit(0)) != 1) | differ("joined", "start")
    return together(found(accounts.where(wrong), "account_event_period_mismatch", "account_id"), found(members.where(unlike), "membership_joined_event_mismatch", "membership_id"))


@rule("DQ-04")
def _(t: Tables) -> DataFrame:
    """Websites are created once and first; publications start live periods; addresses cover live periods."""
    events, live, address = t["website_lifecycle_event"], t["website_live_period"], t["website_address_period"]
    created = event_stats(t["website"].select("website_id"), events, "website_id", "website_created", "")
    once = created.where("firsts = 1").select("website_id", "first_time")
    published = of_type(events, "published")
    points = during(edges(address, "website_id").distinct(), live, ["website_id"], time="at").select("live_period_id", "website_id", "at")
    points = points.union(live.select("live_period_id", "website_id", "valid_from")).distinct()
    return together(
        found(created.where("firsts <> 1"), "website_created_cardinality_or_time", "website_id"),
        found(events.join(once, "website_id").where("event_time < first_time"), "website_event_before_created", "event_id"),
        found(counted(live, published, "n", website_id="website_id", valid_from="event_time").where("n <> 1"), "live_period_without_published_start", "live_period_id"),
        found(lacking(published, live, website_id="website_id", event_time="valid_from"), "published_without_live_period", "event_id"),
        found(during(points, address.select("website_id", "valid_from", "valid_to"), ["website_id"], time="at", how="left_anti"), "live_period_address_coverage_gap", "live_period_id", "at"),
    )


def access(parent: DataFrame, periods: DataFrame, key: str, period_id: str, what: str) -> DataFrame:
    """Access histories exist, have no gaps and are open at their end.

    Parents go, as rows without a period, through the one shuffle that the histories need, and all three kinds come from
    one reading of it. Parents come first among their key's rows, so a period's neighbours are the same without them.
    """
    owners = parent.where(F.col(key).isNotNull()).select(F.lit(0).alias("_held"), key, *[F.lit(None).cast(kind).alias(c) for c, kind in periods.select(period_id, "valid_from", "valid_to").dtypes])
    both = owners.unionByName(periods.select(F.lit(1).alias("_held"), key, period_id, "valid_from", "valid_to"))
    by = Window.partitionBy(key).orderBy("_held", "valid_from", period_id)
    rows = both.withColumns({"_before": F.lag(period_id).over(by), "_end": F.lag("valid_to").over(by), "_after": F.lead(period_id).over(by)})
    rows = rows.withColumn("_any", F.max("_held").over(Window.partitionBy(key)))
    kinds = {
        f"{what}_missing_access_history": (F.col("_any") == 0, key),
        f"{what}_access_internal_gap": ((F.col("_held") == 1) & F.col("_before").isNotNull() & differ("_end", "valid_from"), period_id),
        f"{what}_access_final_period_not_open": ((F.col("_held") == 1) & F.col("_after").isNull() & F.col("valid_to").isNotNull(), period_id),
    }
    shown = [F.when(test, F.struct(F.lit(kind).alias("kind"), F.col(entity).cast("string").alias("entity"))) for kind, (test, entity) in kinds.items()]
    wrong = rows.select(F.explode(F.array_compact(F.array(*shown))).alias("_w")).select(F.col("_w.kind").alias("violation_type"), F.col("_w.entity").alias("entity_id"), F.lit(None).cast("timestamp_ntz").alias("at"))
    return together(wrong, found(parent.where(F.col(key).isNull()), f"{what}_missing_access_history", key))


@rule("DQ-05")
def _(t: Tables) -> DataFrame:
    return access(t["page"], t["page_access_period"], "page_id", "page_access_period_id", "page")


@rule("DQ-06")
def _(t: Tables) -> DataFrame:
    return access(t["content_item"], t["content_item_access_period"], "content_item_id", "content_item_access_period_id", "content")


# ---------------------------------------------------------------- features and product behaviour


@rule("DQ-07")
def _(t: Tables) -> DataFrame:
    """At every start and end within an enablement, exactly one plan period entitles the account to the feature."""
    on = t["website_feature_enablement_period"].join(t["website"].select("website_id", "account_id"), "website_id")
    on = on.select("enablement_period_id", "account_id", "feature_id", "valid_from", "valid_to")
    keys = ["enablement_period_id", "account_id", "feature_id", "at"]
    plans = edges(t["subscription_plan_period"], "account_id").distinct()
    given = edges(t["plan_feature_entitlement_period"], "feature_id").distinct()
    points = during(plans, on, ["account_id"], time="at").select(*keys).union(during(given, on, ["feature_id"], time="at").select(*keys))
    points = points.union(on.select("enablement_period_id", "account_id", "feature_id", "valid_from")).distinct()
    points = points.withColumn("point", F.struct("enablement_period_id", "at"))
    wrong = entitled(points, t, ["subscription_plan_period_id", "entitlement_period_id"], "n", event_id="point", time="at").where("n <> 1")
    return found(wrong, "enablement_without_one_entitlement", "enablement_period_id", "at")


@rule("DQ-08")
def _(t: Tables) -> DataFrame:
    """Enabled and disabled events are the enablement periods' starts and ends."""
    periods, events = t["website_feature_enablement_period"], t["feature_enablement_lifecycle_event"]
    parts = []
    for edge, kind, words in (("valid_from", "enabled", "start"), ("valid_to", "disabled", "end")):
        seen, having = of_type(events, f"feature_{kind}"), periods.where(F.col(edge).isNotNull())
        n = counted(having, seen, "n", website_id="website_id", feature_id="feature_id", **{edge: "event_time"})
        parts.append(found(n.where("n <> 1"), f"enablement_{words}_event_mismatch", "enablement_period_id"))
        stray = lacking(seen, having, website_id="website_id", feature_id="feature_id", event_time=edge)
        parts.append(found(stray, f"{kind}_event_without_period_{words}", "event_id"))
    return together(*parts)


@rule("DQ-09")
def _(t: Tables) -> DataFrame:
    """Each product event has one active membership, and its website, if any, is its account's."""
    events = own_website(t["product_behaviour_event"], t)
    events = active(events, member_periods(t), ["user_id", "account_id"], "membership_period_id", "n")
    return found(events.where("n <> 1 or (website_id is not null and not owned)"), "product_event_context", "event_id")


@rule("DQ-10")
def _(t: Tables) -> DataFrame:
    """A used feature has one membership, one entitling plan and one enablement, on the account's own website."""
    events = own_website(of_type(t["product_behaviour_event"], "feature_used"), t)
    events = active(events, member_periods(t), ["user_id", "account_id"], "membership_period_id", "members")
    events = entitled(events, t, ["subscription_plan_period_id"], "plans")
    events = active(events, t["website_feature_enablement_period"], ["website_id", "feature_id"], "enablement_period_id", "enabled")
    return found(events.where("not owned or members <> 1 or plans <> 1 or enabled <> 1"), "feature_used_context", "event_id")


@rule("DQ-11")
def _(t: Tables) -> DataFrame:
    """A locked attempt is made by a user in one plan that does not give the feature."""
    events = of_type(t["product_behaviour_event"], "locked_feature_attempted")
    events = active(events, t["subscription_plan_period"], ["account_id"], "subscription_plan_period_id", "plans")
    events = entitled(events, t, ["subscription_plan_period_id"], "entitled")
    return found(events.where("user_id is null or feature_id is null or plans <> 1 or entitled > 0"), "locked_attempt_context", "event_id")


@rule("DQ-12")
def _(t: Tables) -> DataFrame:
    """A restricted action is attempted by one active viewer."""
    events = of_type(t["product_behaviour_event"], "restricted_product_action_attempted")
    events = active(events, role_periods(t, "viewer"), ["user_id", "account_id"], "role_period_id", "n")
    return found(events.where("n <> 1"), "restricted_attempt_context", "event_id")


@rule("DQ-13")
def _(t: Tables) -> DataFrame:
    """Analytics are viewed by one active owner or editor of the website's account."""
    events = own_website(of_type(t["product_behaviour_event"], "website_analytics_viewed"), t)
    events = active(events, role_periods(t, "owner", "editor"), ["user_id", "account_id"], "role_period_id", "n")
    return found(events.where("not owned or n <> 1"), "analytics_view_context", "event_id")


# ---------------------------------------------------------------- members and contributions


@rule("DQ-14")
def _(t: Tables) -> DataFrame:
    """An invitation ends in one outcome or registration, after it was made and on its website."""
    invited, outcomes, registered = t["membership_invitation"], t["invitation_outcome_event"], t["member_registration_success_event"]
    by_invitation = registered.where("registration_method = 'invitation'")
    ended = counted(counted(invited, outcomes, "a", invitation_id="invitation_id"), by_invitation, "b", invitation_id="invitation_id")
    asked = invited.select("invitation_id", "invitation_time", F.col("website_id").alias("asked_website"))
    taken = by_invitation.join(asked, "invitation_id").where(differ("website_id", "asked_website") | (F.col("event_time") < F.col("invitation_time")))
    member = t["website_member"].select("member_id", F.col("website_id").alias("member_website"))
    return together(
        found(ended.where("a + b <> 1"), "invitation_resolution_cardinality", "invitation_id"),
        found(outcomes.join(asked, "invitation_id").where("event_time < invitation_time"), "invitation_outcome_before_invitation", "event_id"),
        found(taken, "invitation_registration_mismatch", "event_id"),
        found(registered.join(member, "member_id").where(differ("website_id", "member_website")), "registration_member_website_mismatch", "event_id"),
    )


@rule("DQ-15")
def _(t: Tables) -> DataFrame:
    """A member registers once; the states begin active at that time and have no gaps."""
    made = t["member_registration_success_event"].groupBy("member_id").agg(F.count("*").alias("n"), F.min("event_time").alias("registered"))
    members = t["website_member"].select("member_id").join(made, "member_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    states = history(t["member_state_period"], "member_id", "member_state_period_id")
    first = states.where("is_first").join(members, "member_id")
    return together(
        found(members.where("n <> 1"), "member_registration_cardinality", "member_id"),
        found(first.where((F.col("n") != 1) | (F.col("member_state") != "active") | differ("valid_from", "registered")), "member_state_initial_mismatch", "member_id"),
        found(states.where("gap"), "member_state_internal_gap", "member_state_period_id"),
        found(lacking(members, states, member_id="member_id"), "member_missing_state_history", "member_id"),
    )


@rule("DQ-16")
def _(t: Tables) -> DataFrame:
    """Attempts to register start once, on one website, before they fail; members log in where they registered, and later."""
    events, on = t["membership_behaviour_event"], F.col("event_type") == "member_registration_started"
    attempts = of_type(events, "member_registration_started", "member_registration_failed").where("registration_attempt_id is not null")
    attempts = attempts.groupBy("registration_attempt_id").agg(
        F.count_if(on).alias("started"), F.count_if(~on).alias("failed"), F.min("website_id").alias("website"), F.max("website_id").alias("other"),
        F.min(F.when(on, F.col("event_time"))).alias("start"), F.max(F.when(~on, F.col("event_time"))).alias("failure"),
    )
    # one website: the least is the greatest, which is found in the one shuffle that all else needs, as a count of distinct ones is not
    wrong = attempts.where("started <> 1 or failed > 1 or website is null or website <> other or (failed = 1 and failure <= start)")
    home = t["website_member"].select(F.col("member_id").alias("_member"), F.col("website_id").alias("_home"))
    first = t["member_registration_success_event"].groupBy(F.col("member_id").alias("_m"), F.col("website_id").alias("_w")).agg(F.min("event_time").alias("registered"))
    logins = of_type(events, "member_logged_in").join(home, F.col("member_id") == F.col("_member"), "left")
    logins = logins.join(first, [F.col("member_id") == F.col("_m"), F.col("website_id") == F.col("_w")], "left")
    bad = F.col("_member").isNull() | differ("_home", "website_id") | F.col("registered").isNull() | (F.col("registered") > F.col("event_time"))
    return together(found(wrong, "registration_attempt_mismatch", "registration_attempt_id"), found(logins.where(bad), "member_login_context_mismatch", "event_id"))


@rule("DQ-17")
def _(t: Tables) -> DataFrame:
    """Comments are posted once and ratings given once."""
    posted = counted(t["comment"], of_type(t["comment_lifecycle_event"], "comment_posted"), "n", comment_id="comment_id")
    given = counted(t["rating"], of_type(t["rating_lifecycle_event"], "rating_given"), "n", rating_id="rating_id")
    return together(found(posted.where("n <> 1"), "comment_posted_cardinality", "comment_id"), found(given.where("n <> 1"), "rating_given_cardinality", "rating_id"))


# ---------------------------------------------------------------- audience and acquisition


@rule("DQ-18")
def _(t: Tables) -> DataFrame:
    """A session is on its visitor's website."""
    visitors = t["visitor"].select("visitor_id", F.col("website_id").alias("visitor_website"))
    return found(t["audience_session"].join(visitors, "visitor_id").where(differ("website_id", "visitor_website")), "session_visitor_website", "session_id")


def sessions(t: Tables) -> DataFrame:
    return event_stats(t["audience_session"], t["session_lifecycle_event"], "session_id", "session_started", "session_ended")


@rule("DQ-19")
def _(t: Tables) -> DataFrame:
    """A session starts once and ends once, in that order."""
    return found(sessions(t).where("firsts <> 1 or lasts <> 1 or last_time < first_time"), "session_start_end", "session_id")


@rule("DQ-20")
def _(t: Tables) -> DataFrame:
    """A session has one traffic source."""
    n = counted(t["audience_session"], t["session_traffic_attribution"], "n", session_id="session_id")
    return found(n.where("n <> 1"), "session_traffic_cardinality", "session_id")


@rule("DQ-21")
def _(t: Tables) -> DataFrame:
    """Interactions happen while their session lasts, on pages and content of its website.

    Equal rows of sessions, pages and content go through the joins as one row with their number, and are repeated at the end.
    """
    s = repeated(sessions(t).select("session_id", F.col("website_id").alias("home"), "firsts", "lasts", "first_time", "last_time"), "_sessions")
    page = repeated(t["page"].select(F.col("page_id").alias("_page"), F.col("website_id").alias("page_home")).repartition("_page"), "_pages")
    item = t["content_item"].join(page, F.col("page_id") == F.col("_page"), "left").select(F.col("content_item_id").alias("_item"), F.col("page_home").alias("item_home"), F.coalesce("_pages", F.lit(1)).alias("_of"))
    item = item.repartition("_item").groupBy("_item", "item_home").agg(F.sum("_of").alias("_items"))
    outside = F.expr("coalesce(firsts <> 1 or lasts <> 1 or event_time < first_time or event_time > last_time, false) AS outside")
    rows = t["audience_interaction_event"].join(s, "session_id").select("event_id", "page_id", "content_item_id", "home", outside, "_sessions")
    rows = rows.join(page, F.col("page_id") == F.col("_page"), "left")
    rows = rows.withColumn("wrong", F.col("outside") | (F.col("page_id").isNotNull() & differ("page_home", "home"))).select("event_id", "content_item_id", "home", "wrong", "_sessions", "_pages")
    rows = rows.join(item, F.col("content_item_id") == F.col("_item"), "left")
    rows = rows.where(F.col("wrong") | (F.col("content_item_id").isNotNull() & differ("item_home", "home")))
    for n in ("_sessions", "_pages", "_items"):
        rows = rows.withColumn(n, F.explode(F.sequence(F.lit(1), F.coalesce(n, F.lit(1)))))
    return found(rows, "interaction_context", "event_id")


@rule("DQ-22")
def _(t: Tables) -> DataFrame:
    """Visitors, members and sessions that are linked share a website; a session's member is its visitor's."""
    member = t["website_member"].select("member_id", F.col("website_id").alias("member_website"))
    links = t["visitor_member_linkage"]
    linked = links.join(t["visitor"].select("visitor_id", "website_id"), "visitor_id").join(member, "member_id")
    named = t["session_member_attribution"].join(t["audience_session"].select("session_id", "visitor_id", "website_id"), "session_id")
    return together(
        found(linked.where(differ("website_id", "member_website")), "visitor_member_website_mismatch", "visitor_member_link_id"),
        found(named.join(member, "member_id").where(differ("website_id", "member_website")), "session_member_website_mismatch", "session_member_attribution_id"),
        found(lacking(named, links, visitor_id="visitor_id", member_id="member_id"), "session_member_visitor_linkage_missing", "session_member_attribution_id"),
    )


def signups(t: Tables) -> DataFrame:
    return event_stats(t["signup_journey_context"], t["signup_journey_event"], "signup_journey_id", "signup_started", "")


@rule("DQ-23")
def _(t: Tables) -> DataFrame:
    """A signup starts once and has one source."""
    n = counted(signups(t), t["acquisition_source_attribution"], "n", signup_journey_id="signup_journey_id")
    return found(n.where("firsts <> 1 or n <> 1"), "signup_cardinality", "signup_journey_id")


@rule("DQ-24")
def _(t: Tables) -> DataFrame:
    """A signup's account is created once, and not before the signup."""
    made = of_type(t["account_lifecycle_event"], "account_created").groupBy("account_id").agg(F.count("*").alias("n"), F.min("event_time").alias("created"))
    rows = signups(t).where("resulting_account_id is not null").join(made, F.col("resulting_account_id") == F.col("account_id"), "left")
    return found(rows.where("coalesce(n, 0) <> 1 or firsts <> 1 or created < first_time"), "signup_account_creation", "signup_journey_id")


# ---------------------------------------------------------------- commerce and support


@rule("DQ-25")
def _(t: Tables) -> DataFrame:
    """Plans begin free at the account's creation, have no gaps and end with its closure."""
    accounts = t["account"].select("account_id")
    made = of_type(t["account_lifecycle_event"], "account_created").groupBy("account_id").agg(F.min("event_time").alias("created"))
    bounds = accounts.join(made, "account_id", "left").join(closures(t), "account_id", "left")
    plans = history(t["subscription_plan_period"], "account_id", "subscription_plan_period_id")
    bounded = plans.join(bounds, "account_id")
    return together(
        found(lacking(accounts, plans, account_id="account_id"), "subscription_missing_history", "account_id"),
        found(bounded.where(F.col("is_first") & ((F.col("plan_id") != FREE) | differ("valid_from", "created"))), "subscription_invalid_start", "subscription_plan_period_id"),
        found(plans.where("gap"), "subscription_internal_gap", "subscription_plan_period_id"),
        found(bounded.where(F.col("is_last") & differ("valid_to", "closure_time")), "subscription_invalid_end", "subscription_plan_period_id"),
    )


@rule("DQ-26")
def _(t: Tables) -> DataFrame:
    """A billing period lies in exactly one paid plan period."""
    bills = t["billing_cycle_period"]
    paid = paid_periods(t).select(F.col("account_id").alias("_account"), F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"))
    inside = contained_in(F.col("valid_from"), F.col("valid_to"), F.col("_from"), F.col("_to"))
    n = bills.join(paid, [F.col("account_id") == F.col("_account"), inside], "left").groupBy("billing_cycle_period_id").agg(F.count("_account").alias("n"))
    return found(n.where("n <> 1"), "billing_outside_one_paid_plan", "billing_cycle_period_id")


@rule("DQ-27")
def _(t: Tables) -> DataFrame:
    """Subscription events lie on boundaries of plans and billing cycles, and say what these do."""
    events = t["subscription_lifecycle_event"]
    moved = of_type(events, *PLAN_CHANGES)
    edge = boundaries(t["subscription_plan_period"], "account_id", "plan_id").withColumnRenamed("boundary_time", "event_time")
    paid_end = t["subscription_plan_period"].where(F.col("plan_id") != FREE).groupBy("account_id").agg(F.min("valid_to").alias("paid_before"))
    at = moved.join(edge, ["account_id", "event_time"]).join(paid_end, "account_id", "left")
    rank = F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv])
    old, new, kind = rank[F.col("from_state")], rank[F.col("to_state")], F.col("event_type")
    from_free, to_free = F.col("from_state") == FREE, F.col("to_state") == FREE
    had_paid = F.coalesce(F.col("paid_before") <= F.col("event_time"), F.lit(False))
    unlike = (F.col("from_plan_id").isNotNull() & differ("from_plan_id", "from_state")) | (F.col("to_plan_id").isNotNull() & differ("to_plan_id", "to_state"))
    means = {"subscription_upgraded": new > old, "subscription_downgraded": new < old, "subscription_cancelled": ~from_free & to_free, "subscription_reactivated": from_free & ~to_free & had_paid}
    for name, is_so in means.items():
        unlike = unlike | ((kind == name) & ~is_so)
    renewed = active(of_type(events, "subscription_renewed"), paid_periods(t), ["account_id"], "subscription_plan_period_id", "plans")
    renewed = active(renewed, t["billing_cycle_period"], ["account_id"], "billing_cycle_period_id", "bills")
    turned = of_type(events, "billing_cycle_changed")
    turn = boundaries(t["billing_cycle_period"], "account_id", "billing_cycle").where(differ("from_state", "to_state")).withColumnRenamed("boundary_time", "event_time")
    said = (F.col("from_billing_cycle").isNotNull() & differ("from_billing_cycle", "from_state")) | (F.col("to_billing_cycle").isNotNull() & differ("to_billing_cycle", "to_state"))
    return together(
        found(lacking(moved, edge, account_id="account_id", event_time="event_time"), "plan_transition_without_boundary", "event_id"),
        found(at.where(unlike), "plan_transition_context_or_type_mismatch", "event_id"),
        found(renewed.where("plans <> 1 or bills <> 1"), "renewal_outside_paid_billing_context", "event_id"),
        found(lacking(turned, turn, account_id="account_id", event_time="event_time"), "billing_cycle_change_without_boundary", "event_id"),
        found(turned.join(turn, ["account_id", "event_time"]).where(said), "billing_cycle_change_context_mismatch", "event_id"),
    )


@rule("DQ-28")
def _(t: Tables) -> DataFrame:
    """Nothing of an account's features and commerce outlasts its closure."""
    shut, website = closures(t), t["website"].select("website_id", "account_id")
    late = lambda rows, time: after_closure(rows, shut, "account_id", time=time)
    return together(
        found(late(t["website_feature_enablement_period"].join(website, "website_id"), "valid_to"), "feature_enablement_beyond_closure", "enablement_period_id"),
        found(late(t["feature_enablement_lifecycle_event"].join(website, "website_id"), "event_time"), "feature_event_after_closure", "event_id"),
        found(late(t["subscription_plan_period"], "valid_to"), "subscription_period_beyond_closure", "subscription_plan_period_id"),
        found(late(t["billing_cycle_period"], "valid_to"), "billing_period_beyond_closure", "billing_cycle_period_id"),
        found(late(t["subscription_lifecycle_event"], "event_time"), "subscription_event_after_closure", "event_id"),
        found(late(t["payment_refund_activity_event"], "event_time"), "payment_event_after_closure", "event_id"),
    )


@rule("DQ-29")
def _(t: Tables) -> DataFrame:
    """A payment succeeds within one paid plan and one billing cycle."""
    events = active(of_type(t["payment_refund_activity_event"], "payment_succeeded"), paid_periods(t), ["account_id"], "subscription_plan_period_id", "plans")
    events = active(events, t["billing_cycle_period"], ["account_id"], "billing_cycle_period_id", "bills")
    return found(events.where("plans <> 1 or bills <> 1"), "payment_context", "event_id")


@rule("DQ-30")
def _(t: Tables) -> DataFrame:
    """Who opens a support request is then a member of its account."""
    opened = of_type(t["support_lifecycle_event"], "support_request_opened").select("event_id", "support_request_id", "event_time")
    opened = opened.join(t["support_request"].select("support_request_id", "account_id", F.col("requester_user_id").alias("user_id")), "support_request_id")
    members = member_periods(t).select("user_id", "account_id", "valid_from", "valid_to")
    return found(during(opened, members, ["user_id", "account_id"], how="left_anti"), "support_requester_not_member", "event_id")


@rule("DQ-31")
def _(t: Tables) -> DataFrame:
    """A support request's website, if any, is its account's."""
    website = t["website"].select("website_id", F.col("account_id").alias("website_account"))
    return found(t["support_request"].join(website, "website_id").where(differ("website_account", "account_id")), "support_website_account", "support_request_id")


@rule("DQ-32")
def _(t: Tables) -> DataFrame:
    """A support request is opened once and resolved at most once, in that order."""
    rows = event_stats(t["support_request"], t["support_lifecycle_event"], "support_request_id", "support_request_opened", "support_request_resolved")
    return found(rows.where("firsts <> 1 or lasts > 1 or last_time < first_time"), "support_open_resolve", "support_request_id")


# ---------------------------------------------------------------- runner


def small_partitions(t: Tables) -> None:
    """Ends the joining of shuffled partitions at PARTITION bytes, so that a task's memory does not grow with the tables.

    An option of the session that stays set, as Spark reads it when a result is computed, not when it is declared; a
    smaller value of the session's own is left alone.
    """
    conf, name = t[next(iter(t))].sparkSession.conf, "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = conf.get(name).lower().removesuffix("b")
    size = int(old[:-1]) << {"k": 10, "m": 20, "g": 30, "t": 40}[old[-1]] if old[-1:].isalpha() else int(old)
    if size > PARTITION:
        conf.set(name, str(PARTITION))


def violations(t: Tables, name: str) -> DataFrame:
    """(violation_type, entity_id, at) of one rule."""
    small_partitions(t)
    return RULES[name](t)


def in_turn(t: Tables, results: Callable[[str], DataFrame], names: Iterable[str], schema: str) -> DataFrame:
    """The rows of one small result for each rule, AT_ONCE rules at a time.

    Spark removes what a rule has shuffled as soon as its rows are known, so the disk never holds the shuffles of all rules.
    """
    spark = t[next(iter(t))].sparkSession
    old = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        with ThreadPoolExecutor(AT_ONCE) as pool:
            rows = [tuple(r) for found in pool.map(lambda name: results(name).collect(), names) for r in found]  # a few rows for each rule
    finally:
        spark.conf.set(CLEANUP, old)
    return spark.createDataFrame(rows, schema)


def verdicts(t: Tables, names: Iterable[str] | None = None) -> DataFrame:
    """(rule, violations, status) of all rules or the named ones, which are counted when this is called."""
    return in_turn(t, lambda name: summary({name: violations(t, name)}), RULES if names is None else names, "rule string, violations long, status string")


class Traced(Mapping):
    """Empty tables that remember which of them were asked for."""

    def __init__(self, t: Tables):
        self.t, self.read = t, set()

    def __getitem__(self, name: str) -> DataFrame:
        self.read.add(name)
        return self.t[name].where("false")

    def __iter__(self):
        return iter(self.t)

    def __len__(self) -> int:
        return len(self.t)


def inputs(t: Tables, name: str) -> set[str]:
    """The tables that a rule reads, found by planning it over empty ones; no job reads rows."""
    traced = Traced(t)
    RULES[name](traced)
    return traced.read


def verdicts_after(t: Tables, before: DataFrame, touched: set[str]) -> DataFrame:
    """As ``verdicts``, after a delivery to the ``touched`` tables: rules that read none of them keep their verdict of ``before``.

    Rules that ``before`` lacks are judged too.
    """
    known = {r["rule"] for r in before.select("rule").distinct().collect()}  # one row for each rule
    again = [name for name in RULES if name not in known or inputs(t, name) & touched]
    kept = before.where(F.col("rule").isin([n for n in RULES if n not in again])).select("rule", "violations", "status")
    return kept.unionByName(verdicts(t, again)) if again else kept
