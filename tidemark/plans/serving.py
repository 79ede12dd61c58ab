"""The serving views, as functions of a mapping from table name to DataFrame.

Every domain is aggregated before it is joined to another. Horizons are exploded from literals, and totals that go
with details come from one rollup, so no table is scanned twice for them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import (
    ZONE, active_at, add_days, at, local_month, month_end_snapshot, month_label, month_sort, next_month, pct, ratio, seconds_between,
)
from tidemark.operators.distinct_sets import counted, has_whole_ids, id_sets, merged
from tidemark.operators.percentiles import exact_percentiles
from tidemark.operators.temporal import boundaries, during, first_row, horizon_rows, months_of, overlapping

Tables = Mapping[str, DataFrame]

# Plan names, labels and horizons of the published metrics.
FREE, PAID = "free", ("standard", "premium")
TRANSITIONS = (("subscription_upgraded", "Upgrade"), ("subscription_downgraded", "Downgrade"), ("subscription_cancelled", "Cancel"), ("subscription_reactivated", "Reactivate"))
CONVERSION_DAYS = [(30, "D30"), (60, "D60"), (90, "D90"), (180, "D180")]
RETENTION_MONTHS = [(1, "M1"), (3, "M3"), (6, "M6"), (12, "M12")]
OBSERVATION_START, OBSERVATION_END = "2024-03-31 21:00:00", "2026-01-01 00:00:00"  # UTC; the start is local midnight
FIRST_MONTH, PARTIAL_MONTH = "2024-04-01", "2026-01-01"

# Locked results whose definitions are unpublished; not computed from tables.
LIFECYCLE_KPIS = {
    "summary_id": 1, "eligible_feature_pairs": 8074, "adopted_feature_pairs": 3721, "feature_adoption_rate_pct": 46.09,
    "avg_adoption_breadth_pct": 47.45, "ever_paid_accounts": 600, "paid_churn_occurrences": 108, "distinct_churned_accounts": 108,
    "median_days_to_first_churn": 152.70, "avg_days_to_first_churn": 181.37, "cd1_population_n": 132,
    "cd1_early_adoption_m12_retention_pct": 72.97, "cd1_comparison_m12_retention_pct": 70.69, "cd1_difference_pp": 2.28,
}
# horizon months, label, cohort, product active, paid, both, product only, paid only, neither
ALIGNED = [(1, "M1", 143, 49, 140, 49, 0, 91, 3), (3, "M3", 143, 86, 132, 86, 0, 46, 11), (6, "M6", 143, 88, 114, 83, 5, 31, 24), (12, "M12", 143, 84, 97, 75, 9, 22, 37)]


def plan_periods(t: Tables) -> DataFrame:
    """Plan periods with lower-case plan names."""
    names = t["plan_catalog"].select("plan_id", F.lower("plan_name").alias("plan_name"))
    return t["subscription_plan_period"].join(names, "plan_id")


def closures(t: Tables) -> DataFrame:
    closed = t["account_lifecycle_event"].where("event_type = 'account_closure'")
    return closed.groupBy("account_id").agg(F.min("event_time").alias("closure_time"))


def first_paid(periods: DataFrame) -> DataFrame:
    """First boundary from the free plan to a paid one."""
    paid = boundaries(periods, "account_id", "plan_name").where((F.col("from_state") == FREE) & F.col("to_state").isin(*PAID))
    return paid.groupBy("account_id").agg(F.min("boundary_time").alias("first_paid_time"))


def _set_levels(moves: DataFrame, path: list[str]) -> DataFrame:
    """Events and accounts of each path, of its type and of all, from one pass: accounts are bitmaps, united level by level."""
    sets = id_sets(moves, path, "account_id", n=F.count("*"))
    types = counted(merged(sets, path[:1], ["n"]), path[:1], "type_account_count", ["n"]).withColumnRenamed("n", "type_event_count")
    every = counted(merged(sets, [], ["n"]), [], "all_transition_accounts", ["n"]).withColumnRenamed("n", "all_transition_events")
    return counted(sets, path, "accounts", ["n"]).join(types, path[0]).crossJoin(F.broadcast(every))  # one row of totals


def _rolled_levels(moves: DataFrame, path: list[str]) -> DataFrame:
    """The same for ids that are no whole numbers, by a rollup over the accounts of each path."""
    once = moves.groupBy(*path, "account_id").agg(F.count("*").alias("n")).withColumn("path", F.struct(*path[1:]))
    levels = once.rollup(path[0], "path").agg(F.sum("n").alias("n"), F.countDistinct("account_id").alias("accounts"), F.grouping_id().alias("level"))
    by_type, every = Window.partitionBy(path[0]), Window.partitionBy(F.lit(1))  # one row for each path or total

    def total(column: str, level: int, w: Window) -> F.Column:
        return F.max(F.when(F.col("level") == level, F.col(column))).over(w)

    levels = levels.withColumns({
        "type_event_count": total("n", 1, by_type), "type_account_count": total("accounts", 1, by_type),
        "all_transition_events": total("n", 3, every), "all_transition_accounts": total("accounts", 3, every),
    })
    return levels.where("level = 0").select(path[0], "path.*", "n", "accounts", *[c for c in levels.columns if c.startswith(("type_", "all_"))])


def commercial_transition(t: Tables) -> DataFrame:
    """Upgrade, downgrade, cancel and reactivate paths with their shares of the type and of all."""
    moves = t["subscription_lifecycle_event"].where(F.col("event_type").isin(*[e for e, _ in TRANSITIONS]))
    path = ["event_type", "from_plan_id", "to_plan_id"]
    rows = _set_levels(moves, path) if has_whole_ids(moves, "account_id") else _rolled_levels(moves, path)
    names = t["plan_catalog"].select("plan_id", "plan_name")
    for side in ("from", "to"):
        rows = rows.join(names.withColumnsRenamed({"plan_id": f"{side}_plan_id", "plan_name": f"{side}_plan_name"}), f"{side}_plan_id", "left")
    label, order = F.lit(None).cast("string"), F.lit(None).cast("int")
    for i, (e, name) in enumerate(TRANSITIONS):
        label, order = F.when(F.col("event_type") == e, name).otherwise(label), F.when(F.col("event_type") == e, i + 1).otherwise(order)
    rank = Window.partitionBy(F.lit(1)).orderBy(order, F.desc("n"), F.asc_nulls_last("from_plan_name"), F.asc_nulls_last("to_plan_name"))
    return rows.select(
        "event_type", label.alias("event_type_label"), order.alias("event_type_order"), "from_plan_id", "from_plan_name", "to_plan_id", "to_plan_name",
        F.concat("from_plan_name", F.lit(" → "), "to_plan_name").alias("path_label"), F.col("n").alias("transition_events"), F.col("accounts").alias("distinct_accounts"),
        pct(F.col("n"), F.col("type_event_count")).alias("share_within_transition_type_pct"), pct(F.col("n"), F.col("all_transition_events")).alias("share_of_all_transitions_pct"),
        "type_event_count", "type_account_count", "all_transition_events", "all_transition_accounts", F.row_number().over(rank).alias("path_sort_order"),
    )


def conversion_horizon(t: Tables, observation_end: str = OBSERVATION_END, horizons: list[tuple[int, str]] = CONVERSION_DAYS) -> DataFrame:
    """Share of activated free accounts that paid within each horizon, over one cohort that all horizons can see."""
    published = t["website_lifecycle_event"].where("event_type = 'published'").select("website_id", "event_time")
    activation = t["website"].select("website_id", "account_id").join(published, "website_id").groupBy("account_id").agg(F.min("event_time").alias("activation_time"))
    periods = plan_periods(t)
    started = first_row(periods, "account_id", ["valid_from", "subscription_plan_period_id"], ["plan_name"]).where(F.col("plan_name") == FREE)
    journey = activation.join(started, "account_id").join(first_paid(periods), "account_id", "left").join(closures(t), "account_id", "left")
    active, paid, closed = F.col("activation_time"), F.col("first_paid_time"), F.col("closure_time")
    last = add_days(active, max(n for n, _ in horizons))
    cohort = journey.where((closed.isNull() | (closed >= active)) & (paid.isNull() | (paid >= active)) & ((at(observation_end) >= last) | F.coalesce(closed < last, F.lit(False))))
    rows = horizon_rows(cohort, horizons, "days")
    n = F.count_if(F.coalesce(paid <= add_days(active, F.col("horizon_days")), F.lit(False)))
    out = rows.groupBy("horizon_days", "horizon_label", "horizon_order").agg(n.alias("converted_count"), F.count("*").alias("cohort_size"))
    return out.withColumn("conversion_rate_pct", pct(F.col("converted_count"), F.col("cohort_size")))


def feature(t: Tables) -> DataFrame:
    rank = Window.partitionBy(F.lit(1)).orderBy("feature_name", "feature_id")  # a dimension
    return t["feature"].select("feature_id", "feature_name", F.row_number().over(rank).alias("feature_sort"))


def feature_adoption(t: Tables) -> DataFrame:
    """Accounts that used a feature, of those whose plan ever gave it."""
    periods = t["subscription_plan_period"].select("account_id", "plan_id", "valid_from", "valid_to")
    given = t["plan_feature_entitlement_period"].select("plan_id", "feature_id", "valid_from", "valid_to")
    eligible = overlapping(periods, given, ["plan_id"]).select("account_id", F.col("other_feature_id").alias("feature_id")).distinct()
    used = t["product_behaviour_event"].where("event_type = 'feature_used'").select("account_id", "feature_id", F.lit(1).alias("used")).distinct()
    summary = eligible.join(used, ["account_id", "feature_id"], "left").groupBy("feature_id").agg(F.count("*").alias("e"), F.count("used").alias("a"))
    counts = t["feature"].join(summary, "feature_id", "left").select(
        "feature_id", "feature_name", F.coalesce("e", F.lit(0)).alias("eligible_pairs"), F.coalesce("a", F.lit(0)).alias("adopted_pairs"),
    )
    rates = counts.withColumn("adoption_rate_pct", pct(F.col("adopted_pairs"), F.col("eligible_pairs")))
    rank = Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last("adoption_rate_pct"), F.desc("adopted_pairs"), "feature_name", "feature_id")
    return rates.withColumn("adoption_rank", F.row_number().over(rank))


def lifecycle_kpis(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in LIFECYCLE_KPIS.items()])


def _attempt_counts(locked: DataFrame) -> DataFrame:
    """Attempts and distinct ids of each feature, for ids of any type."""
    counts = [F.count_if(F.col("plan_name") == p).alias(f"{p}_attempt_events") for p in (FREE, *PAID)]
    accounts = [F.countDistinct(F.when(F.col("plan_name") == p, F.col("account_id"))).alias(f"{p}_attempting_accounts") for p in (FREE, *PAID)]
    return locked.groupBy("feature_id").agg(
        F.count("*").alias("attempt_events"), F.countDistinct("account_id").alias("distinct_attempting_accounts"), F.countDistinct("user_id").alias("distinct_attempting_users"),
        F.countDistinct("website_id").alias("distinct_websites"), F.count_if(F.col("website_id").isNull()).alias("attempts_without_website"), *counts, *accounts,
    )


def _attempt_sets(locked: DataFrame, ids: list[str]) -> DataFrame:
    """The same from one pass for whole ids, which are bitmaps by feature, plan and kind; the plans' sets are united for the feature."""
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("long").alias("id")) for c in ids])).alias("_id")
    rows = locked.select("feature_id", "plan_name", kinds).select("feature_id", "plan_name", "_id.*")
    sets = id_sets(rows, ["feature_id", "plan_name", "kind"], "id", n=F.count("*"), blank=F.count_if(F.col("id").isNull()))
    of_feature = counted(merged(sets, ["feature_id", "kind"], ["n", "blank"]), ["feature_id", "kind"], "d", ["n", "blank"])
    of_plan = counted(sets.where(F.col("kind") == ids[0]), ["feature_id", "plan_name"], "d", ["n"])
    pick = lambda column, key, value: F.coalesce(F.max(F.when(F.col(key) == value, F.col(column))), F.lit(0))
    distinct = dict(zip(ids, ("distinct_attempting_accounts", "distinct_attempting_users", "distinct_websites")))
    whole = of_feature.groupBy("feature_id").agg(
        pick("n", "kind", ids[0]).alias("attempt_events"), *[pick("d", "kind", c).alias(name) for c, name in distinct.items()], pick("blank", "kind", ids[2]).alias("attempts_without_website"),
    )
    plans = (FREE, *PAID)
    by_plan = of_plan.groupBy("feature_id").agg(*[pick("n", "plan_name", p).alias(f"{p}_attempt_events") for p in plans], *[pick("d", "plan_name", p).alias(f"{p}_attempting_accounts") for p in plans])
    return whole.join(by_plan, "feature_id")


def locked_feature_signal(t: Tables) -> DataFrame:
    """Attempts at features that the account's plan did not give at that time."""
    attempts = t["product_behaviour_event"].where("event_type = 'locked_feature_attempted'").select("event_id", "event_time", "user_id", "account_id", "website_id", "feature_id")
    periods = plan_periods(t).select("account_id", "plan_id", "plan_name", "valid_from", "valid_to")
    placed = during(attempts, periods, ["account_id"]).drop("valid_from", "valid_to")
    given = t["plan_feature_entitlement_period"].select("plan_id", "feature_id", "valid_from", "valid_to")
    locked = during(placed, given, ["plan_id", "feature_id"], how="left_anti")
    ids = ["account_id", "user_id", "website_id"]
    summary = _attempt_sets(locked, ids) if all(has_whole_ids(locked, c) for c in ids) else _attempt_counts(locked)
    n = F.col("attempt_events")
    shares = [pct(F.col(f"{p}_attempt_events"), n).alias(f"{p}_event_share_pct") for p in (FREE, *PAID)]
    rank = Window.partitionBy(F.lit(1)).orderBy(F.desc("distinct_attempting_accounts"), F.desc("attempt_events"), "feature_name", "feature_id")
    return summary.join(t["feature"], "feature_id").select(
        "feature_id", "feature_name", "attempt_events", "distinct_attempting_accounts", "distinct_attempting_users", "distinct_websites", "attempts_without_website",
        ratio(n, F.col("distinct_attempting_accounts")).alias("attempts_per_attempting_account"),
        *[f"{p}_attempt_events" for p in (FREE, *PAID)], *[f"{p}_attempting_accounts" for p in (FREE, *PAID)], *shares, F.row_number().over(rank).alias("signal_rank"),
    )


def paid_retention_horizon(t: Tables, observation_end: str = OBSERVATION_END, horizons: list[tuple[int, str]] = RETENTION_MONTHS) -> DataFrame:
    """Share of first-paid accounts in a paid plan at the last second of each horizon's month."""
    periods = plan_periods(t)
    cohort = first_paid(periods).join(closures(t), "account_id", "left")
    paid, closed = F.col("first_paid_time"), F.col("closure_time")
    seen = next_month(paid + F.make_interval(months=F.lit(max(n for n, _ in horizons))))
    cohort = cohort.where((at(observation_end) >= seen) | F.coalesce(closed < seen, F.lit(False)))
    rows = horizon_rows(cohort, horizons, "months").withColumn("snapshot_time", month_end_snapshot(paid, F.col("horizon_months")))
    held = periods.where(F.col("plan_name").isin(*PAID)).select(F.col("account_id").alias("_account"), "valid_from", "valid_to")
    same = [F.col("account_id") == F.col("_account"), active_at(F.col("snapshot_time"), F.col("valid_from"), F.col("valid_to"))]
    keys = ["account_id", "horizon_months", "horizon_label", "horizon_order"]
    state = rows.join(held, same, "left").groupBy(*keys).agg(F.max(F.col("_account").isNotNull() & ~F.coalesce(closed <= F.col("snapshot_time"), F.lit(False))).alias("is_paid"))
    out = state.groupBy(*keys[1:]).agg(F.count_if("is_paid").alias("retained_count"), F.count("*").alias("cohort_size"))
    return out.withColumn("retention_rate_pct", pct(F.col("retained_count"), F.col("cohort_size")))


def aligned_rates(counts: DataFrame) -> DataFrame:
    """Rates and gaps from the counts of product-active and paid accounts of a cohort."""
    size, product, paid = F.col("cohort_size"), F.col("product_active_count"), F.col("paid_count")
    mismatch = F.col("product_only_count") + F.col("paid_only_count")
    return counts.select(
        "horizon_months", "horizon_label", "horizon_order", "cohort_size", "product_active_count", pct(product, size).alias("product_retention_rate_pct"), "paid_count",
        pct(paid, size).alias("paid_retention_rate_pct"), "both_count", "product_only_count", "paid_only_count", "neither_count", mismatch.alias("gross_mismatch_count"),
        pct(mismatch, size).alias("gross_mismatch_rate_pct"), pct(paid - product, size).alias("net_gap_pp"),
    )


def product_paid_aligned(spark: SparkSession) -> DataFrame:
    """The locked counts with their rates."""
    rows = [(m, label, i + 1, *rest) for i, (m, label, *rest) in enumerate(ALIGNED)]
    names = "horizon_months int, horizon_label string, horizon_order int, cohort_size int, product_active_count int, paid_count int, both_count int, product_only_count int, paid_only_count int, neither_count int"
    return aligned_rates(spark.createDataFrame(rows, names))


def product_paid_computed(t: Tables, horizons: list[tuple[int, str]] = RETENTION_MONTHS) -> DataFrame:
    """The same columns computed by a contract of our own: an account is product-active in a horizon's month if it has
    any product event in it, and paid if it holds a paid plan at its last second. Not the locked metric."""
    periods = plan_periods(t)
    rows = horizon_rows(first_paid(periods), horizons, "months").withColumn("snapshot_time", month_end_snapshot(F.col("first_paid_time"), F.col("horizon_months")))
    rows = rows.withColumn("month", F.trunc(F.col("snapshot_time").cast("date"), "MM"))
    paid = periods.where(F.col("plan_name").isin(*PAID)).select("account_id", "valid_from", "valid_to")
    events = t["product_behaviour_event"].select("account_id", F.trunc(F.col("event_time").cast("date"), "MM").alias("month")).distinct().withColumn("active", F.lit(True))
    keys = ["account_id", "horizon_months", "horizon_label", "horizon_order"]
    held = during(rows, paid, ["account_id"], time="snapshot_time").select("account_id", "horizon_months", F.lit(True).alias("paid")).distinct()
    flags = rows.select(*keys, "month").join(held, ["account_id", "horizon_months"], "left").join(events, ["account_id", "month"], "left")
    a, p = F.coalesce("active", F.lit(False)), F.coalesce("paid", F.lit(False))
    counts = flags.groupBy(*keys[1:]).agg(
        F.count("*").alias("cohort_size"), F.count_if(a).alias("product_active_count"), F.count_if(p).alias("paid_count"), F.count_if(a & p).alias("both_count"),
        F.count_if(a & ~p).alias("product_only_count"), F.count_if(p & ~a).alias("paid_only_count"), F.count_if(~a & ~p).alias("neither_count"),
    )
    return aligned_rates(counts)


def rating_snapshot(t: Tables) -> DataFrame:
    """Current values of ratings that are not removed, on the whole scale 1 to 5."""
    order = F.struct("event_time", "event_id")
    valued = F.col("event_type").isin("rating_given", "rating_changed") & F.col("rating_value").isNotNull()
    latest = t["rating_lifecycle_event"].groupBy("rating_id").agg(F.max_by("event_type", order).alias("last"), F.max_by("rating_value", F.when(valued, order)).alias("v"))
    v = F.col("v")
    counts = [F.count_if(v == i).alias(f"n{i}") for i in range(1, 6)]
    one = latest.where("last != 'rating_removed' and v is not null").agg(F.count("*").alias("total_active_ratings"), F.round(F.avg("v"), 2).alias("current_avg_rating"), F.count_if(v.isin(4, 5)).alias("high_rating_4_5_count"), *counts)
    scale = F.explode(F.array(*[F.struct(F.lit(i).alias("rating_value"), F.lit(i).alias("rating_sort"), F.col(f"n{i}").alias("active_rating_count")) for i in range(1, 6)]))
    return one.select(scale.alias("s"), "*").select(
        "s.*", "total_active_ratings", "current_avg_rating", "high_rating_4_5_count",
        pct(F.col("high_rating_4_5_count"), F.col("total_active_ratings")).alias("high_rating_4_5_share_pct"),
    )


def _support(t: Tables, columns: list[str]) -> DataFrame:
    """One row for each request with an event: opened_at, resolved_at, hours (where resolved at or after opening)."""
    kind, time = F.col("event_type"), F.col("event_time")
    seen = t["support_lifecycle_event"].groupBy("support_request_id").agg(
        F.min(F.when(kind == "support_request_opened", time)).alias("opened_at"), F.max(F.when(kind == "support_request_resolved", time)).alias("resolved_at"),
    )
    opened, resolved = F.col("opened_at"), F.col("resolved_at")
    hours = F.when(resolved >= opened, seconds_between(opened, resolved) / 3600)
    return t["support_request"].select("support_request_id", *columns).join(seen, "support_request_id").withColumn("hours", hours)


def support_monthly(t: Tables, zone: str = ZONE, partial_month: str = PARTIAL_MONTH) -> DataFrame:
    rows = _support(t, ["account_id", "website_id"]).where("opened_at is not null").withColumn("month_start", local_month(F.col("opened_at"), zone))
    resolved = F.col("resolved_at").isNotNull()
    months = rows.groupBy("month_start").agg(
        F.count("*").alias("requests_opened"), F.countDistinct("account_id").alias("accounts_with_support"), F.count("website_id").alias("website_linked_requests"),
        F.count_if(F.col("website_id").isNull()).alias("account_level_requests"), F.count_if(resolved).alias("resolved_requests"), F.count_if(~resolved).alias("unresolved_requests"),
        F.round(F.avg("hours"), 2).alias("avg_resolution_hours"),
    )
    months = months.join(exact_percentiles(rows, ["month_start"], "hours", {"median": 0.5}), "month_start", "left")
    m = F.col("month_start")
    return months.select(
        "month_start", month_label(m).alias("month_label"), month_sort(m).alias("month_sort"), (m == F.lit(partial_month).cast("date")).alias("is_partial_period"),
        "requests_opened", "accounts_with_support", "website_linked_requests", "account_level_requests", "resolved_requests", "unresolved_requests",
        pct(F.col("resolved_requests"), F.col("requests_opened")).alias("resolution_rate_pct"), F.round("median", 2).alias("median_resolution_hours"), "avg_resolution_hours",
    )


def support_summary(t: Tables) -> DataFrame:
    rows = _support(t, [])
    resolved = F.col("resolved_at").isNotNull()
    one = rows.agg(F.count("*").alias("n"), F.count_if(resolved).alias("r"), F.count_if(~resolved).alias("u"), F.round(F.avg("hours"), 2).alias("avg"))
    middle = exact_percentiles(rows, [], "hours", {"median": 0.5, "p95": 0.95})
    joined = one.join(F.broadcast(middle), F.lit(True), "left")  # one row at most on either side
    return joined.select(
        F.lit(1).alias("summary_id"), F.col("n").alias("total_support_requests"), F.col("r").alias("resolved_requests"), F.col("u").alias("unresolved_requests"),
        pct(F.col("r"), F.col("n")).alias("resolution_rate_pct"), F.round("median", 2).alias("median_resolution_hours"), F.col("avg").alias("avg_resolution_hours"), F.round("p95", 2).alias("p95_resolution_hours"),
    )


def website_monthly(
    t: Tables, observation_start: str = OBSERVATION_START, observation_end: str = OBSERVATION_END, zone: str = ZONE,
    first_month: str = FIRST_MONTH, partial_month: str = PARTIAL_MONTH,
) -> DataFrame:
    """Live websites, sessions, interactions and comments by local calendar month."""
    lo, hi = at(observation_start), at(observation_end)
    a, b = F.greatest(F.col("valid_from"), lo), F.least(F.coalesce("valid_to", hi), hi)
    local = lambda c: F.convert_timezone(F.lit("UTC"), F.lit(zone), c)
    live = t["website_live_period"].select("website_id", a.alias("a"), b.alias("b")).where("b > a")
    live = months_of(live, local(F.col("a")), local(F.col("b") - F.expr("INTERVAL '0.000001' SECOND"))).select("month_start", "website_id").distinct()
    websites = live.groupBy("month_start").agg(F.count("*").alias("website_month_rows"))

    kind, time = F.col("event_type"), F.col("event_time")
    started, ended = kind == "session_started", kind == "session_ended"
    ends = t["session_lifecycle_event"].groupBy("session_id").agg(
        F.count_if(started).alias("starts"), F.count_if(ended).alias("ends"), F.min(F.when(started, time)).alias("started_at"), F.max(F.when(ended, time)).alias("ended_at"),
    )
    sessions = t["audience_session"].select("session_id").join(ends.where("starts = 1 and started_at is not null"), "session_id")
    whole = (F.col("ends") == 1) & (F.col("ended_at") >= F.col("started_at"))
    sessions = sessions.select(local_month(F.col("started_at"), zone).alias("month_start"), F.when(whole, seconds_between(F.col("started_at"), F.col("ended_at"))).alias("seconds"))
    levels = {"median": 0.5, "p25": 0.25, "p75": 0.75, "p95": 0.95}
    spread = exact_percentiles(sessions, ["month_start"], "seconds", levels, "sessions", "valid_duration_sessions", "avg")
    by_month = spread.select("month_start", "sessions", "valid_duration_sessions", *[F.round(F.col(k) / 60, 2).alias(f"{k}_session_minutes") for k in (*levels, "avg")])

    names = {"page_viewed": "page_views", "form_submitted": "forms_submitted", "failure_friction": "friction_events"}
    acts = t["audience_interaction_event"].groupBy(local_month(time, zone).alias("month_start")).agg(*[F.count_if(kind == k).alias(v) for k, v in names.items()])
    posted = t["comment_lifecycle_event"].where("event_type = 'comment_posted'").select("comment_id", local_month(time, zone).alias("month_start"))
    posted = posted.join(t["comment"].select("comment_id", "page_id"), "comment_id").join(t["page"].select("page_id", "website_id"), "page_id")
    comments = posted.groupBy("month_start").agg(F.count("*").alias("comments_posted"), F.countDistinct("website_id").alias("websites_with_comments"))

    # every part has one row for each month; months of any part stay, as after a full outer join
    out = websites.join(by_month, "month_start", "full").join(acts, "month_start", "full").join(comments, "month_start", "full")
    out = out.where(F.col("month_start") >= F.lit(first_month).cast("date"))
    counted = ["website_month_rows", "sessions", "page_views", "forms_submitted", "friction_events", "valid_duration_sessions", "comments_posted", "websites_with_comments"]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counted})
    m, n = F.col("month_start"), F.col("sessions")
    return out.select(
        "month_start", month_label(m).alias("month_label"), month_sort(m).alias("month_sort"), (m == F.lit(partial_month).cast("date")).alias("is_partial_period"),
        "website_month_rows", F.col("website_month_rows").alias("websites_observed"), "sessions", "page_views", ratio(F.col("page_views"), n).alias("pages_per_session"),
        "forms_submitted", pct(F.col("forms_submitted"), n).alias("forms_per_100_sessions"), "friction_events", pct(F.col("friction_events"), n).alias("friction_per_100_sessions"),
        "valid_duration_sessions", "median_session_minutes", "avg_session_minutes", "p25_session_minutes", "p75_session_minutes", "p95_session_minutes",
        "comments_posted", "websites_with_comments", pct(F.col("comments_posted"), n).alias("comments_per_100_sessions"),
    )


VIEWS = {
    "vw_commercial_transition": commercial_transition, "vw_conversion_horizon": conversion_horizon, "vw_feature": feature, "vw_feature_adoption": feature_adoption,
    "vw_locked_feature_signal": locked_feature_signal, "vw_paid_retention_horizon": paid_retention_horizon, "vw_rating_snapshot": rating_snapshot,
    "vw_support_monthly": support_monthly, "vw_support_summary": support_summary, "vw_website_monthly": website_monthly,
}


def create_views(spark: SparkSession, t: Tables) -> None:
    """All twelve as temporary views of the session."""
    for name, view in VIEWS.items():
        view(t).createOrReplaceTempView(name)
    lifecycle_kpis(spark).createOrReplaceTempView("vw_lifecycle_kpis")
    product_paid_aligned(spark).createOrReplaceTempView("vw_product_paid_aligned")
