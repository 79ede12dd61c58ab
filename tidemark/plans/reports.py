"""Reports over the model's data set, rules and operational tables: long reports, baselines, sweeps, calendars, visuals."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.percentiles import exact_percentiles
from tidemark.plans import retention_model, rules

Tables = Mapping[str, DataFrame]
COUNTED = ("product_access_count", "locked_attempt_count", "feature_used_count", "analytics_view_count", "other_event_count")
THRESHOLDS = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)


def section(df: DataFrame, name: str, part: Column, metrics: dict[str, Column]) -> DataFrame:
    """Long rows (section, part, metric, value) of a frame with one row for each part."""
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in metrics.items()])
    return df.select(F.lit(name).alias("section"), part.cast("string").alias("part"), F.explode(pairs).alias("m")).select("section", "part", "m.metric", "m.value")


def data_set_report(rows: DataFrame, features: list[str] = retention_model.FEATURES, target: str = "target_m6") -> DataFrame:
    """(section, part, metric, value): volumes by split and for all, quality of each feature, and what must be zero.

    Sections without parts have a null part. ``reconciliation`` counts rows that contradict others: accounts that come
    twice, totals that are not the sum of their types, more live websites than created ones, negative features.
    """
    known = F.col(target).isNotNull()
    sets = rows.rollup("split_name").agg(
        F.count("*").alias("accounts"), F.count_if(known).alias("known"), F.count_if(F.col(target) == 1).alias("paid"), F.count_if(F.col(target) == 0).alias("not_paid"), F.grouping_id().alias("_all"),
    )
    volume = section(sets, "volume", F.when(F.col("_all") == 1, "ALL").otherwise(F.col("split_name")), {c: F.col(c) for c in ("accounts", "known", "paid", "not_paid")})
    quality = []
    for f in features:
        quality += [F.count_if(F.col(f).isNull()).alias(f"nulls_{f}"), F.count_if(F.col(f) != 0).alias(f"nonzero_{f}"), F.max(F.col(f).cast("double")).alias(f"largest_{f}")]
    one = rows.agg(F.count("*").alias("rows"), *quality)
    by_feature = [section(one, "feature", F.lit(f), {
        "nulls": F.col(f"nulls_{f}"), "nonzero": F.col(f"nonzero_{f}"), "nonzero_pct": F.round(F.col(f"nonzero_{f}") * 100.0 / F.nullif(F.col("rows"), F.lit(0)), 2), "largest": F.round(f"largest_{f}", 6),
    }) for f in features]
    unlike = F.col("total_product_events") != sum((F.col(c) for c in COUNTED), F.lit(0))
    negative = reduce(lambda a, b: a | b, [F.coalesce(F.col(f) < 0, F.lit(False)) for f in features])
    checks = rows.agg(
        (F.count("*") - F.count_distinct("account_id")).alias("repeated_accounts"), F.count_if(unlike).alias("totals_unlike_sums"),
        F.count_if(F.col("live_websites_at_first_paid") > F.col("websites_created_before_paid")).alias("more_live_than_created"), F.count_if(negative).alias("negative_features"),
    )
    return reduce(DataFrame.unionAll, [volume, *by_feature, section(checks, "reconciliation", F.lit(None), {c: F.col(c) for c in checks.columns})])


def always_paid(rows: DataFrame, target: str = "target_m6") -> DataFrame:
    """Metrics, by split and for all, of the guess that every account stays paid; unknown targets are left out."""
    known = rows.where(F.col(target).isNotNull())
    sets = known.rollup("split_name").agg(F.count("*").alias("accounts"), F.count_if(F.col(target) == 1).alias("tp"), F.count_if(F.col(target) == 0).alias("fp"), F.grouping_id().alias("_all"))
    share = F.round(F.col("tp") / F.nullif(F.col("accounts"), F.lit(0)), 6)
    sides = (F.when(F.col("tp") > 0, 1.0).otherwise(0.0) / 2).alias("balanced_accuracy")
    return sets.select(
        F.when(F.col("_all") == 1, "ALL").otherwise(F.col("split_name")).alias("split_name"), "accounts", "tp", "fp", share.alias("accuracy"), sides, share.alias("precision_1"),
        F.when(F.col("tp") > 0, 1.0).otherwise(0.0).alias("recall_1"), F.lit(0.0).alias("recall_0"),
    )


def feature_medians(rows: DataFrame, features: list[str] = retention_model.FEATURES, target: str = "target_m6") -> DataFrame:
    """(feature, target, rows, median, mean): each feature's middle by class."""
    long = rows.where(F.col(target).isNotNull()).select(F.col(target).alias("target"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("m"))
    long = long.select("target", "m.*")
    middle = exact_percentiles(long, ["feature", "target"], "value", {"median": 0.5})
    mean = long.groupBy("feature", "target").agg(F.count("value").alias("rows"), F.round(F.avg("value"), 6).alias("mean"))
    return mean.join(middle, ["feature", "target"]).select("feature", "target", "rows", F.round("median", 6).alias("median"), "mean")


def threshold_sweep(scored: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    found = retention_model.confusion(scored, list(thresholds))
    return found.select("threshold", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("accuracy", "balanced_accuracy", "precision_0", "recall_0", "f1_0")])


def coefficients(model, rows: DataFrame, features: list[str] = retention_model.FEATURES) -> DataFrame:
    """(feature, coefficient, odds_ratio, rank) of a fitted pipeline, on standardised features; the intercept has a null rank."""
    fitted = model.stages[-1]
    table = [(f, float(c)) for f, c in zip(features, fitted.coefficients.toArray())]  # one row for each feature
    order = sorted(table, key=lambda x: (-abs(x[1]), x[0]))
    out = [(f, c, float(2.718281828459045**c), i + 1) for i, (f, c) in enumerate(order)] + [("(intercept)", float(fitted.intercept), None, None)]
    return rows.sparkSession.createDataFrame(out, "feature string, coefficient double, odds_ratio double, rank int")


def samples(t: Tables, n: int = 5) -> DataFrame:
    """(rule, violation_type, entity_id, at): the first n violations of each rule that has any, in a fixed order; found when this is called."""

    def first(name: str) -> DataFrame:
        return rules.violations(t, name).orderBy("violation_type", "entity_id", "at").limit(n).select(F.lit(name).alias("rule"), "violation_type", "entity_id", "at")

    return rules.in_turn(t, first, rules.RULES, "rule string, violation_type string, entity_id string, at timestamp_ntz")


def passed(verdicts: DataFrame) -> bool:
    """Whether no rule has a violation; what a scheduled check would return as its exit code."""
    return verdicts.where("violations > 0").isEmpty()


def calendar(times: DataFrame, time: str) -> DataFrame:
    """A row for each day from the first January 1st to the last December 31st of the years that occur; none for no times."""
    ends = times.agg(F.min(time).alias("a"), F.max(time).alias("b")).where("a is not null")
    days = ends.select(F.explode(F.sequence(F.trunc(F.col("a").cast("date"), "year"), F.make_date(F.year("b"), F.lit(12), F.lit(31)), F.expr("INTERVAL 1 DAY"))).alias("date"))
    d = F.col("date")
    return days.select("date", F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month_no"), F.date_format(d, "MMMM").alias("month"), F.day(d).alias("day"))


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """(value, rows, share): how often each value occurs, null among them, and its share of all rows."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows"))
    every = df.agg(F.count("*").alias("_all"))
    return counts.crossJoin(F.broadcast(every)).select("value", "rows", F.round(F.col("rows") / F.col("_all"), 6).alias("share"))  # one row of totals


def visual(
    view: DataFrame, by: list[str], totals: list[str], keep: dict[str, list] | None = None, order: str | None = None, relations: list[tuple[DataFrame, str]] | None = None,
    page: dict[str, list] | None = None, ignore: tuple[str, ...] = (),
) -> DataFrame:
    """What a report shows of a view: many-to-one relations joined, kept values (slicers, categories), sums by ``by``.

    ``order`` names the total by which rows are ranked, largest first; equal ones follow ``by``. ``page`` has the values
    kept by the page's slicers and by clicks on other visuals, of which the columns in ``ignore`` do not reach this one.
    """
    rows = view
    for other, key in relations or []:
        rows = rows.join(other, key, "left")
    kept = [*(keep or {}).items(), *[(c, v) for c, v in (page or {}).items() if c not in ignore]]
    for column, values in kept:
        rows = rows.where(F.col(column).isin(values))
    out = rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in totals])
    if order:
        out = out.withColumn("sort", F.row_number().over(Window.orderBy(F.desc(order), *by)))  # a visual has as many rows as it shows
    return out


def imperfections(t: Tables) -> DataFrame:
    """(imperfection, rows, of): known irregularities of the operational tables, beside all rows that could have them."""
    started = t["session_lifecycle_event"].where("event_type = 'session_started'").groupBy("session_id").agg(F.min("event_time").alias("started_at"))
    late = t["session_member_attribution"].join(started, "session_id")
    none = lambda df, column: df.agg(F.count_if(F.col(column).isNull()).alias("rows"), F.count("*").alias("of"))
    parts = {
        "late_session_attribution": late.agg(F.count_if(F.col("attributed_at") > F.col("started_at") + F.expr("INTERVAL 1 DAY")).alias("rows"), F.count("*").alias("of")),
        "product_event_without_website": none(t["product_behaviour_event"], "website_id"), "signup_without_account": none(t["signup_journey_context"], "resulting_account_id"),
        "interaction_without_page": none(t["audience_interaction_event"], "page_id"), "open_membership_period": none(t["user_account_membership_period"], "valid_to"),
    }
    return reduce(DataFrame.unionAll, [df.select(F.lit(name).alias("imperfection"), "rows", "of") for name, df in parts.items()])


def in_range(measured: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """(imperfection, share, low, high, status): whether each share of ``imperfections`` lies in its range, ends included."""
    wanted = measured.sparkSession.createDataFrame([(k, float(a), float(b)) for k, (a, b) in ranges.items()], "imperfection string, low double, high double")
    share = F.round(F.col("rows") / F.nullif(F.col("of"), F.lit(0)), 6)
    found = wanted.join(measured, "imperfection", "left").select("imperfection", share.alias("share"), "low", "high")
    return found.withColumn("status", F.when(F.col("share").between(F.col("low"), F.col("high")), "PASS").otherwise("FAIL"))
