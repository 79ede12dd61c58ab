"""Features and labels of the retention model: what was known at an account's first payment, and its state months later.

First paid here is the earliest start of a paid plan period, unlike the serving views' first boundary from free.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import active_at, add_months, at, live_at, quarter_start, seconds_between
from tidemark.operators.percentiles import ranked
from tidemark.operators.temporal import clipped_seconds
from tidemark.plans.serving import FREE, PAID, Tables, closures, plan_periods

# The exported data set's cutoff, splits (first paid before) and counted event types.
CUTOFF, MONTHS = "2026-01-01 00:00:00", 6
SPLITS = (("TRAIN", "2025-01-01 00:00:00"), ("VALIDATION", "2025-04-01 00:00:00"), ("TEST", "2025-07-01 00:00:00"))
EVENTS = (("product_access_count", "product_accessed"), ("locked_attempt_count", "locked_feature_attempted"), ("feature_used_count", "feature_used"), ("analytics_view_count", "website_analytics_viewed"))


def first_paid_at(t: Tables) -> DataFrame:
    paid = plan_periods(t).where(F.col("plan_name").isin(*PAID))
    return paid.groupBy("account_id").agg(F.min("valid_from").alias("first_paid_at"))


def created_at(t: Tables) -> DataFrame:
    made = t["account_lifecycle_event"].where("event_type = 'account_created'")
    return made.groupBy("account_id").agg(F.min("event_time").alias("created_at"))


def population(t: Tables, months: int = MONTHS, cutoff: str = CUTOFF) -> DataFrame:
    """Ever-paid accounts whose horizon lies before the cutoff."""
    rows = first_paid_at(t).withColumn("horizon_at", add_months(F.col("first_paid_at"), months))
    return rows.where(F.col("horizon_at") < at(cutoff))


def state_label(t: Tables, months: int = MONTHS, cutoff: str = CUTOFF) -> DataFrame:
    """account_id, first_paid_at, horizon_at, state: paid, not_paid, or unknown where the sources conflict or are silent."""
    p = plan_periods(t).select(F.col("account_id").alias("_account"), "plan_name", "valid_from", "valid_to")
    here = [F.col("account_id") == F.col("_account"), active_at(F.col("horizon_at"), F.col("valid_from"), F.col("valid_to"))]
    keys = ["account_id", "first_paid_at", "horizon_at"]
    flags = population(t, months, cutoff).join(p, here, "left").groupBy(*keys).agg(
        F.coalesce(F.max(F.col("plan_name").isin(*PAID)), F.lit(False)).alias("paid"), F.coalesce(F.max(F.col("plan_name") == FREE), F.lit(False)).alias("free"),
    )
    flags = flags.join(closures(t), "account_id", "left")
    out = F.col("free") | F.coalesce(F.col("closure_time") <= F.col("horizon_at"), F.lit(False))
    state = F.when(F.col("paid") & ~out, "paid").when(~F.col("paid") & out, "not_paid").otherwise("unknown")
    return flags.select(*keys, state.alias("state"))


def product_features(t: Tables, accounts: DataFrame) -> DataFrame:
    """Counts of events from the account's creation up to its first payment; accounts has account_id, first_paid_at."""
    span = accounts.select("account_id", "first_paid_at").join(created_at(t), "account_id", "left")
    events = t["product_behaviour_event"].select("account_id", "event_type", "event_time")
    seen = events.join(span, "account_id").where((F.col("event_time") >= F.col("created_at")) & (F.col("event_time") < F.col("first_paid_at")))
    kind = F.col("event_type")
    counts = [F.count_if(kind == k).alias(name) for name, k in EVENTS]
    found = seen.groupBy("account_id").agg(F.count("*").alias("total_product_events"), *counts, F.count_if(~kind.isin(*[k for _, k in EVENTS])).alias("other_event_count"))
    names = found.columns[1:]
    days = seconds_between(F.col("created_at"), F.col("first_paid_at")) / 86400
    return span.join(found, "account_id", "left").select("account_id", days.alias("days_until_first_paid"), *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


def website_features(t: Tables, accounts: DataFrame) -> DataFrame:
    """Websites created before the first payment, and those of them live at it (strictly)."""
    made = t["website_lifecycle_event"].where("event_type = 'website_created'").groupBy("website_id").agg(F.min("event_time").alias("made_at"))
    sites = t["website"].select("website_id", "account_id").join(made, "website_id").join(accounts.select("account_id", "first_paid_at"), "account_id")
    before = sites.where("made_at < first_paid_at").select("account_id", "website_id", "first_paid_at").distinct()
    live = t["website_live_period"].select(F.col("website_id").alias("_site"), "valid_from", "valid_to")
    here = [F.col("website_id") == F.col("_site"), live_at(F.col("first_paid_at"), F.col("valid_from"), F.col("valid_to"))]
    on = before.join(live, here, "left").groupBy("account_id", "website_id").agg(F.max(F.col("_site").isNotNull()).alias("live"))
    counts = on.groupBy("account_id").agg(F.count("*").alias("w"), F.count_if("live").alias("l"))
    return accounts.select("account_id").join(counts, "account_id", "left").select(
        "account_id", F.coalesce("w", F.lit(0)).alias("websites_created_before_paid"), F.coalesce("l", F.lit(0)).alias("live_websites_at_first_paid"),
    )


def dataset(t: Tables, months: int = MONTHS, cutoff: str = CUTOFF, splits: tuple = SPLITS) -> DataFrame:
    """One row for each account of the population: features, split and target (1 paid, 0 not, null unknown)."""
    people, rows = population(t, months, cutoff), state_label(t, months, cutoff)
    split = F.lit("OUTSIDE_SPLIT")
    for name, before in reversed(splits):
        split = F.when(F.col("first_paid_at") < at(before), name).otherwise(split)
    target = F.when(F.col("state") == "paid", 1).when(F.col("state") == "not_paid", 0)
    labelled = rows.select("account_id", "first_paid_at", "horizon_at", split.alias("split_name"), target.alias("target"))
    joined = labelled.join(product_features(t, people), "account_id").join(website_features(t, people), "account_id")
    return joined.select(*[c for c in joined.columns if c != "target"], F.col("target").alias(f"target_m{months}"))


def split_summary(rows: DataFrame, target: str = "target_m6") -> DataFrame:
    """Counts and base rate for each split and for all rows, by grouping sets."""
    sets = rows.rollup("split_name").agg(F.count("*").alias("accounts"), F.count_if(F.col(target) == 1).alias("paid"), F.count_if(F.col(target) == 0).alias("not_paid"), F.grouping_id().alias("_all"))
    name = F.when(F.col("_all") == 1, "ALL").otherwise(F.col("split_name"))
    return sets.select(name.alias("split_name"), "accounts", "paid", "not_paid", F.round(F.col("paid") * 100.0 / F.nullif(F.col("paid") + F.col("not_paid"), F.lit(0)), 2).alias("paid_pct"))


def quarter_cohorts(t: Tables, months: int = MONTHS, cutoff: str = CUTOFF) -> DataFrame:
    rows = state_label(t, months, cutoff).withColumn("quarter", quarter_start(F.col("first_paid_at")))
    return rows.groupBy("quarter").agg(F.count("*").alias("accounts"), *[F.count_if(F.col("state") == s).alias(s) for s in ("paid", "not_paid", "unknown")])


def population_report(t: Tables, months: tuple[int, ...] = (3, 6), cutoff: str = CUTOFF) -> DataFrame:
    """For each horizon one SUMMARY row and a COHORT_QUARTER row for each quarter of first payment, by one rollup a horizon."""
    ever = first_paid_at(t).agg(F.count("*").alias("ever"))
    out = None
    for m in months:
        rows = state_label(t, m, cutoff).withColumn("first_paid_quarter", quarter_start(F.col("first_paid_at")))
        counts = [F.count_if(F.col("state") == s).alias(f"{s}_accounts") for s in ("paid", "not_paid", "unknown")]
        # one row for each account by construction; the difference shows a broken join
        found = rows.rollup("first_paid_quarter").agg(
            F.count("*").alias("eligible_accounts"), *counts, (F.count("*") - F.count_distinct("account_id")).alias("duplicate_account_rows"), F.grouping_id().alias("_all"),
        ).crossJoin(F.broadcast(ever))
        section = F.when(F.col("_all") == 1, "SUMMARY").otherwise("COHORT_QUARTER")
        some = found.select(section.alias("result_section"), F.lit(f"M{m}").alias("horizon"), "first_paid_quarter", F.when(F.col("_all") == 1, F.col("ever")).alias("ever_paid_accounts"), *found.columns[1:6])
        out = some if out is None else out.unionAll(some)
    return out


def paid_seconds(t: Tables, months: int, cutoff: str) -> DataFrame:
    """(account_id, s, of): seconds of paid plan in the first ``months`` after the first payment, and the seconds of that time."""
    rows = population(t, months, cutoff)
    paid = plan_periods(t).where(F.col("plan_name").isin(*PAID)).select("account_id", "valid_from", "valid_to")
    spent = clipped_seconds(F.col("valid_from"), F.col("valid_to"), F.col("first_paid_at"), F.col("horizon_at"))
    sums = rows.join(paid, "account_id").groupBy("account_id", "first_paid_at", "horizon_at").agg(F.sum(spent).alias("s"))
    return sums.select("account_id", "s", seconds_between(F.col("first_paid_at"), F.col("horizon_at")).alias("of"))


def paid_time(t: Tables, months: int = 12, cutoff: str = CUTOFF) -> DataFrame:
    """Days of paid plan inside the first ``months`` after the first payment, with a band of the share."""
    share = F.col("s") / F.col("of")
    band = F.when(share >= 0.999999, "full").when(share >= 0.75, "75-99").when(share >= 0.5, "50-74").when(share >= 0.25, "25-49").otherwise("under 25")
    return paid_seconds(t, months, cutoff).select("account_id", F.round(F.col("s") / 86400, 4).alias("paid_days"), F.round(share * 100, 2).alias("paid_share_pct"), band.alias("band"))


def paid_time_summary(t: Tables, months: int = 12, cutoff: str = CUTOFF) -> DataFrame:
    """One row: the distribution of paid time, with counts by band of its share of the horizon."""
    days, share = F.col("s") / 86400, F.col("s") / F.col("of")
    bands = {"paid_95_to_100_pct": (0.95, 1.0), "paid_80_to_95_pct": (0.80, 0.95), "paid_50_to_80_pct": (0.50, 0.80)}
    return paid_seconds(t, months, cutoff).agg(
        F.count("*").alias("eligible_accounts"), F.round(F.avg(days), 2).alias("average_paid_days"), F.round(F.min(days), 2).alias("minimum_paid_days"),
        F.round(F.max(days), 2).alias("maximum_paid_days"), F.count_if(F.col("s") == F.col("of")).alias("fully_paid"),
        *[F.count_if((share >= lo) & (share < hi)).alias(name) for name, (lo, hi) in bands.items()], F.count_if(share < 0.5).alias("paid_below_50_pct"),
        F.round(F.avg(F.when(F.col("s") < F.col("of"), days)), 2).alias("average_partial_paid_days"),
        F.count_if((F.col("s") < 0) | (F.col("s") > F.col("of"))).alias("invalid_duration_accounts"),
    )


# The exported data set's columns, in order.
EXPORTED = [
    "account_id", "first_paid_at", "horizon_at", "split_name", "days_until_first_paid", "total_product_events", "product_access_count", "locked_attempt_count",
    "feature_used_count", "analytics_view_count", "other_event_count", "websites_created_before_paid", "live_websites_at_first_paid", "target_m6",
]


def export_dataset(rows: DataFrame, path: str) -> None:
    """Writes the data set as CSV with a header, ordered by first payment and account over all files by name."""
    rows.select(*EXPORTED).orderBy("first_paid_at", "account_id").write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss").csv(path, header=True)


# ---------------------------------------------------------------- model and ranking metrics

FEATURES = ["days_until_first_paid", "total_product_events", "product_access_count", "locked_attempt_count", "feature_used_count", "analytics_view_count", "websites_created_before_paid", "live_websites_at_first_paid"]


def fit(train: DataFrame, features: list[str] = FEATURES, target: str = "target_m6", balanced: bool = False):
    """Standardised logistic regression with an L2 penalty of strength 1 over the rows (regParam 1/n); rows with a null target are ignored."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    rows = train.where(F.col(target).isNotNull()).withColumn("label", F.col(target).cast("double"))
    n, ones = rows.agg(F.count("*"), F.sum("label")).first()
    if not n or not 0 < (ones or 0) < n:
        raise ValueError("both classes are needed")
    weight = F.when(F.col("label") == 1, n / (2 * ones)).otherwise(n / (2 * (n - ones))) if balanced else F.lit(1.0)
    stages = [
        VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True),
        LogisticRegression(featuresCol="_x", labelCol="label", weightCol="_w", regParam=1 / n, standardization=False, maxIter=2000),
    ]
    return Pipeline(stages=stages).fit(rows.withColumn("_w", weight))


def score(model, rows: DataFrame) -> DataFrame:
    """rows with column score, the probability of the class 1."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(rows)
    return out.withColumn("score", vector_to_array("probability")[1]).select(*rows.columns, "score")


def average_precision(scored: DataFrame, label: str = "label", value: str = "score") -> DataFrame:
    """One row (positives, rows, average_precision): precision at each distinct score weighted by the recall gained.

    Equal scores are counted first, so the ordered part has one row for each distinct score; those are ranked in buckets
    whose bounds come from the scores, never in one task.
    """
    known = scored.where(F.col(label).isNotNull() & F.col(value).isNotNull())
    steps = known.groupBy(F.col(value).alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("p")).withColumn("_all", F.lit(0))
    curve = ranked(steps, ["_all"], "s", ["n", "p"], falling=True)
    gain = (F.col("p_before") + F.col("p")) / (F.col("n_before") + F.col("n")) * F.col("p") / F.nullif(F.col("p_of"), F.lit(0))
    return curve.agg(F.max("p_of").alias("positives"), F.max("n_of").alias("rows"), F.round(F.sum(gain), 6).alias("average_precision"))


def precision_at(scored: DataFrame, k: int, key: str, label: str = "label", value: str = "score") -> DataFrame:
    """One row (k, hits, precision_pct, recall_pct) of the k highest scores; ties go to the smallest key."""
    known = scored.where(F.col(label).isNotNull())
    top = known.orderBy(F.desc(value), key).limit(k).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("hits"))
    every = known.agg(F.sum(F.col(label).cast("long")).alias("positives"))
    both = top.crossJoin(every)  # one row each
    return both.select(
        F.lit(k).alias("k"), "hits", F.round(F.col("hits") * 100.0 / F.nullif(F.col("n"), F.lit(0)), 2).alias("precision_pct"),
        F.round(F.col("hits") * 100.0 / F.nullif(F.col("positives"), F.lit(0)), 2).alias("recall_pct"),
    )


def confusion(scored: DataFrame, thresholds: list[float], label: str = "label", value: str = "score") -> DataFrame:
    """Counts and class-0 metrics for each threshold, in one pass."""
    rows = scored.where(F.col(label).isNotNull()).withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in thresholds])))
    guess, truth = F.col(value) >= F.col("threshold"), F.col(label) == 1
    c = rows.groupBy("threshold").agg(
        F.count_if(truth & guess).alias("tp"), F.count_if(~truth & guess).alias("fp"), F.count_if(truth & ~guess).alias("fn"), F.count_if(~truth & ~guess).alias("tn"),
    )
    share = lambda a, b: F.try_divide(a.cast("double"), b)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(
        "*", share(tp + tn, tp + fp + fn + tn).alias("accuracy"), ((share(tp, tp + fn) + share(tn, tn + fp)) / 2).alias("balanced_accuracy"),
        share(tn, tn + fn).alias("precision_0"), share(tn, tn + fp).alias("recall_0"), share(2 * tn, 2 * tn + fn + fp).alias("f1_0"),
    )
