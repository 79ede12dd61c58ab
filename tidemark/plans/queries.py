"""Registered queries over the driver's tables, each with DuckDB SQL for the same rows.

All read whole tables, through the derivations of ``testdata``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import deliveries, quality
from tidemark.operators.intervals import as_of, coverage_depth, merged_periods
from tidemark.operators.percentiles import exact_percentiles
from tidemark.operators.temporal import boundaries, first_row, periods_of
from tidemark.plans import retention_model as model
from tidemark.plans import reports, rule_queries, serving
from tidemark.plans.operational import OperationalTables
from tidemark.plans.testdata import TestTables, duckdb_tables
from tidemark.streaming import windows

END, CUTOFF = "2001-08-01 00:00:00", "2001-08-01 00:00:00"
SPLITS = (("TRAIN", "1997-01-01 00:00:00"), ("VALIDATION", "1998-01-01 00:00:00"), ("TEST", "1999-01-01 00:00:00"))
START, ZONE = "1995-01-01 00:00:00", serving.ZONE

QUERIES: dict[str, Callable[[TestTables], DataFrame]] = {}
SQL: dict[str, str] = {}

HEAD = f"""{duckdb_tables()}
, named AS (SELECT p.*, lower(plan_name) AS plan FROM subscription_plan_period p JOIN plan_catalog USING (plan_id))
, closed AS (SELECT account_id, min(event_time) AS closure_time FROM account_lifecycle_event WHERE event_type = 'account_closure' GROUP BY 1)
, converted AS (
  SELECT a.account_id, min(a.valid_to) AS paid_time FROM named a JOIN named b ON a.account_id = b.account_id AND a.valid_to = b.valid_from
  WHERE a.plan = 'free' AND b.plan IN ('standard', 'premium') GROUP BY 1)
, anchor AS (SELECT account_id, min(valid_from) AS first_paid_at FROM named WHERE plan <> 'free' GROUP BY 1)
, made AS (SELECT account_id, min(event_time) AS created_at FROM account_lifecycle_event WHERE event_type = 'account_created' GROUP BY 1)
"""


def query(name: str, sql: str | None) -> Callable:
    def add(f: Callable[[TestTables], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = HEAD + sql
        return f

    return add


def local_month(t: str) -> str:
    return f"date_trunc('month', timezone('{ZONE}', timezone('UTC', {t})))::DATE"


# ---------------------------------------------------------------- serving views


@query("conversion_horizon", f"""
, active AS (SELECT account_id, min(event_time) AS t FROM website JOIN website_lifecycle_event USING (website_id) WHERE event_type = 'published' GROUP BY 1)
, opening AS (SELECT account_id, plan FROM named QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY valid_from, subscription_plan_period_id) = 1)
, cohort AS (
  SELECT account_id, t, paid_time FROM active JOIN opening USING (account_id) LEFT JOIN converted USING (account_id) LEFT JOIN closed USING (account_id)
  WHERE plan = 'free' AND coalesce(closure_time >= t, true) AND coalesce(paid_time >= t, true)
    AND (TIMESTAMP '{END}' >= t + INTERVAL 180 DAY OR coalesce(closure_time < t + INTERVAL 180 DAY, false)))
SELECT d AS horizon_days, 'D' || d AS horizon_label, o AS horizon_order, count(*) FILTER (paid_time <= t + to_days(d)) AS converted_count, count(*) AS cohort_size,
  round(100.0::DOUBLE * count(*) FILTER (paid_time <= t + to_days(d)) / count(*), 2) AS conversion_rate_pct
FROM cohort, (VALUES (30, 1), (60, 2), (90, 3), (180, 4)) AS h(d, o) GROUP BY d, o""")  # fmt: skip
def _(t: TestTables) -> DataFrame:
    return serving.conversion_horizon(t, END)


@query("commercial_transition", """
, kind(event_type, label, o) AS (VALUES ('subscription_upgraded', 'Upgrade', 1), ('subscription_downgraded', 'Downgrade', 2), ('subscription_cancelled', 'Cancel', 3), ('subscription_reactivated', 'Reactivate', 4))
, moves AS (
  SELECT e.*, label, o, f.plan_name AS f_name, g.plan_name AS g_name FROM subscription_lifecycle_event e JOIN kind USING (event_type)
  LEFT JOIN plan_catalog f ON f.plan_id = from_plan_id LEFT JOIN plan_catalog g ON g.plan_id = to_plan_id)
, per_type AS (SELECT event_type, count(*) AS tn, count(DISTINCT account_id) AS ta FROM moves GROUP BY 1)
, total AS (SELECT count(*) AS an, count(DISTINCT account_id) AS aa FROM moves)
SELECT event_type, label AS event_type_label, o AS event_type_order, from_plan_id, f_name AS from_plan_name, to_plan_id, g_name AS to_plan_name,
  f_name || ' → ' || g_name AS path_label, count(*) AS transition_events, count(DISTINCT account_id) AS distinct_accounts,
  round(count(*)::DOUBLE / any_value(tn) * 100, 2) AS share_within_transition_type_pct, round(count(*)::DOUBLE / any_value(an) * 100, 2) AS share_of_all_transitions_pct,
  any_value(tn) AS type_event_count, any_value(ta) AS type_account_count, any_value(an) AS all_transition_events, any_value(aa) AS all_transition_accounts,
  (row_number() OVER (ORDER BY o, count(*) DESC, f_name, g_name))::INT AS path_sort_order
FROM moves JOIN per_type USING (event_type), total GROUP BY event_type, label, o, from_plan_id, f_name, to_plan_id, g_name""")
def _(t: TestTables) -> DataFrame:
    return serving.commercial_transition(t)


@query("feature_dimension", "SELECT feature_id, feature_name, (row_number() OVER (ORDER BY feature_name, feature_id))::INT AS feature_sort FROM feature")
def _(t: TestTables) -> DataFrame:
    return serving.feature(t)


@query("feature_adoption", """
, eligible AS (
  SELECT DISTINCT account_id, e.feature_id FROM subscription_plan_period p JOIN plan_feature_entitlement_period e ON e.plan_id = p.plan_id
    AND p.valid_from < coalesce(e.valid_to, TIMESTAMP '9999-01-01') AND e.valid_from < coalesce(p.valid_to, TIMESTAMP '9999-01-01'))
, counts AS (
  SELECT feature_id, count(*) AS e, count(*) FILTER ((account_id, feature_id) IN (SELECT (account_id, feature_id) FROM product_behaviour_event WHERE event_type = 'feature_used')) AS a
  FROM eligible GROUP BY 1)
, rates AS (
  SELECT feature_id, feature_name, coalesce(e, 0) AS eligible_pairs, coalesce(a, 0) AS adopted_pairs, round(a::DOUBLE / e * 100, 2) AS adoption_rate_pct FROM feature LEFT JOIN counts USING (feature_id))
SELECT *, (row_number() OVER (ORDER BY adoption_rate_pct DESC NULLS LAST, adopted_pairs DESC, feature_name, feature_id))::INT AS adoption_rank FROM rates""")
def _(t: TestTables) -> DataFrame:
    return serving.feature_adoption(t)


@query("locked_feature_signal", """
, attempts AS (
  SELECT b.*, plan FROM product_behaviour_event b JOIN named p ON p.account_id = b.account_id AND event_time >= valid_from AND (valid_to IS NULL OR event_time < valid_to)
  WHERE event_type = 'locked_feature_attempted' AND NOT EXISTS (
    FROM plan_feature_entitlement_period e WHERE e.plan_id = p.plan_id AND e.feature_id = b.feature_id AND b.event_time >= e.valid_from AND (e.valid_to IS NULL OR b.event_time < e.valid_to)))
, sums AS (
  SELECT feature_id, count(*) AS n, count(DISTINCT account_id) AS a, count(DISTINCT user_id) AS u, count(DISTINCT website_id) AS w, count(*) - count(website_id) AS nw,
    count(*) FILTER (plan = 'free') AS fe, count(*) FILTER (plan = 'standard') AS se, count(*) FILTER (plan = 'premium') AS pe,
    count(DISTINCT account_id) FILTER (plan = 'free') AS fa, count(DISTINCT account_id) FILTER (plan = 'standard') AS sa, count(DISTINCT account_id) FILTER (plan = 'premium') AS pa
  FROM attempts GROUP BY 1)
SELECT feature_id, feature_name, n AS attempt_events, a AS distinct_attempting_accounts, u AS distinct_attempting_users, w AS distinct_websites, nw AS attempts_without_website,
  round(n::DOUBLE / a, 2) AS attempts_per_attempting_account, fe AS free_attempt_events, se AS standard_attempt_events, pe AS premium_attempt_events,
  fa AS free_attempting_accounts, sa AS standard_attempting_accounts, pa AS premium_attempting_accounts, round(fe::DOUBLE / n * 100, 2) AS free_event_share_pct,
  round(se::DOUBLE / n * 100, 2) AS standard_event_share_pct, round(pe::DOUBLE / n * 100, 2) AS premium_event_share_pct,
  (row_number() OVER (ORDER BY a DESC, n DESC, feature_name, feature_id))::INT AS signal_rank
FROM sums JOIN feature USING (feature_id)""")
def _(t: TestTables) -> DataFrame:
    return serving.locked_feature_signal(t)


@query("paid_retention_horizon", f"""
, cohort AS (
  SELECT account_id, paid_time, closure_time, date_trunc('month', paid_time + INTERVAL 12 MONTH) + INTERVAL 1 MONTH AS seen FROM converted LEFT JOIN closed USING (account_id)
  WHERE TIMESTAMP '{END}' >= seen OR coalesce(closure_time < seen, false))
, snaps AS (
  SELECT *, (date_trunc('month', paid_time + to_months(m)) + INTERVAL 1 MONTH)::TIMESTAMP - INTERVAL 1 SECOND AS s FROM cohort, (VALUES (1, 1), (3, 2), (6, 3), (12, 4)) AS h(m, o))
, states AS (
  SELECT m, o, NOT coalesce(closure_time <= s, false) AND EXISTS (FROM named n WHERE n.account_id = snaps.account_id AND plan <> 'free' AND s >= valid_from AND (valid_to IS NULL OR s < valid_to)) AS paid FROM snaps)
SELECT m AS horizon_months, 'M' || m AS horizon_label, o AS horizon_order, count(*) FILTER (paid) AS retained_count, count(*) AS cohort_size,
  round(count(*) FILTER (paid)::DOUBLE / count(*) * 100, 2) AS retention_rate_pct FROM states GROUP BY m, o""")
def _(t: TestTables) -> DataFrame:
    return serving.paid_retention_horizon(t, END)


@query("rating_snapshot", """
, state AS (
  SELECT rating_id, arg_max(event_type, (event_time, event_id)) AS last,
    arg_max(rating_value, (event_time, event_id)) FILTER (event_type IN ('rating_given', 'rating_changed') AND rating_value IS NOT NULL) AS v
  FROM rating_lifecycle_event GROUP BY 1)
, live AS (SELECT v FROM state WHERE last <> 'rating_removed' AND v IS NOT NULL)
SELECT i::INT AS rating_value, i::INT AS rating_sort, (SELECT count(*) FROM live WHERE v = i) AS active_rating_count, (SELECT count(*) FROM live) AS total_active_ratings,
  (SELECT round(avg(v), 2) FROM live) AS current_avg_rating, (SELECT count(*) FROM live WHERE v IN (4, 5)) AS high_rating_4_5_count,
  (SELECT round(count(*) FILTER (v IN (4, 5))::DOUBLE / count(*) * 100, 2) FROM live) AS high_rating_4_5_share_pct
FROM range(1, 6) AS r(i)""")
def _(t: TestTables) -> DataFrame:
    return serving.rating_snapshot(t)


SUPPORT = """
, requests AS (
  SELECT r.support_request_id, account_id, website_id, min(event_time) FILTER (event_type = 'support_request_opened') AS opened, max(event_time) FILTER (event_type = 'support_request_resolved') AS resolved
  FROM support_request r JOIN support_lifecycle_event e ON e.support_request_id = r.support_request_id GROUP BY ALL)
, timed AS (SELECT *, CASE WHEN resolved >= opened THEN epoch_us(resolved - opened) / 3600e6 END AS hours FROM requests)
"""


@query("support_monthly", SUPPORT + f"""
SELECT {local_month('opened')} AS month_start, strftime({local_month('opened')}, '%b %Y') AS month_label, (year({local_month('opened')}) * 100 + month({local_month('opened')}))::INT AS month_sort,
  {local_month('opened')} = DATE '2001-08-01' AS is_partial_period, count(*) AS requests_opened, count(DISTINCT account_id) AS accounts_with_support, count(website_id) AS website_linked_requests,
  count(*) - count(website_id) AS account_level_requests, count(resolved) AS resolved_requests, count(*) - count(resolved) AS unresolved_requests,
  round(count(resolved)::DOUBLE / count(*) * 100, 2) AS resolution_rate_pct, round(quantile_cont(hours, 0.5), 2) AS median_resolution_hours, round(avg(hours), 2) AS avg_resolution_hours
FROM timed WHERE opened IS NOT NULL GROUP BY 1, 2, 3, 4""")
def _(t: TestTables) -> DataFrame:
    return serving.support_monthly(t, partial_month="2001-08-01")


@query("support_summary", SUPPORT + """
SELECT 1 AS summary_id, count(*) AS total_support_requests, count(resolved) AS resolved_requests, count(*) - count(resolved) AS unresolved_requests,
  round(count(resolved)::DOUBLE / count(*) * 100, 2) AS resolution_rate_pct, round(quantile_cont(hours, 0.5), 2) AS median_resolution_hours,
  round(avg(hours), 2) AS avg_resolution_hours, round(quantile_cont(hours, 0.95), 2) AS p95_resolution_hours FROM timed""")
def _(t: TestTables) -> DataFrame:
    return serving.support_summary(t)


@query("website_monthly", f"""
, clipped AS (
  SELECT website_id, greatest(valid_from, TIMESTAMP '{START}') AS a, least(coalesce(valid_to, TIMESTAMP '{END}'), TIMESTAMP '{END}') AS b FROM website_live_period)
, months AS (
  SELECT DISTINCT website_id, unnest(generate_series({local_month('a')}::TIMESTAMP, {local_month("b - INTERVAL 1 MICROSECOND")}::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS m FROM clipped WHERE b > a)
, sites AS (SELECT m, count(*) AS sites FROM months GROUP BY 1)
, ends AS (
  SELECT session_id, count(*) FILTER (event_type = 'session_started') AS ns, count(*) FILTER (event_type = 'session_ended') AS ne,
    min(event_time) FILTER (event_type = 'session_started') AS s, max(event_time) FILTER (event_type = 'session_ended') AS e FROM session_lifecycle_event GROUP BY 1)
, spent AS (
  SELECT {local_month('s')} AS m, CASE WHEN ne = 1 AND e >= s THEN epoch_us(e - s) / 60e6 END AS d FROM audience_session JOIN ends USING (session_id) WHERE ns = 1)
, sess AS (
  SELECT m, count(*) AS sessions, count(d) AS valid, round(quantile_cont(d, 0.5), 2) AS p50, round(avg(d), 2) AS mean, round(quantile_cont(d, 0.25), 2) AS p25,
    round(quantile_cont(d, 0.75), 2) AS p75, round(quantile_cont(d, 0.95), 2) AS p95 FROM spent GROUP BY 1)
, acts AS (
  SELECT {local_month('event_time')} AS m, count(*) FILTER (event_type = 'page_viewed') AS views, count(*) FILTER (event_type = 'form_submitted') AS forms, count(*) FILTER (event_type = 'failure_friction') AS friction
  FROM audience_interaction_event GROUP BY 1)
, posts AS (
  SELECT {local_month('event_time')} AS m, count(*) AS posted, count(DISTINCT website_id) AS with_posts FROM comment_lifecycle_event JOIN comment USING (comment_id) JOIN page USING (page_id)
  WHERE event_type = 'comment_posted' GROUP BY 1)
, every AS (SELECT m FROM sites UNION SELECT m FROM sess UNION SELECT m FROM acts UNION SELECT m FROM posts)
SELECT m AS month_start, strftime(m, '%b %Y') AS month_label, (year(m) * 100 + month(m))::INT AS month_sort, m = DATE '2001-08-01' AS is_partial_period,
  coalesce(sites, 0) AS website_month_rows, coalesce(sites, 0) AS websites_observed, coalesce(sessions, 0) AS sessions, coalesce(views, 0) AS page_views,
  round(coalesce(views, 0)::DOUBLE / nullif(sessions, 0), 2) AS pages_per_session, coalesce(forms, 0) AS forms_submitted, round(coalesce(forms, 0)::DOUBLE / nullif(sessions, 0) * 100, 2) AS forms_per_100_sessions,
  coalesce(friction, 0) AS friction_events, round(coalesce(friction, 0)::DOUBLE / nullif(sessions, 0) * 100, 2) AS friction_per_100_sessions, coalesce(valid, 0) AS valid_duration_sessions,
  p50 AS median_session_minutes, mean AS avg_session_minutes, p25 AS p25_session_minutes, p75 AS p75_session_minutes, p95 AS p95_session_minutes,
  coalesce(posted, 0) AS comments_posted, coalesce(with_posts, 0) AS websites_with_comments, round(coalesce(posted, 0)::DOUBLE / nullif(sessions, 0) * 100, 2) AS comments_per_100_sessions
FROM every LEFT JOIN sites USING (m) LEFT JOIN sess USING (m) LEFT JOIN acts USING (m) LEFT JOIN posts USING (m) WHERE m >= DATE '1995-01-01'""")
def _(t: TestTables) -> DataFrame:
    return serving.website_monthly(t, START, END, ZONE, "1995-01-01", "2001-08-01")


@query("lifecycle_kpis", "SELECT " + ", ".join(f"{v}{'::BIGINT' if isinstance(v, int) and k != 'summary_id' else '::DOUBLE' if isinstance(v, float) else ''} AS {k}" for k, v in serving.LIFECYCLE_KPIS.items()))
def _(t: TestTables) -> DataFrame:
    one = serving.lifecycle_kpis(t.spark)
    return one.select(*[F.col(c).cast("long") if k == "int" and c != "summary_id" else F.col(c) for c, k in one.dtypes])


RATES = """
SELECT m AS horizon_months, 'M' || m AS horizon_label, o AS horizon_order, n AS cohort_size, a AS product_active_count, round(a::DOUBLE / n * 100, 2) AS product_retention_rate_pct,
  p AS paid_count, round(p::DOUBLE / n * 100, 2) AS paid_retention_rate_pct, b AS both_count, x AS product_only_count, y AS paid_only_count, z AS neither_count, x + y AS gross_mismatch_count,
  round((x + y)::DOUBLE / n * 100, 2) AS gross_mismatch_rate_pct, round((p - a)::DOUBLE / n * 100, 2) AS net_gap_pp FROM c"""


@query("product_paid_aligned", ", c(m, o, n, a, p, b, x, y, z) AS (VALUES " + ", ".join(str((r[0], i + 1, *r[2:])) for i, r in enumerate(serving.ALIGNED)) + ")" + RATES)
def _(t: TestTables) -> DataFrame:
    return serving.product_paid_aligned(t.spark)


@query("product_paid_computed", f"""
, snaps AS (
  SELECT account_id, m, o, (date_trunc('month', paid_time + to_months(m)) + INTERVAL 1 MONTH)::TIMESTAMP - INTERVAL 1 SECOND AS s FROM converted, (VALUES (1, 1), (3, 2), (6, 3), (12, 4)) AS h(m, o))
, flags AS (
  SELECT m, o, EXISTS (FROM product_behaviour_event e WHERE e.account_id = snaps.account_id AND date_trunc('month', event_time) = date_trunc('month', s)) AS act,
    EXISTS (FROM named n WHERE n.account_id = snaps.account_id AND plan <> 'free' AND s >= valid_from AND (valid_to IS NULL OR s < valid_to)) AS paid FROM snaps)
, c AS (
  SELECT m, o, count(*) AS n, count(*) FILTER (act) AS a, count(*) FILTER (paid) AS p, count(*) FILTER (act AND paid) AS b, count(*) FILTER (act AND NOT paid) AS x,
    count(*) FILTER (paid AND NOT act) AS y, count(*) FILTER (NOT paid AND NOT act) AS z FROM flags GROUP BY m, o){RATES}""")
def _(t: TestTables) -> DataFrame:
    return serving.product_paid_computed(t)


# ---------------------------------------------------------------- temporal operators, aggregates, sets


@query("first_plan_per_account", "SELECT account_id, plan_id, valid_from FROM subscription_plan_period QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY valid_from, subscription_plan_period_id) = 1")
def _(t: TestTables) -> DataFrame:
    return first_row(t["subscription_plan_period"], "account_id", ["valid_from", "subscription_plan_period_id"], ["plan_id", "valid_from"])


@query("plan_boundaries", """SELECT a.account_id, a.valid_to AS boundary_time, a.plan_id AS from_state, b.plan_id AS to_state
FROM subscription_plan_period a JOIN subscription_plan_period b ON a.account_id = b.account_id AND a.valid_to = b.valid_from""")
def _(t: TestTables) -> DataFrame:
    return boundaries(t["subscription_plan_period"], "account_id", "plan_id")


@query("null_safe_filter", "SELECT o_orderkey, c_custkey, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 WHERE c_mktsegment IS DISTINCT FROM 'BUILDING'")
def _(t: TestTables) -> DataFrame:
    rich = t["customer"].where("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    joined = t["orders"].select("o_orderkey", "o_custkey").join(rich, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.where(~F.col("c_mktsegment").eqNullSafe(F.lit("BUILDING"))).select("o_orderkey", "c_custkey", "c_mktsegment")


@query("percentiles_by_group", """SELECT event_type, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.95) AS p95
FROM (SELECT event_type, round(value, 3) AS value FROM events) GROUP BY 1""".replace("quantile_cont(value, ", "round(quantile_cont(value, ").replace(") AS p", "), 4) AS p"))
def _(t: TestTables) -> DataFrame:
    rows = t["events"].select("event_type", F.round("value", 3).alias("value"))
    levels = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    return exact_percentiles(rows, ["event_type"], "value", levels).select("event_type", *[F.round(c, 4).alias(c) for c in levels])


@query("micro_period_dwell", """SELECT event_type, count(*) AS periods, count(valid_to) AS closed_periods, sum(epoch_us(valid_to - valid_from))::BIGINT AS micros
FROM (SELECT event_type, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events) GROUP BY 1""")
def _(t: TestTables) -> DataFrame:
    p = periods_of(t["events"].select("user_id", "event_type", "event_id", "ts"), "user_id", "ts", ["event_id"])
    return p.groupBy("event_type").agg(F.count("*").alias("periods"), F.count("valid_to").alias("closed_periods"), F.sum(F.timestamp_diff("MICROSECOND", F.col("valid_from"), F.col("valid_to"))).alias("micros"))


@query("grouping_sets_total", "SELECT coalesce(event_type, 'ALL') AS event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY GROUPING SETS ((event_type), ())")
def _(t: TestTables) -> DataFrame:
    sets = t["events"].rollup("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.grouping_id().alias("g"))
    return sets.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("event_type")).alias("event_type"), "n", "users")


@query("two_level_histogram", "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def _(t: TestTables) -> DataFrame:
    return t["orders"].groupBy("o_custkey").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("customers"))


@query("unpivot_report", """SELECT l_returnflag, metric, round(v, 2) AS v FROM (
  SELECT l_returnflag, sum(l_quantity) AS quantity, avg(l_discount) AS discount, avg(l_tax) AS tax FROM lineitem GROUP BY 1) UNPIVOT (v FOR metric IN (quantity, discount, tax))""")
def _(t: TestTables) -> DataFrame:
    sums = t["lineitem"].groupBy("l_returnflag").agg(F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"))
    return sums.unpivot("l_returnflag", ["quantity", "discount", "tax"], "metric", "v").withColumn("v", F.round("v", 2))


@query("topk_tiebreak", "SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey LIMIT 10")
def _(t: TestTables) -> DataFrame:
    return t["orders"].select("o_orderkey", "o_orderpriority", "o_orderdate").orderBy("o_orderpriority", F.desc("o_orderdate"), "o_orderkey").limit(10)


@query("json_props", "SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k_sum FROM events GROUP BY 1")
def _(t: TestTables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return t["events"].groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k_sum"))


# ---------------------------------------------------------------- deliveries

REPEATED = """
, raw AS (SELECT event_id, user_id, event_type, value FROM events UNION ALL SELECT event_id, user_id, event_type, value FROM events WHERE event_type = 'error'
  UNION ALL SELECT event_id, user_id, event_type, value + 1 FROM events WHERE event_type = 'signup')
"""


def repeated(t: TestTables) -> DataFrame:
    rows = t["events"].select("event_id", "user_id", "event_type", "value")
    return rows.union(rows.where("event_type = 'error'")).union(rows.where("event_type = 'signup'").withColumn("value", F.col("value") + 1))


@query("dedup_counters", REPEATED + "SELECT (SELECT count(*) FROM raw) AS raw_rows, count(*) AS emitted_rows, (SELECT count(*) FROM raw) - count(*) AS duplicates_skipped, count(*) FILTER (d > 1) AS conflicting_keys FROM (SELECT event_id, count(DISTINCT (user_id, event_type, value)) AS d FROM raw GROUP BY 1)")
def _(t: TestTables) -> DataFrame:
    return deliveries.counters(repeated(t), "event_id")


@query("dedup_conflicts", REPEATED + "SELECT event_id, count(*) AS deliveries FROM raw GROUP BY 1 HAVING count(DISTINCT (user_id, event_type, value)) > 1")
def _(t: TestTables) -> DataFrame:
    return deliveries.conflicts(repeated(t), "event_id")


@query("dedup_exact", "SELECT event_id, user_id, event_type, value FROM events")
def _(t: TestTables) -> DataFrame:
    rows = t["events"].select("event_id", "user_id", "event_type", "value")
    return deliveries.once(rows.union(rows.where("event_type = 'error'")), "event_id")


# ---------------------------------------------------------------- sweeps and as-of lookups


@query("as_of_plan", """SELECT event_id, e.account_id, event_time, CASE WHEN p.valid_to IS NULL OR event_time < p.valid_to THEN plan_id END AS plan_id
FROM product_behaviour_event e ASOF LEFT JOIN subscription_plan_period p ON e.account_id = p.account_id AND e.event_time >= p.valid_from""")
def _(t: TestTables) -> DataFrame:
    events = t["product_behaviour_event"].select("event_id", "account_id", "event_time")
    return as_of(events, t["subscription_plan_period"], ["account_id"], ["plan_id"], until="valid_to")


@query("as_of_plan_change", """, latest AS (SELECT plan_id, valid_from, max(account_id) AS last_joined FROM subscription_plan_period GROUP BY ALL)
SELECT event_id, plan, event_time, last_joined FROM (SELECT *, CASE WHEN event_type = 'feature_used' THEN 'P1' ELSE 'P3' END AS plan FROM product_behaviour_event) e
ASOF LEFT JOIN latest ON plan = plan_id AND event_time >= valid_from""")
def _(t: TestTables) -> DataFrame:
    plan = F.when(F.col("event_type") == "feature_used", "P1").otherwise("P3").alias("plan")
    joined = t["subscription_plan_period"].select(F.col("plan_id").alias("plan"), F.col("account_id").alias("last_joined"), "valid_from")
    return as_of(t["product_behaviour_event"].select("event_id", plan, "event_time"), joined, ["plan"], ["last_joined"], order=["last_joined"])


@query("coverage_depth", """, points AS (SELECT plan_id, valid_from AS "at", 1 AS step FROM subscription_plan_period UNION ALL SELECT plan_id, valid_to, -1 FROM subscription_plan_period WHERE valid_to IS NOT NULL)
, depths AS (SELECT plan_id, "at", sum(sum(step)) OVER (PARTITION BY plan_id ORDER BY "at") AS depth FROM points GROUP BY 1, 2)
, changes AS (SELECT *, lag(depth) OVER (PARTITION BY plan_id ORDER BY "at") AS before FROM depths)
SELECT * FROM (SELECT plan_id, "at" AS valid_from, lead("at") OVER (PARTITION BY plan_id ORDER BY "at") AS valid_to, depth::BIGINT AS depth FROM changes WHERE depth IS DISTINCT FROM coalesce(before, 0)) WHERE depth > 0""")
def _(t: TestTables) -> DataFrame:
    return coverage_depth(t["subscription_plan_period"], ["plan_id"])


@query("merged_periods", """
, ends AS (SELECT *, max(coalesce(valid_to, TIMESTAMP '9999-12-31')) OVER (PARTITION BY website_id ORDER BY valid_from, valid_to NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM website_live_period)
, islands AS (SELECT *, sum(CASE WHEN valid_from <= m THEN 0 ELSE 1 END) OVER (PARTITION BY website_id ORDER BY valid_from, valid_to NULLS FIRST ROWS UNBOUNDED PRECEDING) AS island FROM ends)
SELECT website_id, min(valid_from) AS valid_from, CASE WHEN bool_or(valid_to IS NULL) THEN NULL ELSE max(valid_to) END AS valid_to FROM islands GROUP BY website_id, island""")
def _(t: TestTables) -> DataFrame:
    return merged_periods(t["website_live_period"], ["website_id"])


# ---------------------------------------------------------------- data quality templates

GAPPED = ", gapped AS (SELECT * FROM subscription_plan_period WHERE plan_id <> 'P2')"


def gapped(t: TestTables) -> DataFrame:
    return t["subscription_plan_period"].where("plan_id != 'P2'")


@query("dq_contiguity", GAPPED + "SELECT account_id, previous_end, valid_from FROM (SELECT *, lag(valid_to) OVER w AS previous_end, row_number() OVER w AS n FROM gapped WINDOW w AS (PARTITION BY account_id ORDER BY valid_from)) WHERE n > 1 AND previous_end IS DISTINCT FROM valid_from")
def _(t: TestTables) -> DataFrame:
    return quality.contiguity(gapped(t), "account_id", ["valid_from"])


@query("dq_overlap", """SELECT website_id, valid_from, valid_to FROM (SELECT *, max(coalesce(valid_to, TIMESTAMP '9999-12-31')) OVER (PARTITION BY website_id ORDER BY valid_from, valid_to NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM website_live_period) WHERE valid_from < m""")
def _(t: TestTables) -> DataFrame:
    return quality.overlap(t["website_live_period"], "website_id", ["valid_from", "valid_to"])


@query("dq_coverage", GAPPED + """
, spans AS (SELECT account_id, min(valid_from) AS a, max(valid_from) AS b FROM subscription_plan_period GROUP BY 1)
, points AS (SELECT account_id, a AS "at" FROM spans UNION SELECT account_id, valid_from FROM gapped UNION SELECT account_id, valid_to FROM gapped WHERE valid_to IS NOT NULL)
SELECT account_id, "at" FROM points JOIN spans USING (account_id) WHERE "at" >= a AND "at" < b AND NOT EXISTS (FROM gapped g WHERE g.account_id = points.account_id AND "at" >= valid_from AND (valid_to IS NULL OR "at" < valid_to))""")
def _(t: TestTables) -> DataFrame:
    outer = t["subscription_plan_period"].groupBy("account_id").agg(F.min("valid_from").alias("valid_from"), F.max("valid_from").alias("valid_to"))
    return quality.coverage(outer, gapped(t), "account_id")


@query("dq_containment", """SELECT website_id, valid_from, valid_to FROM website_live_period c WHERE NOT EXISTS (
  FROM (SELECT o_orderkey AS k, o_orderdate AS a, o_orderdate + INTERVAL 90 DAY AS b FROM orders) WHERE k = website_id AND c.valid_from >= a AND c.valid_to IS NOT NULL AND c.valid_to <= b)""")
def _(t: TestTables) -> DataFrame:
    parent = t["orders"].select(F.col("o_orderkey").alias("website_id"), F.col("o_orderdate").alias("valid_from"), (F.col("o_orderdate") + F.expr("INTERVAL 90 DAY")).alias("valid_to"))
    return quality.containment(t["website_live_period"], parent, ["website_id"])


@query("dq_cardinality", "SELECT website_id, count(e.event_id) AS n FROM website LEFT JOIN website_lifecycle_event e USING (website_id) GROUP BY 1 HAVING count(e.event_id) <> 2")
def _(t: TestTables) -> DataFrame:
    return quality.cardinality(t["website"], t["website_lifecycle_event"], "website_id", 2, 2)


@query("dq_boundary_reconcile", """
, e AS (SELECT account_id, event_time AS "at", count(*) AS n FROM subscription_lifecycle_event WHERE event_type <> 'subscription_renewed' GROUP BY 1, 2)
, p AS (SELECT DISTINCT account_id, valid_from AS "at" FROM gapped)
SELECT CASE WHEN p."at" IS NULL THEN 'event_without_boundary' ELSE 'boundary_event_mismatch' END AS violation, coalesce(p.account_id, e.account_id) AS account_id, coalesce(p."at", e."at") AS "at"
FROM p FULL JOIN e ON p.account_id = e.account_id AND p."at" = e."at" WHERE p."at" IS NULL OR coalesce(n, 0) <> 1""".replace("\n, e AS", GAPPED + "\n, e AS", 1))
def _(t: TestTables) -> DataFrame:
    events = t["subscription_lifecycle_event"].where("event_type != 'subscription_renewed'")
    return quality.boundary_reconcile(gapped(t), events, ["account_id"])


@query("dq_orphan", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(t: TestTables) -> DataFrame:
    return quality.orphan(t["orders"].select("o_orderkey", "o_custkey"), t["customer"].where("c_acctbal > 0"), "o_custkey", "c_custkey")


@query("dq_ordered_pair", "SELECT l_orderkey, l_linenumber, l_shipdate, o_orderdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate")
def _(t: TestTables) -> DataFrame:
    joined = t["lineitem"].select("l_orderkey", "l_linenumber", "l_shipdate").join(t["orders"].select("o_orderkey", "o_orderdate"), F.col("o_orderkey") == F.col("l_orderkey")).drop("o_orderkey")
    return quality.ordered_pair(joined, "o_orderdate", "l_shipdate")


@query("dq_null_safe_mismatch", "SELECT event_id, account_id, from_plan_id, to_plan_id FROM subscription_lifecycle_event WHERE from_plan_id IS DISTINCT FROM to_plan_id")
def _(t: TestTables) -> DataFrame:
    return quality.null_safe_mismatch(t["subscription_lifecycle_event"].select("event_id", "account_id", "from_plan_id", "to_plan_id"), "from_plan_id", "to_plan_id")


@query("dq_interval_count", GAPPED + """
, e AS (SELECT account_id, event_id, event_time FROM subscription_lifecycle_event)
SELECT event_id, count(g.valid_from) AS n FROM e LEFT JOIN gapped g ON g.account_id = e.account_id AND event_time >= valid_from AND (valid_to IS NULL OR event_time < valid_to) GROUP BY 1 HAVING count(g.valid_from) <> 1""")
def _(t: TestTables) -> DataFrame:
    return quality.interval_count(t["subscription_lifecycle_event"], gapped(t), ["account_id"], "event_id")


@query("dq_after_closure", "SELECT account_id, event_id, event_time, c AS closure_time FROM product_behaviour_event JOIN (SELECT o_custkey, max(o_orderdate) AS c FROM orders GROUP BY 1) ON o_custkey = account_id WHERE event_time > c")
def _(t: TestTables) -> DataFrame:
    last = t["orders"].groupBy(F.col("o_custkey").alias("account_id")).agg(F.max("o_orderdate").alias("closure_time"))
    return quality.after_closure(t["product_behaviour_event"].select("account_id", "event_id", "event_time"), last, "account_id")


@query("dq_duplicate_key", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(t: TestTables) -> DataFrame:
    return quality.duplicate_key(t["lineitem"], ["l_orderkey", "l_linenumber"])


@query("dq_domain", "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('signup', 'purchase', 'view')")
def _(t: TestTables) -> DataFrame:
    return quality.outside_domain(t["events"].select("event_id", "event_type"), "event_type", ["signup", "purchase", "view"])


@query("dq_summary", """
SELECT rule, n AS violations, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (
  SELECT 'order_customer' AS rule, (SELECT count(*) FROM orders ANTI JOIN customer ON c_custkey = o_custkey) AS n
  UNION ALL SELECT 'shipped_before_order', (SELECT count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate)
  UNION ALL SELECT 'line_key', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
  UNION ALL SELECT 'event_type', (SELECT count(*) FROM events WHERE event_type NOT IN ('signup', 'purchase', 'error', 'view', 'click')))""")
def _(t: TestTables) -> DataFrame:
    return quality.summary({
        "order_customer": quality.orphan(t["orders"], t["customer"], "o_custkey", "c_custkey"), "shipped_before_order": QUERIES["dq_ordered_pair"](t),
        "line_key": quality.duplicate_key(t["lineitem"], ["l_orderkey", "l_linenumber"]),
        "event_type": quality.outside_domain(t["events"], "event_type", ["signup", "purchase", "error", "view", "click"]),
    })


# ---------------------------------------------------------------- retention model

STATES = f"""
, pop AS (SELECT *, first_paid_at + INTERVAL 6 MONTH AS horizon_at FROM anchor WHERE first_paid_at + INTERVAL 6 MONTH < TIMESTAMP '{CUTOFF}')
, flags AS (
  SELECT pop.account_id, first_paid_at, horizon_at, coalesce(bool_or(plan <> 'free'), false) AS paid, coalesce(bool_or(plan = 'free'), false) OR coalesce(bool_or(closure_time <= horizon_at), false) AS gone
  FROM pop LEFT JOIN named n ON n.account_id = pop.account_id AND horizon_at >= valid_from AND (valid_to IS NULL OR horizon_at < valid_to) LEFT JOIN closed c ON c.account_id = pop.account_id
  GROUP BY pop.account_id, first_paid_at, horizon_at)
, labels_ AS (SELECT account_id, first_paid_at, horizon_at, CASE WHEN paid AND NOT gone THEN 'paid' WHEN gone AND NOT paid THEN 'not_paid' ELSE 'unknown' END AS state FROM flags)
"""

DATASET = STATES + f"""
, acts AS (
  SELECT l.account_id, count(e.event_id) AS total_product_events, count(*) FILTER (event_type = 'product_accessed') AS product_access_count, count(*) FILTER (event_type = 'locked_feature_attempted') AS locked_attempt_count,
    count(*) FILTER (event_type = 'feature_used') AS feature_used_count, count(*) FILTER (event_type = 'website_analytics_viewed') AS analytics_view_count,
    count(*) FILTER (event_type NOT IN ('product_accessed', 'locked_feature_attempted', 'feature_used', 'website_analytics_viewed')) AS other_event_count
  FROM labels_ l LEFT JOIN made USING (account_id) LEFT JOIN product_behaviour_event e ON e.account_id = l.account_id AND event_time >= created_at AND event_time < first_paid_at GROUP BY 1)
, born AS (SELECT website_id, min(event_time) AS b FROM website_lifecycle_event WHERE event_type = 'website_created' GROUP BY 1)
, webs AS (
  SELECT l.account_id, count(DISTINCT website_id) FILTER (b < first_paid_at) AS websites_created_before_paid,
    count(DISTINCT website_id) FILTER (b < first_paid_at AND website_id IN (SELECT website_id FROM website_live_period v WHERE v.valid_from < first_paid_at AND (v.valid_to > first_paid_at OR v.valid_to IS NULL))) AS live_websites_at_first_paid
  FROM labels_ l LEFT JOIN website USING (account_id) LEFT JOIN born USING (website_id) GROUP BY 1)
, dataset AS (
  SELECT account_id, first_paid_at, horizon_at, CASE WHEN first_paid_at < TIMESTAMP '{SPLITS[0][1]}' THEN 'TRAIN' WHEN first_paid_at < TIMESTAMP '{SPLITS[1][1]}' THEN 'VALIDATION'
      WHEN first_paid_at < TIMESTAMP '{SPLITS[2][1]}' THEN 'TEST' ELSE 'OUTSIDE_SPLIT' END AS split_name, epoch_us(first_paid_at - created_at) / 86400e6 AS days_until_first_paid, acts.* EXCLUDE (account_id),
    websites_created_before_paid, live_websites_at_first_paid, CASE state WHEN 'paid' THEN 1 WHEN 'not_paid' THEN 0 END AS target_m6
  FROM labels_ JOIN acts USING (account_id) JOIN webs USING (account_id) LEFT JOIN made USING (account_id))
"""


@query("state_label", STATES + "SELECT * FROM labels_")
def _(t: TestTables) -> DataFrame:
    return model.state_label(t, cutoff=CUTOFF)


@query("quarter_cohort", STATES + "SELECT date_trunc('quarter', first_paid_at)::DATE AS quarter, count(*) AS accounts, count(*) FILTER (state = 'paid') AS paid, count(*) FILTER (state = 'not_paid') AS not_paid, count(*) FILTER (state = 'unknown') AS unknown FROM labels_ GROUP BY 1")
def _(t: TestTables) -> DataFrame:
    return model.quarter_cohorts(t, cutoff=CUTOFF)


@query("ml_dataset", DATASET + "SELECT * FROM dataset")
def _(t: TestTables) -> DataFrame:
    return model.dataset(t, cutoff=CUTOFF, splits=SPLITS)


@query("ml_split_summary", DATASET + """SELECT coalesce(split_name, 'ALL') AS split_name, count(*) AS accounts, count(*) FILTER (target_m6 = 1) AS paid, count(*) FILTER (target_m6 = 0) AS not_paid,
  round(count(*) FILTER (target_m6 = 1) * 100.0::DOUBLE / nullif(count(target_m6), 0), 2) AS paid_pct FROM dataset GROUP BY ROLLUP (split_name)""")
def _(t: TestTables) -> DataFrame:
    return model.split_summary(model.dataset(t, cutoff=CUTOFF, splits=SPLITS))


@query("paid_time_clipped", f"""
, pop AS (SELECT *, first_paid_at + INTERVAL 12 MONTH AS h FROM anchor WHERE first_paid_at + INTERVAL 12 MONTH < TIMESTAMP '{CUTOFF}')
, spent AS (
  SELECT account_id, sum(greatest(0, epoch_us(least(coalesce(valid_to, h), h) - greatest(valid_from, first_paid_at)))) / 1e6 AS s, epoch_us(any_value(h) - any_value(first_paid_at)) / 1e6 AS of
  FROM pop JOIN named USING (account_id) WHERE plan <> 'free' GROUP BY 1)
SELECT account_id, round(s / 86400, 4) AS paid_days, round(s / of * 100, 2) AS paid_share_pct,
  CASE WHEN s / of >= 0.999999 THEN 'full' WHEN s / of >= 0.75 THEN '75-99' WHEN s / of >= 0.5 THEN '50-74' WHEN s / of >= 0.25 THEN '25-49' ELSE 'under 25' END AS band FROM spent""")
def _(t: TestTables) -> DataFrame:
    return model.paid_time(t, 12, CUTOFF)


@query("paid_time_summary", f"""
, pop AS (SELECT *, first_paid_at + INTERVAL 12 MONTH AS h FROM anchor WHERE first_paid_at + INTERVAL 12 MONTH < TIMESTAMP '{CUTOFF}')
, spent AS (
  SELECT account_id, sum(greatest(0, epoch_us(least(coalesce(valid_to, h), h) - greatest(valid_from, first_paid_at)))) / 1e6 AS s, epoch_us(any_value(h) - any_value(first_paid_at)) / 1e6 AS of
  FROM pop JOIN named USING (account_id) WHERE plan <> 'free' GROUP BY 1)
SELECT count(*) AS eligible_accounts, round(avg(s / 86400), 2) AS average_paid_days, round(min(s / 86400), 2) AS minimum_paid_days, round(max(s / 86400), 2) AS maximum_paid_days,
  count(*) FILTER (s = of) AS fully_paid, count(*) FILTER (s / of >= 0.95 AND s / of < 1) AS paid_95_to_100_pct, count(*) FILTER (s / of >= 0.8 AND s / of < 0.95) AS paid_80_to_95_pct,
  count(*) FILTER (s / of >= 0.5 AND s / of < 0.8) AS paid_50_to_80_pct, count(*) FILTER (s / of < 0.5) AS paid_below_50_pct, round(avg(s / 86400) FILTER (s < of), 2) AS average_partial_paid_days,
  count(*) FILTER (s < 0 OR s > of) AS invalid_duration_accounts FROM spent""")
def _(t: TestTables) -> DataFrame:
    return model.paid_time_summary(t, 12, CUTOFF)


def population_sql(m: int) -> str:
    return f"""SELECT CASE WHEN q IS NULL THEN 'SUMMARY' ELSE 'COHORT_QUARTER' END AS result_section, 'M{m}' AS horizon, q AS first_paid_quarter, CASE WHEN q IS NULL THEN (SELECT count(*) FROM anchor) END AS ever_paid_accounts,
  count(*) AS eligible_accounts, count(*) FILTER (paid AND NOT gone) AS paid_accounts, count(*) FILTER (gone AND NOT paid) AS not_paid_accounts, count(*) FILTER (paid = gone) AS unknown_accounts,
  count(*) - count(DISTINCT account_id) AS duplicate_account_rows
FROM (SELECT *, date_trunc('quarter', first_paid_at)::DATE AS q FROM ({state_flags(m)})) GROUP BY ROLLUP (q)"""


def state_flags(m: int) -> str:
    horizon = f"first_paid_at + INTERVAL {m} MONTH"
    return f"""SELECT a.account_id, first_paid_at, EXISTS (FROM named n WHERE n.account_id = a.account_id AND plan <> 'free' AND {horizon} >= valid_from AND ({horizon} < valid_to OR valid_to IS NULL)) AS paid,
  EXISTS (FROM named n WHERE n.account_id = a.account_id AND plan = 'free' AND {horizon} >= valid_from AND ({horizon} < valid_to OR valid_to IS NULL))
    OR EXISTS (FROM closed c WHERE c.account_id = a.account_id AND closure_time <= {horizon}) AS gone FROM anchor a WHERE {horizon} < TIMESTAMP '{CUTOFF}'"""


@query("population_report", " " + " UNION ALL ".join(population_sql(m) for m in (3, 6)))
def _(t: TestTables) -> DataFrame:
    return model.population_report(t, cutoff=CUTOFF)


@query("value_shares", "SELECT event_type AS value, count(*) AS rows, round(count(*)::DOUBLE / (SELECT count(*) FROM product_behaviour_event), 6) AS share FROM product_behaviour_event GROUP BY 1")
def _(t: TestTables) -> DataFrame:
    return reports.value_shares(t["product_behaviour_event"], "event_type")


def scored(t: TestTables) -> DataFrame:
    """Labelled documents scored by their length; ties are common."""
    docs = t["documents"].select("doc_id", (F.least("n_chars", F.lit(20000)) / 20000.0).alias("score"))
    return t["labels"].select("doc_id", F.col("quality").alias("label")).join(docs, "doc_id")


SCORED = ", s AS (SELECT doc_id, quality AS label, least(n_chars, 20000) / 20000.0::DOUBLE AS score FROM labels JOIN documents USING (doc_id))"


@query("average_precision", SCORED + """
, steps AS (SELECT score, count(*) AS n, sum(label) AS p FROM s WHERE label IS NOT NULL AND score IS NOT NULL GROUP BY 1)
, curve AS (SELECT p, sum(p) OVER w / sum(n) OVER w AS prec, sum(p) OVER () AS all_p, sum(n) OVER () AS all_n FROM steps WINDOW w AS (ORDER BY score DESC))
SELECT max(all_p)::BIGINT AS positives, max(all_n)::BIGINT AS rows, round(sum(prec * p / all_p), 6) AS average_precision FROM curve""")
def _(t: TestTables) -> DataFrame:
    return model.average_precision(scored(t))


@query("precision_at_10", SCORED + """
, top AS (SELECT label FROM s WHERE label IS NOT NULL ORDER BY score DESC NULLS LAST, doc_id LIMIT 10)
SELECT 10 AS k, sum(label)::BIGINT AS hits, round(sum(label) * 100.0::DOUBLE / count(*), 2) AS precision_pct, round(sum(label) * 100.0::DOUBLE / (SELECT sum(label) FROM s), 2) AS recall_pct FROM top""")
def _(t: TestTables) -> DataFrame:
    return model.precision_at(scored(t), 10, "doc_id")


@query("logistic_scores", None)
def _(t: TestTables) -> DataFrame:
    # one row for each account, read by every pass of the fit and by the scores: computed once, kept on disk
    rows = model.dataset(t, cutoff=CUTOFF, splits=SPLITS).persist(StorageLevel.DISK_ONLY)
    fitted = model.fit(rows.where("split_name = 'TRAIN'"))
    return model.score(fitted, rows).select("account_id", "split_name", "target_m6", "score")


# ---------------------------------------------------------------- reports

ROWS = f", rows AS ({SQL['ml_dataset']})"
FEATURES, COUNTED = model.FEATURES, " + ".join(reports.COUNTED)
VOLUME = {"accounts": "count(*)", "known": "count(target_m6)", "paid": "count(*) FILTER (target_m6 = 1)", "not_paid": "count(*) FILTER (target_m6 = 0)"}
CHECKS = {
    "repeated_accounts": "count(*) - count(DISTINCT account_id)", "totals_unlike_sums": f"count(*) FILTER (total_product_events <> {COUNTED})",
    "more_live_than_created": "count(*) FILTER (live_websites_at_first_paid > websites_created_before_paid)", "negative_features": f"count(*) FILTER (least({', '.join(FEATURES)}) < 0)",
}


def dataset_rows(t: TestTables) -> DataFrame:
    return model.dataset(t, cutoff=CUTOFF, splits=SPLITS)


@query("ml_data_set_report", ROWS + " " + " UNION ALL ".join([
    *[f"SELECT 'volume' AS section, coalesce(split_name, 'ALL') AS part, '{k}' AS metric, {v}::DOUBLE AS value FROM rows GROUP BY ROLLUP (split_name)" for k, v in VOLUME.items()],
    *[f"SELECT 'feature', '{f}', '{k}', {v}::DOUBLE FROM rows" for f in FEATURES for k, v in {
        "nulls": f"count(*) - count({f})", "nonzero": f"count(*) FILTER ({f} <> 0)", "nonzero_pct": f"round(count(*) FILTER ({f} <> 0) * 100.0::DOUBLE / nullif(count(*), 0), 2)", "largest": f"round(max({f}::DOUBLE), 6)"}.items()],
    *[f"SELECT 'reconciliation', NULL, '{k}', ({v})::DOUBLE FROM rows" for k, v in CHECKS.items()],
]))
def _(t: TestTables) -> DataFrame:
    return reports.data_set_report(dataset_rows(t))


@query("ml_always_paid", ROWS + """
SELECT coalesce(split_name, 'ALL') AS split_name, count(*) AS accounts, count(*) FILTER (target_m6 = 1) AS tp, count(*) FILTER (target_m6 = 0) AS fp, round(avg(target_m6), 6) AS accuracy,
  CASE WHEN max(target_m6) = 1 THEN 0.5 ELSE 0 END::DOUBLE AS balanced_accuracy, round(avg(target_m6), 6) AS precision_1, CASE WHEN max(target_m6) = 1 THEN 1 ELSE 0 END::DOUBLE AS recall_1, 0.0::DOUBLE AS recall_0
FROM rows WHERE target_m6 IS NOT NULL GROUP BY ROLLUP (split_name)""")
def _(t: TestTables) -> DataFrame:
    return reports.always_paid(dataset_rows(t))


@query("ml_feature_medians", ROWS + " " + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, target_m6 AS target, count(*) AS rows, round(quantile_cont({f}::DOUBLE, 0.5), 6) AS median, round(avg({f}::DOUBLE), 6) AS mean FROM rows WHERE target_m6 IS NOT NULL AND {f} IS NOT NULL GROUP BY 2" for f in FEATURES))
def _(t: TestTables) -> DataFrame:
    return reports.feature_medians(dataset_rows(t))


@query("ml_threshold_sweep", SCORED + f"""
, c AS (SELECT threshold, count(*) FILTER (label = 1 AND score >= threshold) AS tp, count(*) FILTER (label = 0 AND score >= threshold) AS fp, count(*) FILTER (label = 1 AND score < threshold) AS fn,
  count(*) FILTER (label = 0 AND score < threshold) AS tn FROM s, (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in reports.THRESHOLDS)}]) AS threshold) WHERE label IS NOT NULL GROUP BY 1)
SELECT threshold, tp, fp, fn, tn, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 6) AS accuracy, round((tp::DOUBLE / nullif(tp + fn, 0) + tn::DOUBLE / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy,
  round(tn::DOUBLE / nullif(tn + fn, 0), 6) AS precision_0, round(tn::DOUBLE / nullif(tn + fp, 0), 6) AS recall_0, round(2.0::DOUBLE * tn / nullif(2 * tn + fn + fp, 0), 6) AS f1_0 FROM c""")
def _(t: TestTables) -> DataFrame:
    return reports.threshold_sweep(scored(t))


@query("report_calendar", """
, ends AS (SELECT date_trunc('year', min(o_orderdate)) AS a, make_date(year(max(o_orderdate)), 12, 31) AS b FROM orders)
SELECT d::DATE AS date, year(d)::INT AS year, quarter(d)::INT AS quarter, month(d)::INT AS month_no, monthname(d) AS month, day(d)::INT AS day FROM ends, LATERAL (SELECT unnest(generate_series(a, b::TIMESTAMP, INTERVAL 1 DAY)) AS d)""")
def _(t: TestTables) -> DataFrame:
    return reports.calendar(t["orders"], "o_orderdate")


@query("report_feature_visual", """
, uses AS (SELECT feature_id, event_type, count(*) AS events, count(DISTINCT account_id) AS accounts FROM product_behaviour_event GROUP BY 1, 2)
, shown AS (SELECT feature_name, sum(events)::BIGINT AS events, sum(accounts)::BIGINT AS accounts FROM uses LEFT JOIN feature USING (feature_id)
  WHERE event_type IN ('feature_used', 'locked_feature_attempted') AND feature_name IN ('brand#1', 'brand#2', 'brand#3', 'brand#14') GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY events DESC, feature_name)::INT AS sort FROM shown""")
def _(t: TestTables) -> DataFrame:
    uses = t["product_behaviour_event"].groupBy("feature_id", "event_type").agg(F.count("*").alias("events"), F.countDistinct("account_id").alias("accounts"))
    keep = {"event_type": ["feature_used", "locked_feature_attempted"], "feature_name": ["brand#1", "brand#2", "brand#3", "brand#14"]}
    return reports.visual(uses, ["feature_name"], ["events", "accounts"], keep, "events", [(t["feature"], "feature_id")])


# ---------------------------------------------------------------- windows over events


@query("session_gap", """SELECT user_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS events FROM (
  SELECT user_id, ts, sum(CASE WHEN ts - before <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS s
  FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events)) GROUP BY user_id, s""")
def _(t: TestTables) -> DataFrame:
    rows = windows.instant(t["events"].select("user_id", "ts"), "ts")
    found = windows.sessions(rows, "user_id", "ts")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "ended_at")})


@query("tumbling_daily", "SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS events FROM events GROUP BY 1, 2")
def _(t: TestTables) -> DataFrame:
    rows = windows.instant(t["events"].select("event_type", "ts"), "ts")
    return windows.tumbling(rows, "ts", by=["event_type"]).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {name: (lambda spark, sf_dir, f=f: f(TestTables(spark, sf_dir))) for name, f in QUERIES.items()}
    return own | {name: (lambda spark, sf_dir, f=f: f(OperationalTables(spark, sf_dir))) for name, f in rule_queries.queries().items()}


def oracle_sql() -> dict[str, str]:
    return SQL | rule_queries.oracle_sql()
