"""Keys, domains, checks and consistency between rows of the operational tables, each as a query of its violations.

Foreign keys and primary keys follow from the tables' columns: a table's first column is its key, and a column that
is named like an owner's key refers to it. Checks that a row store makes when a row changes are made here on the
whole tables, which finds the same rows whatever changed them.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.quality import duplicate_key, failing, orphan, outside_domain, overlap, summary, with_status

Tables = Mapping[str, DataFrame]

# The tables that own keys, columns that refer to a key by another name, and unique columns.
OWNERS = {
    "account_id": "account", "user_id": "saas_user", "membership_id": "user_account_membership", "website_id": "website", "page_id": "page",
    "content_item_id": "content_item", "feature_id": "feature", "plan_id": "plan_catalog", "member_id": "website_member",
    "invitation_id": "membership_invitation", "comment_id": "comment", "rating_id": "rating", "visitor_id": "visitor",
    "session_id": "audience_session", "signup_journey_id": "signup_journey_context", "support_request_id": "support_request",
}
OTHER_NAMES = {"requester_user_id": "user_id", "resulting_account_id": "account_id", "from_plan_id": "plan_id", "to_plan_id": "plan_id"}
UNIQUE = [
    ("feature", ["feature_name"]), ("user_account_membership", ["user_id", "account_id"]), ("payment_refund_activity_event", ["payment_ref"]),
    ("plan_catalog", ["plan_name"]), ("session_lifecycle_event", ["session_id", "event_type"]), ("session_member_attribution", ["session_id"]),
    ("signup_journey_event", ["signup_journey_id"]), ("signup_journey_context", ["resulting_account_id"]),
    ("support_lifecycle_event", ["support_request_id", "event_type"]), ("visitor_member_linkage", ["member_id"]), ("visitor_member_linkage", ["visitor_id"]),
]
# Periods of which no two with equal keys may overlap.
APART = {
    "billing_cycle_period": ["account_id"], "content_item_access_period": ["content_item_id"], "member_state_period": ["member_id"],
    "page_access_period": ["page_id"], "plan_feature_entitlement_period": ["plan_id", "feature_id"], "subscription_plan_period": ["account_id"],
    "user_account_membership_period": ["membership_id"], "user_account_role_assignment_period": ["membership_id"],
    "website_feature_enablement_period": ["website_id", "feature_id"], "website_live_period": ["website_id"],
}
# The values that a column may have.
DOMAINS = {
    ("account_lifecycle_event", "event_type"): ["account_created", "account_closure"],
    ("account_lifecycle_period", "lifecycle_state"): ["active", "closed"],
    ("acquisition_source_attribution", "acquisition_source"): ["search", "direct", "social", "referral"],
    ("audience_interaction_event", "event_type"): [
        "page_viewed", "link_clicked", "video_watched", "file_downloaded", "form_started", "form_submitted", "search_performed", "search_result_clicked", "failure_friction",
    ],
    ("billing_cycle_period", "billing_cycle"): ["monthly", "annual"],
    ("comment_lifecycle_event", "event_type"): ["comment_posted", "comment_reported", "comment_removed"],
    ("content_item", "content_type"): ["video", "file"],
    ("content_item_access_period", "access_mode"): ["public", "members_only", "restricted"],
    ("feature_enablement_lifecycle_event", "event_type"): ["feature_enabled", "feature_disabled"],
    ("invitation_outcome_event", "event_type"): ["rejected", "expired", "cancelled"],
    ("member_registration_success_event", "registration_method"): ["self", "invitation"],
    ("member_state_period", "member_state"): ["active", "deactivated", "suspended"],
    ("membership_behaviour_event", "event_type"): ["member_registration_started", "member_registration_failed", "member_logged_in"],
    ("page_access_period", "access_mode"): ["public", "members_only", "restricted"],
    ("payment_refund_activity_event", "event_type"): ["payment_method_changed", "payment_succeeded", "payment_failed", "payment_refunded"],
    ("plan_catalog", "plan_name"): ["free", "standard", "premium"],
    ("product_behaviour_event", "event_type"): ["product_accessed", "feature_used", "website_analytics_viewed", "locked_feature_attempted", "restricted_product_action_attempted"],
    ("rating_lifecycle_event", "event_type"): ["rating_given", "rating_changed", "rating_removed"],
    ("session_lifecycle_event", "event_type"): ["session_started", "session_ended"],
    ("session_traffic_attribution", "traffic_source"): ["search", "direct", "social", "referral"],
    ("signup_journey_event", "event_type"): ["signup_started"],
    ("subscription_lifecycle_event", "from_billing_cycle"): ["monthly", "annual"],
    ("subscription_lifecycle_event", "to_billing_cycle"): ["monthly", "annual"],
    ("subscription_lifecycle_event", "event_type"): [
        "subscription_upgraded", "subscription_downgraded", "subscription_renewed", "subscription_cancelled", "subscription_reactivated", "billing_cycle_changed",
    ],
    ("support_lifecycle_event", "event_type"): ["support_request_opened", "support_request_resolved"],
    ("user_account_membership_event", "event_type"): ["user_joined_account"],
    ("user_account_role_assignment_period", "role"): ["owner", "editor", "viewer"],
    ("website", "website_purpose"): ["portfolio_personal_brand", "business_services", "course_educational", "organization_nonprofit", "other"],
    ("website", "template_origin"): ["blank", "portfolio_template", "business_template", "course_template", "organization_template"],
    ("website_address_period", "address_type"): ["platform", "custom"],
    ("website_lifecycle_event", "event_type"): ["website_created", "published", "unpublished", "archived", "restored", "deleted"],
}
CHECKS = {
    ("rating", "value"): "rating_value BETWEEN 1 AND 5",
    ("rating_lifecycle_event", "value"): "rating_value BETWEEN 1 AND 5",
    ("rating_lifecycle_event", "value_of_type"): "(event_type = 'rating_removed') = (rating_value IS NULL)",
    ("payment_refund_activity_event", "references"): """(payment_ref IS NOT NULL) = (event_type IN ('payment_succeeded', 'payment_failed'))
        AND (original_payment_ref IS NOT NULL) = (event_type = 'payment_refunded')""",
}


def references(columns: Mapping[str, list[str]]) -> list[tuple[str, str, str, str]]:
    """(table, column, owner, key) of every reference among tables with these columns."""
    out = []
    for name, own in columns.items():
        for column in own:
            key = OTHER_NAMES.get(column, column)
            if (owner := OWNERS.get(key)) and owner != name and owner in columns:
                out.append((name, column, owner, key))
    return out


def foreign_keys(t: Tables) -> dict[str, DataFrame]:
    """Children whose non-null reference has no owner, by 'fk table.column'; references to tables that are not there are left out."""
    found = references({name: df.columns for name, df in t.items()})
    out = {f"fk {name}.{column}": orphan(t[name], t[owner], column, key) for name, column, owner, key in found}
    if "payment_refund_activity_event" in t:
        payments = t["payment_refund_activity_event"]
        out["fk payment_refund_activity_event.original_payment_ref"] = orphan(payments, payments.where("payment_ref is not null"), "original_payment_ref", "payment_ref")
    return out


def foreign_key_verdicts(t: Tables) -> DataFrame:
    """(rule, violations, status) of ``foreign_keys``, by one join of each owner's keys with all references to them.

    The keys are never broadcast: by the sizes of the files Spark would take most of them for small, and in one job the
    driver would hold those of dozens of joins at once.
    """
    found: dict[tuple[str, str], list[tuple[str, str, str]]] = {}
    for name, column, owner, key in references({name: df.columns for name, df in t.items()}):
        found.setdefault((owner, key), []).append((f"fk {name}.{column}", name, column))
    if (payments := "payment_refund_activity_event") in t:
        found.setdefault((payments, "payment_ref"), []).append((f"fk {payments}.original_payment_ref", payments, "original_payment_ref"))
    parts = []
    for (owner, key), children in found.items():
        refs = [t[name].select(F.col(column).alias("key"), F.lit(i).alias("at")).where("key is not null") for i, (_, name, column) in enumerate(children)]
        lost = reduce(DataFrame.unionAll, refs).join(t[owner].select(F.col(key).alias("key")).hint("merge"), "key", "left_anti")
        n = lost.agg(*[F.count_if(F.col("at") == i).alias(f"n{i}") for i in range(len(children))])
        each = F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(f"n{i}").alias("violations")) for i, (rule, _, _) in enumerate(children)])
        parts.append(n.select(F.explode(each).alias("_v")).select("_v.*"))
    return with_status(reduce(DataFrame.unionAll, parts))


def unique_keys(t: Tables) -> dict[str, DataFrame]:
    out = {f"pk {name}": duplicate_key(df, df.columns[:1]) for name, df in t.items()}
    return out | {f"unique {name}({', '.join(columns)})": duplicate_key(t[name], columns) for name, columns in UNIQUE}


def periods(t: Tables) -> dict[str, DataFrame]:
    """Periods that do not end after they start, and those that overlap an earlier one."""
    out = {f"ends {name}": failing(df, F.col("valid_to") > F.col("valid_from")) for name, df in t.items() if "valid_from" in df.columns}
    return out | {f"apart {name}": overlap(t[name], keys, ["valid_from", t[name].columns[0]]) for name, keys in APART.items()}


def values(t: Tables) -> dict[str, DataFrame]:
    out = {f"domain {name}.{column}": outside_domain(t[name], column, allowed) for (name, column), allowed in DOMAINS.items()}
    return out | {f"check {name} {what}": failing(t[name], F.expr(text)) for (name, what), text in CHECKS.items()}


def between_rows(t: Tables) -> dict[str, DataFrame]:
    """Comments and ratings whose member and page are on two websites; refunds without an earlier payment of the account."""
    member = t["website_member"].select("member_id", F.col("website_id").alias("member_website"))
    page = t["page"].select("page_id", F.col("website_id").alias("page_website"))
    apart = ~F.col("member_website").eqNullSafe(F.col("page_website"))
    out = {f"same website {name}": t[name].join(member, "member_id").join(page, "page_id").where(apart) for name in ("comment", "rating")}
    payments = t["payment_refund_activity_event"]
    paid = payments.where("event_type = 'payment_succeeded'").select(F.col("account_id").alias("_account"), F.col("payment_ref").alias("_ref"), F.col("event_time").alias("_paid_at"))
    earlier = [F.col("original_payment_ref") == F.col("_ref"), F.col("account_id") == F.col("_account"), F.col("_paid_at") < F.col("event_time")]
    out["refund of an earlier payment"] = payments.where("event_type = 'payment_refunded'").join(paid, earlier, "left_anti")
    return out


def catalogue(t: Tables) -> dict[str, DataFrame]:
    """The violations of every constraint by its name."""
    return foreign_keys(t) | unique_keys(t) | periods(t) | values(t) | between_rows(t)


def verdicts(t: Tables, kind: str) -> DataFrame:
    """(rule, violations, status) of the constraints whose names begin with ``kind``, in one job."""
    if kind.strip() == "fk":
        return foreign_key_verdicts(t)
    return summary({name: df for name, df in catalogue(t).items() if name.startswith(kind)})
