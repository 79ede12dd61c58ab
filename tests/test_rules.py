"""The rules and constraints on tables that keep them all, and on copies that break one each."""

from __future__ import annotations

import re
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.plans import constraints, reports, rule_queries, rules


def d(day: int) -> datetime:
    return datetime(2024, 1, day)


# table: columns, rows; time columns are instants, all others but rating_value are text
GOOD = {
    "account": ("account_id", [("A1",)]),
    "saas_user": ("user_id", [("U1",), ("U2",)]),
    "user_account_membership": ("membership_id user_id account_id", [("M1", "U1", "A1"), ("M2", "U2", "A1")]),
    "user_account_membership_period": ("membership_period_id membership_id valid_from valid_to", [("MP1", "M1", d(1), None), ("MP2", "M2", d(1), None)]),
    "user_account_role_assignment_period": ("role_period_id membership_id role valid_from valid_to", [("R1", "M1", "editor", d(1), d(5)), ("R2", "M1", "viewer", d(5), None), ("R3", "M2", "owner", d(1), None)]),
    "account_lifecycle_period": ("account_lifecycle_period_id account_id lifecycle_state valid_from valid_to", [("L1", "A1", "active", d(1), d(20)), ("L2", "A1", "closed", d(20), None)]),
    "account_lifecycle_event": ("event_id account_id event_type event_time", [("E1", "A1", "account_created", d(1)), ("E2", "A1", "account_closure", d(20))]),
    "user_account_membership_event": ("event_id membership_id event_type event_time", [("J1", "M1", "user_joined_account", d(1)), ("J2", "M2", "user_joined_account", d(1))]),
    "website": ("website_id account_id template_origin website_purpose", [("W1", "A1", "blank", "other")]),
    "page": ("page_id website_id", [("P1", "W1")]),
    "content_item": ("content_item_id page_id content_type", [("C1", "P1", "video")]),
    "page_access_period": ("page_access_period_id page_id access_mode valid_from valid_to", [("PA1", "P1", "public", d(1), d(3)), ("PA2", "P1", "restricted", d(3), None)]),
    "content_item_access_period": ("content_item_access_period_id content_item_id access_mode valid_from valid_to", [("CA1", "C1", "public", d(1), None)]),
    "website_lifecycle_event": ("event_id website_id event_type event_time", [("WE1", "W1", "website_created", d(1)), ("WE2", "W1", "published", d(2))]),
    "website_live_period": ("live_period_id website_id valid_from valid_to", [("LP1", "W1", d(2), None)]),
    "website_address_period": ("address_period_id website_id address_value address_type valid_from valid_to", [("AD1", "W1", "x", "platform", d(1), None)]),
    "feature": ("feature_id feature_name", [("F1", "shop")]),
    "plan_feature_entitlement_period": ("entitlement_period_id plan_id feature_id valid_from valid_to", [("EN1", "PLAN_STANDARD", "F1", d(1), None)]),
    "website_feature_enablement_period": ("enablement_period_id website_id feature_id valid_from valid_to", [("EP1", "W1", "F1", d(6), d(15))]),
    "feature_enablement_lifecycle_event": ("event_id website_id feature_id event_type event_time", [("FE1", "W1", "F1", "feature_enabled", d(6)), ("FE2", "W1", "F1", "feature_disabled", d(15))]),
    "website_member": ("member_id website_id", [("MB1", "W1")]),
    "membership_invitation": ("invitation_id website_id invitee_ref invitation_time", [("I1", "W1", "x", d(2)), ("I2", "W1", "y", d(2))]),
    "invitation_outcome_event": ("event_id invitation_id event_type event_time", [("O1", "I2", "expired", d(4))]),
    "member_registration_success_event": ("event_id website_id member_id invitation_id registration_method event_time", [("RS1", "W1", "MB1", "I1", "invitation", d(3))]),
    "member_state_period": ("member_state_period_id member_id member_state valid_from valid_to", [("MS1", "MB1", "active", d(3), None)]),
    "member_profile_update_event": ("event_id member_id event_time", [("MU1", "MB1", d(4))]),
    "comment": ("comment_id member_id page_id", [("CM1", "MB1", "P1")]),
    "comment_lifecycle_event": ("event_id comment_id event_type event_time", [("CE1", "CM1", "comment_posted", d(4))]),
    "rating": ("rating_id member_id page_id rating_value", [("RT1", "MB1", "P1", 5)]),
    "rating_lifecycle_event": ("event_id rating_id event_type event_time rating_value", [("RE1", "RT1", "rating_given", d(4), 5)]),
    "product_behaviour_event": ("event_id event_type event_time user_id account_id website_id feature_id", [
        ("PE1", "feature_used", d(7), "U1", "A1", "W1", "F1"), ("PE2", "locked_feature_attempted", d(2), "U1", "A1", None, "F1"),
        ("PE3", "restricted_product_action_attempted", d(6), "U1", "A1", None, None), ("PE4", "website_analytics_viewed", d(3), "U1", "A1", "W1", None)]),
    "visitor": ("visitor_id website_id", [("V1", "W1")]),
    "audience_session": ("session_id visitor_id website_id", [("S1", "V1", "W1")]),
    "session_lifecycle_event": ("event_id session_id event_type event_time", [("SS1", "S1", "session_started", d(4)), ("SS2", "S1", "session_ended", d(5))]),
    "session_traffic_attribution": ("session_id traffic_source", [("S1", "search")]),
    "visitor_member_linkage": ("visitor_member_link_id visitor_id member_id valid_from valid_to", [("VL1", "V1", "MB1", d(3), None)]),
    "session_member_attribution": ("session_member_attribution_id session_id member_id attributed_at", [("SA1", "S1", "MB1", d(4))]),
    "audience_interaction_event": ("event_id event_type event_time session_id page_id content_item_id interaction_target_ref", [("IN1", "page_viewed", d(4), "S1", "P1", "C1", None)]),
    "signup_journey_context": ("signup_journey_id resulting_account_id", [("SJ1", "A1")]),
    "signup_journey_event": ("event_id signup_journey_id event_type event_time", [("SJ1E", "SJ1", "signup_started", d(1))]),
    "acquisition_source_attribution": ("signup_journey_id acquisition_source", [("SJ1", "search")]),
    "membership_behaviour_event": ("event_id event_type event_time website_id registration_attempt_id member_id", [
        ("MB1E", "member_registration_started", d(2), "W1", "T1", None), ("MB2E", "member_registration_failed", d(3), "W1", "T1", None), ("MB3E", "member_logged_in", d(4), "W1", None, "MB1")]),
    "plan_catalog": ("plan_id plan_name", [("PLAN_FREE", "free"), ("PLAN_STANDARD", "standard"), ("PLAN_PREMIUM", "premium")]),
    "subscription_plan_period": ("subscription_plan_period_id account_id plan_id valid_from valid_to", [("SP1", "A1", "PLAN_FREE", d(1), d(5)), ("SP2", "A1", "PLAN_STANDARD", d(5), d(20))]),
    "billing_cycle_period": ("billing_cycle_period_id account_id billing_cycle valid_from valid_to", [("B1", "A1", "monthly", d(5), d(10)), ("B2", "A1", "annual", d(10), d(20))]),
    "subscription_lifecycle_event": ("event_id account_id event_type event_time from_plan_id to_plan_id from_billing_cycle to_billing_cycle", [
        ("SE1", "A1", "subscription_upgraded", d(5), "PLAN_FREE", "PLAN_STANDARD", None, None), ("SE2", "A1", "subscription_renewed", d(8), None, None, None, None),
        ("SE3", "A1", "billing_cycle_changed", d(10), None, None, "monthly", "annual")]),
    "payment_refund_activity_event": ("event_id account_id event_type event_time payment_ref original_payment_ref", [("PY1", "A1", "payment_succeeded", d(6), "REF1", None), ("PY2", "A1", "payment_refunded", d(7), None, "REF1")]),
    "support_request": ("support_request_id account_id requester_user_id website_id problem_context agent_ref", [("SR1", "A1", "U1", "W1", "x", None)]),
    "support_lifecycle_event": ("event_id support_request_id event_type event_time agent_ref", [("SU1", "SR1", "support_request_opened", d(4), None), ("SU2", "SR1", "support_request_resolved", d(5), None)]),
}

# rule, table, rows put in place of those with equal first values (or added), violations
BROKEN = [
    ("DQ-01", "user_account_role_assignment_period", [("R1", "M1", "editor", d(2), d(4))], {("membership_role_start_gap", "MP1"), ("membership_role_internal_gap", "R2")}),
    ("DQ-01", "user_account_membership_period", [("MP2", "M2", d(1), d(9))], {("membership_role_end_gap", "MP2")}),
    ("DQ-02", "user_account_role_assignment_period", [("R3", "M2", "owner", d(1), d(9))], {("account_without_owner", "A1")}),
    ("DQ-03", "account_lifecycle_event", [("E1", "A1", "account_created", d(2))], {("account_event_period_mismatch", "A1")}),
    ("DQ-03", "user_account_membership_event", [("J3", "M1", "user_joined_account", d(3))], {("membership_joined_event_mismatch", "M1")}),
    ("DQ-04", "website_lifecycle_event", [("WE1", "W1", "website_created", d(3))], {("website_event_before_created", "WE2")}),
    ("DQ-04", "website_live_period", [("LP1", "W1", d(4), None)], {("live_period_without_published_start", "LP1"), ("published_without_live_period", "WE2")}),
    ("DQ-04", "website_address_period", [("AD1", "W1", "x", "platform", d(1), d(9))], {("live_period_address_coverage_gap", "LP1")}),
    ("DQ-05", "page_access_period", [("PA2", "P1", "public", d(4), d(9))], {("page_access_internal_gap", "PA2"), ("page_access_final_period_not_open", "PA2")}),
    ("DQ-06", "content_item", [("C2", "P1", "file")], {("content_missing_access_history", "C2")}),
    ("DQ-06", "content_item_access_period", [("CA1", "C1", "public", d(1), d(3)), ("CA2", "C1", "public", d(4), d(9))], {("content_access_internal_gap", "CA2"), ("content_access_final_period_not_open", "CA2")}),
    ("DQ-07", "website_feature_enablement_period", [("EP1", "W1", "F1", d(4), d(15))], {("enablement_without_one_entitlement", "EP1")}),
    ("DQ-08", "website_feature_enablement_period", [("EP1", "W1", "F1", d(6), d(16))], {("enablement_end_event_mismatch", "EP1"), ("disabled_event_without_period_end", "FE2")}),
    ("DQ-09", "product_behaviour_event", [("PE2", "product_accessed", d(2), "U9", "A1", None, None)], {("product_event_context", "PE2")}),
    ("DQ-10", "product_behaviour_event", [("PE1", "feature_used", d(15), "U1", "A1", "W1", "F1")], {("feature_used_context", "PE1")}),
    ("DQ-11", "product_behaviour_event", [("PE2", "locked_feature_attempted", d(5), "U1", "A1", None, "F1")], {("locked_attempt_context", "PE2")}),
    ("DQ-12", "product_behaviour_event", [("PE3", "restricted_product_action_attempted", d(4), "U1", "A1", None, None)], {("restricted_attempt_context", "PE3")}),
    ("DQ-13", "product_behaviour_event", [("PE4", "website_analytics_viewed", d(5), "U1", "A1", "W1", None)], {("analytics_view_context", "PE4")}),
    ("DQ-14", "invitation_outcome_event", [("O2", "I1", "expired", d(1))], {("invitation_resolution_cardinality", "I1"), ("invitation_outcome_before_invitation", "O2")}),
    ("DQ-15", "member_state_period", [("MS1", "MB1", "active", d(4), None)], {("member_state_initial_mismatch", "MB1")}),
    ("DQ-16", "membership_behaviour_event", [("MB2E", "member_registration_failed", d(2), "W1", "T1", None), ("MB3E", "member_logged_in", d(2), "W1", None, "MB1")], {("registration_attempt_mismatch", "T1"), ("member_login_context_mismatch", "MB3E")}),
    ("DQ-17", "rating", [("RT2", "MB1", "P1", 4)], {("rating_given_cardinality", "RT2")}),
    ("DQ-18", "audience_session", [("S1", "V1", "W2")], {("session_visitor_website", "S1")}),
    ("DQ-19", "session_lifecycle_event", [("SS2", "S1", "session_ended", d(3))], {("session_start_end", "S1")}),
    ("DQ-20", "session_traffic_attribution", [("S9", "search")], set()),
    ("DQ-20", "audience_session", [("S2", "V1", "W1")], {("session_traffic_cardinality", "S2")}),
    ("DQ-21", "audience_interaction_event", [("IN2", "page_viewed", d(6), "S1", None, None, None), ("IN3", "page_viewed", d(5), "S1", "P9", None, None)], {("interaction_context", "IN2"), ("interaction_context", "IN3")}),
    ("DQ-22", "visitor", [("V1", "W2")], {("visitor_member_website_mismatch", "VL1")}),
    ("DQ-22", "visitor_member_linkage", [("VL1", "V2", "MB1", d(3), None)], {("session_member_visitor_linkage_missing", "SA1")}),
    ("DQ-23", "signup_journey_context", [("SJ2", None)], {("signup_cardinality", "SJ2")}),
    ("DQ-24", "signup_journey_event", [("SJ1E", "SJ1", "signup_started", d(2))], {("signup_account_creation", "SJ1")}),
    ("DQ-25", "subscription_plan_period", [("SP1", "A1", "PLAN_PREMIUM", d(1), d(4)), ("SP2", "A1", "PLAN_STANDARD", d(5), None)], {("subscription_invalid_start", "SP1"), ("subscription_internal_gap", "SP2"), ("subscription_invalid_end", "SP2")}),
    ("DQ-26", "billing_cycle_period", [("B1", "A1", "monthly", d(4), d(10)), ("B2", "A1", "annual", d(10), None)], {("billing_outside_one_paid_plan", "B1"), ("billing_outside_one_paid_plan", "B2")}),
    ("DQ-27", "subscription_lifecycle_event", [
        ("SE1", "A1", "subscription_downgraded", d(5), "PLAN_FREE", "PLAN_STANDARD", None, None), ("SE2", "A1", "subscription_renewed", d(4), None, None, None, None),
        ("SE3", "A1", "billing_cycle_changed", d(11), None, None, None, None), ("SE4", "A1", "subscription_upgraded", d(6), None, None, None, None),
        ("SE5", "A1", "subscription_reactivated", d(5), None, None, None, None), ("SE6", "A1", "billing_cycle_changed", d(10), None, None, "annual", None)],
     {("plan_transition_context_or_type_mismatch", "SE1"), ("renewal_outside_paid_billing_context", "SE2"), ("billing_cycle_change_without_boundary", "SE3"),
      ("plan_transition_without_boundary", "SE4"), ("plan_transition_context_or_type_mismatch", "SE5"), ("billing_cycle_change_context_mismatch", "SE6")}),
    ("DQ-28", "payment_refund_activity_event", [("PY3", "A1", "payment_failed", d(21), "REF2", None)], {("payment_event_after_closure", "PY3")}),
    ("DQ-28", "website_feature_enablement_period", [("EP1", "W1", "F1", d(6), None)], {("feature_enablement_beyond_closure", "EP1")}),
    ("DQ-29", "payment_refund_activity_event", [("PY1", "A1", "payment_succeeded", d(4), "REF1", None)], {("payment_context", "PY1")}),
    ("DQ-30", "support_request", [("SR1", "A1", "U9", None, "x", None)], {("support_requester_not_member", "SU1")}),
    ("DQ-31", "support_request", [("SR1", "A9", "U1", "W1", "x", None)], {("support_website_account", "SR1")}),
    ("DQ-32", "support_lifecycle_event", [("SU2", "SR1", "support_request_resolved", d(3), None)], {("support_open_resolve", "SR1")}),
    ("DQ-01", "user_account_role_assignment_period", [("R9", "M2", "viewer", datetime(2023, 12, 30), d(1))], {("role_period_outside_membership", "R9")}),
    ("DQ-04", "website_lifecycle_event", [("WE9", "W1", "website_created", d(1))], {("website_created_cardinality_or_time", "W1")}),
    ("DQ-05", "page", [("P2", "W1")], {("page_missing_access_history", "P2")}),
    ("DQ-08", "website_feature_enablement_period", [("EP1", "W1", "F1", d(7), d(15))], {("enablement_start_event_mismatch", "EP1"), ("enabled_event_without_period_start", "FE1")}),
    ("DQ-14", "website_member", [("MB1", "W2")], {("registration_member_website_mismatch", "RS1")}),
    ("DQ-14", "member_registration_success_event", [("RS1", "W1", "MB1", "I1", "invitation", d(1))], {("invitation_registration_mismatch", "RS1")}),
    ("DQ-15", "website_member", [("MB2", "W1")], {("member_registration_cardinality", "MB2"), ("member_missing_state_history", "MB2")}),
    ("DQ-15", "member_state_period", [("MS1", "MB1", "active", d(3), d(5)), ("MS2", "MB1", "suspended", d(6), None)], {("member_state_internal_gap", "MS2")}),
    ("DQ-17", "comment", [("CM2", "MB1", "P1")], {("comment_posted_cardinality", "CM2")}),
    ("DQ-22", "audience_session", [("S1", "V1", "W2")], {("session_member_website_mismatch", "SA1")}),
    ("DQ-25", "account", [("A2",)], {("subscription_missing_history", "A2")}),
    ("DQ-28", "subscription_plan_period", [("SP2", "A1", "PLAN_STANDARD", d(5), d(21))], {("subscription_period_beyond_closure", "SP2")}),
    ("DQ-28", "billing_cycle_period", [("B2", "A1", "annual", d(10), d(21))], {("billing_period_beyond_closure", "B2")}),
    ("DQ-28", "feature_enablement_lifecycle_event", [("FE3", "W1", "F1", "feature_disabled", d(21))], {("feature_event_after_closure", "FE3")}),
    ("DQ-28", "subscription_lifecycle_event", [("SE9", "A1", "subscription_renewed", d(21), None, None, None, None)], {("subscription_event_after_closure", "SE9")}),
]

CONSTRAINTS = [
    ("fk support_request.requester_user_id", "support_request", [("SR1", "A1", "U9", None, "x", None)]),
    ("fk payment_refund_activity_event.original_payment_ref", "payment_refund_activity_event", [("PY2", "A1", "payment_refunded", d(7), None, "REF9")]),
    ("pk page", "page", [("P1", "W1"), ("P1", "W1")]),
    ("unique session_lifecycle_event(session_id, event_type)", "session_lifecycle_event", [("SS3", "S1", "session_ended", d(5))]),
    ("ends website_live_period", "website_live_period", [("LP1", "W1", d(2), d(2))]),
    ("apart plan_feature_entitlement_period", "plan_feature_entitlement_period", [("EN2", "PLAN_STANDARD", "F1", d(3), d(4))]),
    ("domain content_item.content_type", "content_item", [("C1", "P1", "song")]),
    ("check rating_lifecycle_event value_of_type", "rating_lifecycle_event", [("RE1", "RT1", "rating_removed", d(4), 5)]),
    ("check payment_refund_activity_event references", "payment_refund_activity_event", [("PY1", "A1", "payment_succeeded", d(6), None, None)]),
    ("same website comment", "page", [("P1", "W2")]),
    ("refund of an earlier payment", "payment_refund_activity_event", [("PY2", "A1", "payment_refunded", d(6), None, "REF1")]),
]


def kind(column: str) -> str:
    return "int" if column == "rating_value" else "timestamp_ntz" if column in ("event_time", "valid_from", "valid_to", "invitation_time", "attributed_at") else "string"


def frame(spark, name: str, put: list[tuple] = ()):
    columns, rows = GOOD[name]
    rows = [r for r in rows if r[0] not in {p[0] for p in put}] + list(put)
    return spark.createDataFrame(rows, ", ".join(f"{c} {kind(c)}" for c in columns.split())).coalesce(1)


@pytest.fixture(scope="module")
def good(spark):
    small = {"spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    yield {name: frame(spark, name) for name in GOOD}
    for k, v in before.items():
        spark.conf.set(k, v)


def test_good_tables_keep_all_rules(spark, good):
    assert len(good) == 49 and list(rules.RULES) == [f"DQ-{i:02}" for i in range(1, 33)]
    found = {name: rules.violations(good, name).collect() for name in rules.RULES}
    assert {k: v for k, v in found.items() if v} == {}


def test_every_kind_of_violation_is_broken():
    known = set(re.findall(r"SELECT '(\w+)' AS violation_type", " ".join(part for parts in rule_queries.RULE_SQL.values() for part in parts)))
    assert known == {kind_ for *_, expected in BROKEN for kind_, _ in expected}


@pytest.mark.parametrize("name, table, put, expected", BROKEN, ids=[f"{b[0]}-{b[1]}-{i}" for i, b in enumerate(BROKEN)])
def test_broken_tables_break_their_rule(spark, good, name, table, put, expected):
    got = rules.violations(good | {table: frame(spark, table, put)}, name).collect()
    assert {(r.violation_type, r.entity_id) for r in got} == expected


KINDS = {
    "fk": constraints.foreign_keys, "pk": constraints.unique_keys, "unique": constraints.unique_keys, "ends": constraints.periods, "apart": constraints.periods,
    "domain": constraints.values, "check": constraints.values, "same": constraints.between_rows, "refund": constraints.between_rows,
}


def test_constraints_of_good_tables(good):
    assert len(constraints.foreign_keys(good)) == 68
    assert {r.status for kind_ in ("check", "same") for r in constraints.verdicts(good, kind_).collect()} == {"PASS"}


@pytest.mark.parametrize("name, table, put", CONSTRAINTS, ids=[c[0] for c in CONSTRAINTS])
def test_broken_tables_break_their_constraint(spark, good, name, table, put):
    of_kind = KINDS[name.split()[0]]
    assert of_kind(good)[name].isEmpty()
    assert not of_kind(good | {table: frame(spark, table, put)})[name].isEmpty()


def test_only_rules_that_read_what_a_delivery_touched_are_judged_again(spark, good, monkeypatch):
    for name in [n for n in rules.RULES if n not in ("DQ-18", "DQ-30", "DQ-31", "DQ-32")]:
        monkeypatch.delitem(rules.RULES, name)
    before = spark.createDataFrame([tuple(r) for r in rules.verdicts(good).collect()], "rule string, violations long, status string")
    assert rules.inputs(good, "DQ-31") == {"website", "support_request"}
    broken = dict(good) | {"support_request": good["support_request"].withColumn("website_id", F.lit("elsewhere"))}
    judged = []
    for name, f in list(rules.RULES.items()):
        monkeypatch.setitem(rules.RULES, name, lambda t, name=name, f=f: (judged.append(name) if not isinstance(t, rules.Traced) else None, f(t))[1])
    after = rules.verdicts_after(broken, before, {"support_request"})
    assert set(judged) == {n for n in rules.RULES if "support_request" in rules.inputs(broken, n)} and 0 < len(judged) < 4
    full = {tuple(r) for r in rules.verdicts(broken).collect()}
    assert {tuple(r) for r in after.collect()} == full
    assert {tuple(r) for r in rules.verdicts_after(broken, before.where("rule <> 'DQ-31'"), set()).collect()} == {tuple(r) for r in before.where("rule <> 'DQ-31'").collect()} | {r for r in full if r[0] == "DQ-31"}


def test_foreign_key_verdicts_broadcast_no_owner(good):
    comment = good["comment"]
    lost, none = comment.withColumn("member_id", F.lit("gone")), comment.withColumn("member_id", F.lit(None).cast("string"))
    t = {name: good[name] for name in ("website_member", "page")} | {"comment": comment.unionAll(lost).unionAll(lost).unionAll(none)}
    found = constraints.foreign_key_verdicts(t)
    expected = {name: df.count() for name, df in constraints.foreign_keys(t).items()}
    assert {r.rule: r.violations for r in found.collect()} == expected and expected["fk comment.member_id"] == 2
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().sparkPlan().toString()


def test_crowded_keys_count_as_others_do(spark, monkeypatch):
    """With MANY = 0 every key goes the way of crowded ones; nulls, repeated events and repeated ids among them."""
    events = spark.createDataFrame([(1, "a", "f", d(2)), (1, "a", "f", d(2)), (1, "a", "f", d(9)), (2, "b", "g", d(2)), (3, None, "f", d(2)), (4, "a", None, d(2)), (5, "c", "f", None)], "event_id long, account_id string, feature_id string, event_time timestamp_ntz")
    plans = [("p", "a", "x", d(1), None), ("p", "a", "x", d(1), d(5)), ("q", "a", "y", d(2), d(3)), ("r", "b", "x", d(2), d(2)), (None, "a", "x", d(1), None), ("s", None, "x", d(1), None)]
    given = [("e", "x", "f", d(1), None), ("h", "y", "f", d(1), None), ("h", "y", "f", d(1), d(4)), ("i", "x", "g", d(1), None)]
    t = {
        "subscription_plan_period": spark.createDataFrame(plans, "subscription_plan_period_id string, account_id string, plan_id string, valid_from timestamp_ntz, valid_to timestamp_ntz"),
        "plan_feature_entitlement_period": spark.createDataFrame(given, "entitlement_period_id string, plan_id string, feature_id string, valid_from timestamp_ntz, valid_to timestamp_ntz"),
    }

    def found():
        e = rules.active(events, t["subscription_plan_period"], ["account_id"], "subscription_plan_period_id", "n")
        e = rules.entitled(e, t, ["subscription_plan_period_id"], "m")
        e = rules.entitled(e, t, ["subscription_plan_period_id", "entitlement_period_id"], "k")
        return sorted(map(str, e.select("event_id", "account_id", "feature_id", "event_time", "n", "m", "k").collect()))

    plain = found()
    monkeypatch.setattr(rules, "MANY", 0)
    assert found() == plain
    assert sum("n=2, m=2, k=2" in x for x in plain) == 2 and sum("n=2, m=0, k=0" in x for x in plain) == 1


def test_active_moves_events_once(spark):
    events = spark.range(9).selectExpr("id AS event_id", "id % 3 AS account_id", "timestamp_ntz '2024-01-02' AS event_time")
    periods = spark.range(3).selectExpr("id AS p", "id AS account_id", "timestamp_ntz '2024-01-01' AS valid_from", "cast(NULL AS timestamp_ntz) AS valid_to")
    plan = rules.active(events, periods, ["account_id"], "p", "n")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Broadcast" not in plan


def test_shuffled_partitions_of_rules_stay_small(spark):
    """Large sizes are capped, in whatever unit, and a smaller one of the session's own stays."""
    name, limit = "spark.sql.adaptive.advisoryPartitionSizeInBytes", rules.PARTITION
    old = spark.conf.get(name)
    try:
        for size, want in (("64MB", limit), ("1g", limit), (str(limit * 2), limit), ("1m", 1 << 20), ("512kb", 512 << 10), ("1000", 1000)):
            spark.conf.set(name, size)
            invited = spark.range(3).selectExpr("id AS invitation_id", "id AS website_id", "current_timestamp() AS invitation_time")
            rules.small_partitions({"membership_invitation": invited})
            got = spark.conf.get(name)
            assert got == (str(limit) if want == limit else size)
    finally:
        spark.conf.set(name, old)


def test_access_and_attempts_move_each_row_once(good):
    for name in ("DQ-05", "DQ-06"):  # histories and parents meet in one window, not in a join beside it
        assert "Join" not in rules.violations(good, name)._jdf.queryExecution().optimizedPlan().toString()
    assert "distinct" not in rules.violations(good, "DQ-16")._jdf.queryExecution().analyzed().toString()


def test_access_of_parents_without_a_key_or_history(spark):
    parent = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k long")
    periods = spark.sql("SELECT 1L AS k, x AS p, timestamp_ntz'2020-01-01' + make_dt_interval(x) AS valid_from, timestamp_ntz'2020-01-03' AS valid_to FROM VALUES (1), (4) AS v(x) UNION ALL SELECT NULL, 9, NULL, NULL UNION ALL SELECT 3, 10, NULL, NULL")
    got = sorted((r.violation_type, r.entity_id or "") for r in rules.access(parent, periods, "k", "p", "x").collect())
    assert got == [("x_access_final_period_not_open", "4"), ("x_access_internal_gap", "4"), *[("x_missing_access_history", e) for e in ("", "2", "2")]]


def shuffled_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


@pytest.mark.parametrize("query", [rules.verdicts, reports.samples])
def test_rules_leave_no_shuffled_files(spark, good, monkeypatch, query):
    for name in [n for n in rules.RULES if n not in ("DQ-05", "DQ-18", "DQ-31")]:
        monkeypatch.delitem(rules.RULES, name)
    broken = dict(good) | {"page": frame(spark, "page", [("P2", "W1")]), "support_request": frame(spark, "support_request", [("SR1", "A9", "U1", "W1", "x", None)])}
    before, old = shuffled_files(spark), spark.conf.get(rules.CLEANUP)
    found = query(broken).collect()
    until = time.time() + 20  # executors remove files after the query has ended
    while (left := shuffled_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and spark.conf.get(rules.CLEANUP) == old
    if query is rules.verdicts:
        assert sorted(tuple(r) for r in found) == [("DQ-05", 1, "FAIL"), ("DQ-18", 0, "PASS"), ("DQ-31", 1, "FAIL")]
    else:
        assert sorted(tuple(r) for r in found) == [("DQ-05", "page_missing_access_history", "P2", None), ("DQ-31", "support_website_account", "SR1", None)]


def shuffled_rows(plan) -> int:
    """Rows that the exchanges of a plan wrote, which has run without adaptive execution."""
    own = plan.metrics().get("shuffleRecordsWritten").get().value() if plan.nodeName() == "Exchange" else 0
    return own + sum(shuffled_rows(plan.children().apply(i)) for i in range(plan.children().size()))


def test_repeated_pages_and_content_are_shuffled_once(spark, good):
    """30 equal pages and 30 equal items on them make 30 * 30 * 30 rows of a violation, none of which is moved."""
    rows = lambda name, *values: frame(spark, name).limit(0).unionAll(spark.createDataFrame(list(values), frame(spark, name).schema))
    t = dict(good) | {
        "page": rows("page", *[("P1", "W2")] * 30, ("P2", "W1"), ("P2", "W2"), (None, "W1")),
        "content_item": rows("content_item", *[("C1", "P1", "video")] * 30, ("C2", "P2", "file"), ("C3", None, "file")),
        "audience_session": rows("audience_session", ("S1", "V1", "W1"), ("S1", "V1", "W1")),
        "audience_interaction_event": rows(
            "audience_interaction_event", ("I1", "page_viewed", d(4), "S1", "P1", "C1", None), ("I2", "page_viewed", d(4), "S1", "P2", "C2", None), ("I3", "page_viewed", None, "S1", None, None, None),
            ("I4", "page_viewed", d(4), "S1", None, "C3", None), ("I5", "page_viewed", d(9), "S1", None, None, None), ("I6", "page_viewed", d(4), "S1", "P9", None, None)),
    }
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = rules.violations(t, "DQ-21").groupBy("entity_id").count()
        got = {r.entity_id: r["count"] for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == {"I1": 2 * 30 * 900, "I2": 2 * 3, "I4": 2, "I5": 2, "I6": 2}
    assert shuffled_rows(found._jdf.queryExecution().executedPlan()) < 300
