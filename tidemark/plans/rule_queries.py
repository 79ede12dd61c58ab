"""Registered queries of the 32 rules and of the constraints over the derived operational tables, each with its DuckDB SQL.

The SQL says each violation as a predicate on the tables, mostly by correlated subqueries, and shares no text with the
DataFrame rules but the names of violations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.quality import summary
from tidemark.plans import changes, constraints, reports, rules
from tidemark.plans.operational import DERIVED, OperationalTables, duckdb_tables

HEAD = f"""{duckdb_tables()}
, joined_period AS (SELECT p.*, user_id, account_id FROM user_account_membership_period p JOIN user_account_membership USING (membership_id))
, given AS (
  SELECT p.subscription_plan_period_id, p.account_id, e.feature_id, e.entitlement_period_id, greatest(p.valid_from, e.valid_from) AS valid_from, least(p.valid_to, e.valid_to) AS valid_to
  FROM subscription_plan_period p JOIN plan_feature_entitlement_period e USING (plan_id)
  WHERE (e.valid_to IS NULL OR p.valid_from < e.valid_to) AND (p.valid_to IS NULL OR e.valid_from < p.valid_to))
, acting AS (
  SELECT m.user_id, m.account_id, lower(r.role) AS role, r.role_period_id, greatest(m.valid_from, r.valid_from) AS valid_from, least(m.valid_to, r.valid_to) AS valid_to
  FROM joined_period m JOIN user_account_role_assignment_period r USING (membership_id)
  WHERE (r.valid_to IS NULL OR m.valid_from < r.valid_to) AND (m.valid_to IS NULL OR r.valid_from < m.valid_to))
, paid AS (SELECT p.* FROM subscription_plan_period p JOIN plan_catalog USING (plan_id) WHERE plan_name <> 'free')
, shut AS (SELECT account_id, min(event_time) AS t FROM account_lifecycle_event WHERE event_type = 'account_closure' GROUP BY 1)
"""


def bad(kind: str, entity: str, rest: str, at: str = "NULL") -> str:
    return f"SELECT '{kind}' AS violation_type, cast({entity} AS VARCHAR) AS entity_id, cast({at} AS TIMESTAMP) AS at FROM {rest}"


def at(t: str, p: str) -> str:
    """Instant t lies in the period with alias p."""
    return f"{t} >= {p}.valid_from AND ({p}.valid_to IS NULL OR {t} < {p}.valid_to)"


def times(parent: str, events: str, key: str, first: str, last: str) -> str:
    """parent with numbers and times of events of two types."""
    n = lambda kind, f: f"{f} FILTER (event_type = '{kind}')"
    inner = f"SELECT {key}, {n(first, 'count(*)')} AS n1, {n(last, 'count(*)')} AS n2, {n(first, 'min(event_time)')} AS t1, {n(last, 'max(event_time)')} AS t2 FROM {events} GROUP BY 1"
    return f"(SELECT p.*, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2, t1, t2 FROM {parent} p LEFT JOIN ({inner}) s USING ({key}))"


def gaps(kind: str, table: str, key: str, id_: str) -> str:
    """Periods that start elsewhere than the one before them ended."""
    w = f"OVER (PARTITION BY {key} ORDER BY valid_from, {id_})"
    return bad(kind, id_, f"(SELECT {id_}, valid_from, lag({id_}) {w} AS b, lag(valid_to) {w} AS e FROM {table}) WHERE b IS NOT NULL AND e IS DISTINCT FROM valid_from")


def last(table: str, key: str, id_: str) -> str:
    return f"(SELECT * FROM {table} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY valid_from DESC, {id_} DESC) = 1)"


def first(table: str, key: str, id_: str) -> str:
    return f"(SELECT * FROM {table} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY valid_from, {id_}) = 1)"


def members(e: str) -> str:
    return f"(SELECT count(DISTINCT membership_period_id) FROM joined_period q WHERE q.user_id = {e}.user_id AND q.account_id = {e}.account_id AND {at(e + '.event_time', 'q')})"


def within(e: str, table: str, id_: str, extra: str = "") -> str:
    return f"(SELECT count(DISTINCT {id_}) FROM {table} q WHERE q.account_id = {e}.account_id AND {at(e + '.event_time', 'q')}{extra})"


OWNED = "EXISTS (FROM website w WHERE w.website_id = e.website_id AND w.account_id = e.account_id)"
SAME_FEATURE = " AND q.feature_id = e.feature_id"
HISTORY = [("page", "page_access_period", "page_id", "page_access_period_id", "page"), ("content_item", "content_item_access_period", "content_item_id", "content_item_access_period_id", "content")]
RANK = "CASE {} WHEN 'PLAN_FREE' THEN 0 WHEN 'PLAN_STANDARD' THEN 1 WHEN 'PLAN_PREMIUM' THEN 2 END"
SESSION = times("audience_session", "session_lifecycle_event", "session_id", "session_started", "session_ended")
JOURNEY = times("signup_journey_context", "signup_journey_event", "signup_journey_id", "signup_started", "")
INSIDE = """(SELECT r.role_period_id, r.valid_from AS rf, r.valid_to AS rt, m.membership_period_id, m.valid_from, m.valid_to FROM user_account_membership_period m JOIN user_account_role_assignment_period r USING (membership_id)
  WHERE r.valid_from >= m.valid_from AND (m.valid_to IS NULL OR r.valid_from < m.valid_to) AND (r.valid_to IS NULL OR m.valid_to IS NULL OR r.valid_to <= m.valid_to))"""
ROLE_ORDER = "OVER (PARTITION BY membership_period_id ORDER BY rf, role_period_id)"


def access(parent: str, table: str, key: str, id_: str, what: str) -> list[str]:
    return [
        bad(f"{what}_missing_access_history", key, f"{parent} a WHERE NOT EXISTS (FROM {table} p WHERE p.{key} = a.{key})"),
        gaps(f"{what}_access_internal_gap", table, key, id_),
        bad(f"{what}_access_final_period_not_open", id_, f"{last(table, key, id_)} WHERE valid_to IS NOT NULL"),
    ]


def late(kind: str, entity: str, table: str, time: str, website: bool = False) -> str:
    account = "JOIN website USING (website_id) JOIN shut USING (account_id)" if website else "JOIN shut USING (account_id)"
    return bad(kind, entity, f"{table} {account} WHERE {time} IS NULL OR {time} > shut.t")


def feature_edges(edge: str, kind: str, words: str) -> list[str]:
    same = "e.event_type = 'feature_{}' AND e.website_id = p.website_id AND e.feature_id = p.feature_id AND e.event_time = p.{}".format(kind, edge)
    return [
        bad(f"enablement_{words}_event_mismatch", "enablement_period_id", f"website_feature_enablement_period p WHERE {edge} IS NOT NULL AND (SELECT count(*) FROM feature_enablement_lifecycle_event e WHERE {same}) <> 1"),
        bad(f"{kind}_event_without_period_{words}", "event_id", f"feature_enablement_lifecycle_event e WHERE e.event_type = 'feature_{kind}' AND NOT EXISTS (FROM website_feature_enablement_period p WHERE {same})"),
    ]


TURNS = "(SELECT a.account_id, a.valid_to AS t, a.{0} AS f, b.{0} AS g FROM {1} a JOIN {1} b ON a.account_id = b.account_id AND a.valid_to = b.valid_from)"
PLAN_TURN, BILL_TURN = TURNS.format("plan_id", "subscription_plan_period"), TURNS.format("billing_cycle", "billing_cycle_period")
MOVED = "event_type IN ('subscription_upgraded', 'subscription_downgraded', 'subscription_cancelled', 'subscription_reactivated')"
NEED = """(SELECT DISTINCT l.account_lifecycle_period_id, l.account_id, x.t FROM account_lifecycle_period l JOIN (
    SELECT account_id, unnest([valid_from, valid_to]) AS t FROM joined_period
    UNION ALL SELECT account_id, unnest([r.valid_from, r.valid_to]) FROM user_account_role_assignment_period r JOIN user_account_membership USING (membership_id)
    UNION ALL SELECT account_id, valid_from FROM account_lifecycle_period WHERE lifecycle_state = 'active') x
  ON x.account_id = l.account_id AND x.t >= l.valid_from AND (l.valid_to IS NULL OR x.t < l.valid_to) WHERE l.lifecycle_state = 'active')"""
ENABLED_AT = """(SELECT DISTINCT p.enablement_period_id, p.feature_id, w.account_id, x.t FROM website_feature_enablement_period p JOIN website w USING (website_id), LATERAL (
    SELECT unnest([s.valid_from, s.valid_to]) AS t FROM subscription_plan_period s WHERE s.account_id = w.account_id
    UNION SELECT unnest([n.valid_from, n.valid_to]) FROM plan_feature_entitlement_period n WHERE n.feature_id = p.feature_id
    UNION SELECT p.valid_from) x WHERE x.t >= p.valid_from AND (p.valid_to IS NULL OR x.t < p.valid_to))"""

RULE_SQL: dict[str, list[str]] = {
    "DQ-01": [
        bad("role_period_outside_membership", "role_period_id", f"user_account_role_assignment_period r WHERE NOT EXISTS (FROM {INSIDE} i WHERE i.role_period_id = r.role_period_id)"),
        bad("membership_role_start_gap", "membership_period_id", f"user_account_membership_period m WHERE NOT EXISTS (FROM {INSIDE} i WHERE i.membership_period_id = m.membership_period_id AND rf = i.valid_from)"),
        bad("membership_role_internal_gap", "role_period_id", f"(SELECT role_period_id, rf, lag(role_period_id) {ROLE_ORDER} AS b, lag(rt) {ROLE_ORDER} AS e FROM {INSIDE}) WHERE b IS NOT NULL AND e IS DISTINCT FROM rf"),
        bad("membership_role_end_gap", "membership_period_id", f"""user_account_membership_period m WHERE NOT EXISTS (
          FROM (SELECT * FROM {INSIDE} QUALIFY row_number() OVER (PARTITION BY membership_period_id ORDER BY rf DESC, role_period_id DESC) = 1) i WHERE i.membership_period_id = m.membership_period_id AND rt IS NOT DISTINCT FROM i.valid_to)"""),
    ],
    "DQ-02": [bad("account_without_owner", "account_id", f"{NEED} n WHERE NOT EXISTS (FROM acting q WHERE q.account_id = n.account_id AND role = 'owner' AND {at('n.t', 'q')})", "t")],
    "DQ-03": [
        bad("account_event_period_mismatch", "account_id", f"""{times('account', 'account_lifecycle_event', 'account_id', 'account_created', 'account_closure')} LEFT JOIN (
          SELECT account_id, count(*) FILTER (lifecycle_state = 'active') AS an, count(*) FILTER (lifecycle_state = 'closed') AS cn, min(valid_from) FILTER (lifecycle_state = 'active') AS af,
            max(valid_to) FILTER (lifecycle_state = 'active') AS au, min(valid_from) FILTER (lifecycle_state = 'closed') AS cf, max(valid_to) FILTER (lifecycle_state = 'closed') AS cu FROM account_lifecycle_period GROUP BY 1) USING (account_id)
          WHERE n1 <> 1 OR n2 > 1 OR coalesce(an, 0) <> 1 OR af IS DISTINCT FROM t1 OR (n2 = 0 AND (au IS NOT NULL OR coalesce(cn, 0) <> 0))
            OR (n2 = 1 AND (au IS DISTINCT FROM t2 OR coalesce(cn, 0) <> 1 OR cf IS DISTINCT FROM t2 OR cu IS NOT NULL))"""),
        bad("membership_joined_event_mismatch", "membership_id", """user_account_membership LEFT JOIN (SELECT membership_id, min(valid_from) AS s FROM user_account_membership_period GROUP BY 1) USING (membership_id)
          LEFT JOIN (SELECT membership_id, count(*) AS n, min(event_time) AS j FROM user_account_membership_event WHERE event_type = 'user_joined_account' GROUP BY 1) USING (membership_id) WHERE s IS NULL OR coalesce(n, 0) <> 1 OR j IS DISTINCT FROM s"""),
    ],
    "DQ-04": [
        bad("website_created_cardinality_or_time", "website_id", f"{times('website', 'website_lifecycle_event', 'website_id', 'website_created', '')} WHERE n1 <> 1"),
        bad("website_event_before_created", "event_id", f"website_lifecycle_event e JOIN {times('website', 'website_lifecycle_event', 'website_id', 'website_created', '')} w USING (website_id) WHERE n1 = 1 AND event_time < t1"),
        bad("live_period_without_published_start", "live_period_id", "website_live_period l WHERE (SELECT count(*) FROM website_lifecycle_event e WHERE e.event_type = 'published' AND e.website_id = l.website_id AND e.event_time = l.valid_from) <> 1"),
        bad("published_without_live_period", "event_id", "website_lifecycle_event e WHERE event_type = 'published' AND NOT EXISTS (FROM website_live_period l WHERE e.website_id = l.website_id AND e.event_time = l.valid_from)"),
        bad("live_period_address_coverage_gap", "live_period_id", f"""(SELECT DISTINCT l.live_period_id, l.website_id, x.t FROM website_live_period l, LATERAL (
          SELECT unnest([a.valid_from, a.valid_to]) AS t FROM website_address_period a WHERE a.website_id = l.website_id UNION SELECT l.valid_from) x WHERE {at('x.t', 'l')}) n
          WHERE NOT EXISTS (FROM website_address_period q WHERE q.website_id = n.website_id AND {at('n.t', 'q')})""", "t"),
    ],
    "DQ-05": access(*HISTORY[0]),
    "DQ-06": access(*HISTORY[1]),
    "DQ-07": [bad("enablement_without_one_entitlement", "enablement_period_id", f"{ENABLED_AT} n WHERE (SELECT count(*) FROM given q WHERE q.account_id = n.account_id AND q.feature_id = n.feature_id AND {at('n.t', 'q')}) <> 1", "t")],
    "DQ-08": feature_edges("valid_from", "enabled", "start") + feature_edges("valid_to", "disabled", "end"),
    "DQ-09": [bad("product_event_context", "event_id", f"product_behaviour_event e WHERE {members('e')} <> 1 OR (website_id IS NOT NULL AND NOT {OWNED})")],
    "DQ-10": [bad("feature_used_context", "event_id", f"""product_behaviour_event e WHERE event_type = 'feature_used' AND (NOT {OWNED} OR {members('e')} <> 1 OR {within('e', 'given', 'subscription_plan_period_id', SAME_FEATURE)} <> 1
      OR (SELECT count(DISTINCT enablement_period_id) FROM website_feature_enablement_period q WHERE q.website_id = e.website_id{SAME_FEATURE} AND {at('e.event_time', 'q')}) <> 1)""")],
    "DQ-11": [bad("locked_attempt_context", "event_id", f"""product_behaviour_event e WHERE event_type = 'locked_feature_attempted' AND (user_id IS NULL OR feature_id IS NULL
      OR {within('e', 'subscription_plan_period', 'subscription_plan_period_id')} <> 1 OR {within('e', 'given', 'subscription_plan_period_id', SAME_FEATURE)} > 0)""")],
    "DQ-12": [bad("restricted_attempt_context", "event_id", f"product_behaviour_event e WHERE event_type = 'restricted_product_action_attempted' AND {within('e', 'acting', 'role_period_id', chr(32) + 'AND q.user_id = e.user_id AND role = ' + repr('viewer'))} <> 1")],
    "DQ-13": [bad("analytics_view_context", "event_id", f"product_behaviour_event e WHERE event_type = 'website_analytics_viewed' AND (NOT {OWNED} OR {within('e', 'acting', 'role_period_id', chr(32) + 'AND q.user_id = e.user_id AND role IN ' + repr(('owner', 'editor')))} <> 1)")],
    "DQ-14": [
        bad("invitation_resolution_cardinality", "invitation_id", """membership_invitation i WHERE (SELECT count(*) FROM invitation_outcome_event o WHERE o.invitation_id = i.invitation_id)
          + (SELECT count(*) FROM member_registration_success_event r WHERE r.invitation_id = i.invitation_id AND registration_method = 'invitation') <> 1"""),
        bad("invitation_outcome_before_invitation", "event_id", "invitation_outcome_event JOIN membership_invitation USING (invitation_id) WHERE event_time < invitation_time"),
        bad("invitation_registration_mismatch", "event_id", "member_registration_success_event r JOIN membership_invitation i USING (invitation_id) WHERE registration_method = 'invitation' AND (r.website_id IS DISTINCT FROM i.website_id OR event_time < invitation_time)"),
        bad("registration_member_website_mismatch", "event_id", "member_registration_success_event r JOIN website_member m USING (member_id) WHERE r.website_id IS DISTINCT FROM m.website_id"),
    ],
    "DQ-15": [
        bad("member_registration_cardinality", "member_id", "website_member m WHERE (SELECT count(*) FROM member_registration_success_event r WHERE r.member_id = m.member_id) <> 1"),
        bad("member_state_initial_mismatch", "member_id", f"""{first('member_state_period', 'member_id', 'member_state_period_id')} JOIN website_member USING (member_id)
          LEFT JOIN (SELECT member_id, count(*) AS n, min(event_time) AS r FROM member_registration_success_event GROUP BY 1) USING (member_id) WHERE coalesce(n, 0) <> 1 OR member_state <> 'active' OR valid_from IS DISTINCT FROM r"""),
        gaps("member_state_internal_gap", "member_state_period", "member_id", "member_state_period_id"),
        bad("member_missing_state_history", "member_id", "website_member m WHERE NOT EXISTS (FROM member_state_period p WHERE p.member_id = m.member_id)"),
    ],
    "DQ-16": [
        bad("registration_attempt_mismatch", "registration_attempt_id", """(SELECT registration_attempt_id, count(*) FILTER (event_type = 'member_registration_started') AS s, count(*) FILTER (event_type = 'member_registration_failed') AS f, count(DISTINCT website_id) AS w,
          min(event_time) FILTER (event_type = 'member_registration_started') AS st, max(event_time) FILTER (event_type = 'member_registration_failed') AS ft FROM membership_behaviour_event
          WHERE event_type IN ('member_registration_started', 'member_registration_failed') AND registration_attempt_id IS NOT NULL GROUP BY 1) WHERE s <> 1 OR f > 1 OR w <> 1 OR (f = 1 AND ft <= st)"""),
        bad("member_login_context_mismatch", "event_id", """membership_behaviour_event e LEFT JOIN website_member m ON m.member_id = e.member_id WHERE event_type = 'member_logged_in' AND (m.member_id IS NULL OR m.website_id IS DISTINCT FROM e.website_id
          OR NOT coalesce((SELECT min(r.event_time) FROM member_registration_success_event r WHERE r.member_id = e.member_id AND r.website_id = e.website_id) <= e.event_time, false))"""),
    ],
    "DQ-17": [
        bad("comment_posted_cardinality", "comment_id", "comment c WHERE (SELECT count(*) FROM comment_lifecycle_event e WHERE e.comment_id = c.comment_id AND event_type = 'comment_posted') <> 1"),
        bad("rating_given_cardinality", "rating_id", "rating c WHERE (SELECT count(*) FROM rating_lifecycle_event e WHERE e.rating_id = c.rating_id AND event_type = 'rating_given') <> 1"),
    ],
    "DQ-18": [bad("session_visitor_website", "session_id", "audience_session s JOIN visitor v USING (visitor_id) WHERE s.website_id IS DISTINCT FROM v.website_id")],
    "DQ-19": [bad("session_start_end", "session_id", f"{SESSION} WHERE n1 <> 1 OR n2 <> 1 OR t2 < t1")],
    "DQ-20": [bad("session_traffic_cardinality", "session_id", "audience_session s WHERE (SELECT count(*) FROM session_traffic_attribution a WHERE a.session_id = s.session_id) <> 1")],
    "DQ-21": [bad("interaction_context", "event_id", f"""audience_interaction_event e JOIN {SESSION} s USING (session_id) LEFT JOIN page p ON p.page_id = e.page_id
      LEFT JOIN (SELECT content_item_id, w.website_id FROM content_item LEFT JOIN page w USING (page_id)) c ON c.content_item_id = e.content_item_id
      WHERE n1 <> 1 OR n2 <> 1 OR event_time < t1 OR event_time > t2 OR (e.page_id IS NOT NULL AND p.website_id IS DISTINCT FROM s.website_id) OR (e.content_item_id IS NOT NULL AND c.website_id IS DISTINCT FROM s.website_id)""")],
    "DQ-22": [
        bad("visitor_member_website_mismatch", "visitor_member_link_id", "visitor_member_linkage JOIN visitor v USING (visitor_id) JOIN website_member m USING (member_id) WHERE v.website_id IS DISTINCT FROM m.website_id"),
        bad("session_member_website_mismatch", "session_member_attribution_id", "session_member_attribution JOIN audience_session s USING (session_id) JOIN website_member m USING (member_id) WHERE s.website_id IS DISTINCT FROM m.website_id"),
        bad("session_member_visitor_linkage_missing", "session_member_attribution_id", "session_member_attribution a JOIN audience_session s USING (session_id) WHERE NOT EXISTS (FROM visitor_member_linkage l WHERE l.visitor_id = s.visitor_id AND l.member_id = a.member_id)"),
    ],
    "DQ-23": [bad("signup_cardinality", "signup_journey_id", f"{JOURNEY} j WHERE n1 <> 1 OR (SELECT count(*) FROM acquisition_source_attribution a WHERE a.signup_journey_id = j.signup_journey_id) <> 1")],
    "DQ-24": [bad("signup_account_creation", "signup_journey_id", f"""{JOURNEY} j LEFT JOIN (SELECT account_id, count(*) AS n, min(event_time) AS c FROM account_lifecycle_event WHERE event_type = 'account_created' GROUP BY 1) a ON a.account_id = j.resulting_account_id
      WHERE resulting_account_id IS NOT NULL AND (coalesce(n, 0) <> 1 OR n1 <> 1 OR c < t1)""")],
    "DQ-25": [
        bad("subscription_missing_history", "account_id", "account a WHERE NOT EXISTS (FROM subscription_plan_period p WHERE p.account_id = a.account_id)"),
        bad("subscription_invalid_start", "subscription_plan_period_id", f"""{first('subscription_plan_period', 'account_id', 'subscription_plan_period_id')} p JOIN account USING (account_id)
          LEFT JOIN (SELECT account_id, min(event_time) AS c FROM account_lifecycle_event WHERE event_type = 'account_created' GROUP BY 1) USING (account_id) WHERE plan_id <> 'PLAN_FREE' OR valid_from IS DISTINCT FROM c"""),
        gaps("subscription_internal_gap", "subscription_plan_period", "account_id", "subscription_plan_period_id"),
        bad("subscription_invalid_end", "subscription_plan_period_id", f"{last('subscription_plan_period', 'account_id', 'subscription_plan_period_id')} p JOIN account USING (account_id) LEFT JOIN shut USING (account_id) WHERE valid_to IS DISTINCT FROM shut.t"),
    ],
    "DQ-26": [bad("billing_outside_one_paid_plan", "billing_cycle_period_id", """billing_cycle_period b WHERE (SELECT count(*) FROM paid p WHERE p.account_id = b.account_id AND b.valid_from >= p.valid_from
      AND (p.valid_to IS NULL OR (b.valid_to IS NOT NULL AND b.valid_to <= p.valid_to))) <> 1""")],
    "DQ-27": [
        bad("plan_transition_without_boundary", "event_id", f"subscription_lifecycle_event e WHERE {MOVED} AND NOT EXISTS (FROM {PLAN_TURN} x WHERE x.account_id = e.account_id AND x.t = e.event_time)"),
        bad("plan_transition_context_or_type_mismatch", "event_id", f"""subscription_lifecycle_event e JOIN {PLAN_TURN} x ON x.account_id = e.account_id AND x.t = e.event_time WHERE {MOVED} AND (from_plan_id <> f OR to_plan_id <> g
          OR (event_type = 'subscription_upgraded' AND NOT {RANK.format('g')} > {RANK.format('f')}) OR (event_type = 'subscription_downgraded' AND NOT {RANK.format('g')} < {RANK.format('f')})
          OR (event_type = 'subscription_cancelled' AND NOT (f <> 'PLAN_FREE' AND g = 'PLAN_FREE'))
          OR (event_type = 'subscription_reactivated' AND NOT (f = 'PLAN_FREE' AND g <> 'PLAN_FREE' AND EXISTS (FROM subscription_plan_period p WHERE p.account_id = e.account_id AND p.plan_id <> 'PLAN_FREE' AND p.valid_to <= e.event_time))))"""),
        bad("renewal_outside_paid_billing_context", "event_id", f"subscription_lifecycle_event e WHERE event_type = 'subscription_renewed' AND ({within('e', 'paid', 'subscription_plan_period_id')} <> 1 OR {within('e', 'billing_cycle_period', 'billing_cycle_period_id')} <> 1)"),
        bad("billing_cycle_change_without_boundary", "event_id", f"subscription_lifecycle_event e WHERE event_type = 'billing_cycle_changed' AND NOT EXISTS (FROM {BILL_TURN} x WHERE x.account_id = e.account_id AND x.t = e.event_time AND f IS DISTINCT FROM g)"),
        bad("billing_cycle_change_context_mismatch", "event_id", f"subscription_lifecycle_event e JOIN {BILL_TURN} x ON x.account_id = e.account_id AND x.t = e.event_time AND f IS DISTINCT FROM g WHERE event_type = 'billing_cycle_changed' AND (from_billing_cycle <> f OR to_billing_cycle <> g)"),
    ],
    "DQ-28": [
        late("feature_enablement_beyond_closure", "enablement_period_id", "website_feature_enablement_period", "valid_to", True), late("feature_event_after_closure", "event_id", "feature_enablement_lifecycle_event", "event_time", True),
        late("subscription_period_beyond_closure", "subscription_plan_period_id", "subscription_plan_period", "valid_to"), late("billing_period_beyond_closure", "billing_cycle_period_id", "billing_cycle_period", "valid_to"),
        late("subscription_event_after_closure", "event_id", "subscription_lifecycle_event", "event_time"), late("payment_event_after_closure", "event_id", "payment_refund_activity_event", "event_time"),
    ],
    "DQ-29": [bad("payment_context", "event_id", f"payment_refund_activity_event e WHERE event_type = 'payment_succeeded' AND ({within('e', 'paid', 'subscription_plan_period_id')} <> 1 OR {within('e', 'billing_cycle_period', 'billing_cycle_period_id')} <> 1)")],
    "DQ-30": [bad("support_requester_not_member", "event_id", f"""support_lifecycle_event e JOIN support_request r USING (support_request_id) WHERE event_type = 'support_request_opened'
      AND NOT EXISTS (FROM joined_period q WHERE q.user_id = r.requester_user_id AND q.account_id = r.account_id AND {at('e.event_time', 'q')})""")],
    "DQ-31": [bad("support_website_account", "support_request_id", "support_request r JOIN website w USING (website_id) WHERE w.account_id IS DISTINCT FROM r.account_id")],
    "DQ-32": [bad("support_open_resolve", "support_request_id", f"{times('support_request', 'support_lifecycle_event', 'support_request_id', 'support_request_opened', 'support_request_resolved')} WHERE n1 <> 1 OR n2 > 1 OR t2 < t1")],
}


def constraint_sql() -> dict[str, dict[str, str]]:
    """By family, each constraint's DuckDB query of one number: how many rows (or keys) break it."""
    columns = {name: COLUMNS[name].split() for name in DERIVED}
    fk = {}
    for name, own in columns.items():
        for c in own:
            key = constraints.OTHER_NAMES.get(c, c)
            if (owner := constraints.OWNERS.get(key)) and owner != name:
                fk[f"fk {name}.{c}"] = f"{name} x WHERE {c} IS NOT NULL AND NOT EXISTS (FROM {owner} o WHERE o.{key} = x.{c})"
    fk["fk payment_refund_activity_event.original_payment_ref"] = "payment_refund_activity_event x WHERE original_payment_ref IS NOT NULL AND NOT EXISTS (FROM payment_refund_activity_event o WHERE o.payment_ref = x.original_payment_ref)"
    twice = lambda name, cs: f"(SELECT 1 FROM {name} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in cs)} GROUP BY {', '.join(cs)} HAVING count(*) > 1)"
    unique = {f"pk {name}": twice(name, own[:1]) for name, own in columns.items()} | {f"unique {name}({', '.join(cs)})": twice(name, cs) for name, cs in constraints.UNIQUE}
    apart = {f"ends {name}": f"{name} WHERE valid_to <= valid_from" for name, own in columns.items() if "valid_from" in own}
    for name, keys in constraints.APART.items():
        order = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY valid_from, {columns[name][0]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        apart[f"apart {name}"] = f"(SELECT valid_from, max(coalesce(valid_to, TIMESTAMP '9999-12-31')) {order} AS e FROM {name}) WHERE valid_from < e"
    values = {f"domain {name}.{c}": f"{name} WHERE {c} NOT IN ({', '.join(map(repr, allowed))})" for (name, c), allowed in constraints.DOMAINS.items()}
    values |= {f"check {name} {what}": f"{name} WHERE NOT ({text})" for (name, what), text in constraints.CHECKS.items()}
    between = {f"same website {name}": f"{name} JOIN website_member m USING (member_id) JOIN page p USING (page_id) WHERE m.website_id IS DISTINCT FROM p.website_id" for name in ("comment", "rating")}
    between["refund of an earlier payment"] = """payment_refund_activity_event r WHERE event_type = 'payment_refunded' AND NOT EXISTS (FROM payment_refund_activity_event p
      WHERE p.event_type = 'payment_succeeded' AND p.payment_ref = r.original_payment_ref AND p.account_id = r.account_id AND p.event_time < r.event_time)"""
    return {"dq_fk": fk, "dq_unique": unique, "dq_apart": apart, "dq_checks": values, "dq_between_rows": between}


#: Columns of the derived tables, as their derivations name them.
COLUMNS = {
    "account": "account_id", "saas_user": "user_id", "user_account_membership": "membership_id user_id account_id", "user_account_membership_period": "membership_period_id membership_id valid_from valid_to",
    "user_account_role_assignment_period": "role_period_id membership_id role valid_from valid_to", "account_lifecycle_period": "account_lifecycle_period_id account_id lifecycle_state valid_from valid_to",
    "account_lifecycle_event": "event_id account_id event_type event_time", "user_account_membership_event": "event_id membership_id event_type event_time", "website": "website_id account_id template_origin website_purpose",
    "website_lifecycle_event": "event_id website_id event_type event_time", "website_live_period": "live_period_id website_id valid_from valid_to", "website_address_period": "address_period_id website_id address_value address_type valid_from valid_to",
    "page": "page_id website_id", "content_item": "content_item_id page_id content_type", "page_access_period": "page_access_period_id page_id access_mode valid_from valid_to",
    "content_item_access_period": "content_item_access_period_id content_item_id access_mode valid_from valid_to", "feature": "feature_id feature_name", "plan_catalog": "plan_id plan_name",
    "plan_feature_entitlement_period": "entitlement_period_id plan_id feature_id valid_from valid_to", "subscription_plan_period": "subscription_plan_period_id account_id plan_id valid_from valid_to",
    "billing_cycle_period": "billing_cycle_period_id account_id billing_cycle valid_from valid_to", "subscription_lifecycle_event": "event_id account_id event_type event_time from_plan_id to_plan_id from_billing_cycle to_billing_cycle",
    "website_feature_enablement_period": "enablement_period_id website_id feature_id valid_from valid_to", "feature_enablement_lifecycle_event": "event_id website_id feature_id event_type event_time",
    "product_behaviour_event": "event_id event_type event_time user_id account_id website_id feature_id", "website_member": "member_id website_id", "membership_invitation": "invitation_id website_id invitee_ref invitation_time",
    "invitation_outcome_event": "event_id invitation_id event_type event_time", "member_registration_success_event": "event_id website_id member_id invitation_id registration_method event_time",
    "member_state_period": "member_state_period_id member_id member_state valid_from valid_to", "member_profile_update_event": "event_id member_id event_time", "comment": "comment_id member_id page_id",
    "comment_lifecycle_event": "event_id comment_id event_type event_time", "rating": "rating_id member_id page_id rating_value", "rating_lifecycle_event": "event_id rating_id event_type event_time rating_value",
    "visitor": "visitor_id website_id", "audience_session": "session_id visitor_id website_id", "session_lifecycle_event": "event_id session_id event_type event_time", "session_traffic_attribution": "session_id traffic_source",
    "visitor_member_linkage": "visitor_member_link_id visitor_id member_id valid_from valid_to", "session_member_attribution": "session_member_attribution_id session_id member_id attributed_at",
    "audience_interaction_event": "event_id event_type event_time session_id page_id content_item_id interaction_target_ref", "signup_journey_context": "signup_journey_id resulting_account_id",
    "signup_journey_event": "event_id signup_journey_id event_type event_time", "acquisition_source_attribution": "signup_journey_id acquisition_source",
    "membership_behaviour_event": "event_id event_type event_time website_id registration_attempt_id member_id", "payment_refund_activity_event": "event_id account_id event_type event_time payment_ref original_payment_ref",
    "support_request": "support_request_id account_id requester_user_id website_id problem_context agent_ref", "support_lifecycle_event": "event_id support_request_id event_type event_time agent_ref",
}
FAMILIES: dict[str, Callable] = {"dq_fk": constraints.foreign_keys, "dq_unique": constraints.unique_keys, "dq_apart": constraints.periods, "dq_checks": constraints.values, "dq_between_rows": constraints.between_rows}


#: A next version of three tables: some members and pages on another website, some payments later; in both dialects.
NEXT = {
    "website_member": {"website_id": "CASE WHEN member_id % 50 = 1 THEN website_id + 1 ELSE website_id END"},
    "page": {"website_id": "CASE WHEN page_id % 70 = 2 THEN website_id + 1 ELSE website_id END"},
    "payment_refund_activity_event": {"event_time": "CASE WHEN account_id % 8 = 0 AND event_type = 'payment_succeeded' THEN event_time + INTERVAL 250 DAY ELSE event_time END"},
}


def next_version(t: OperationalTables) -> dict[str, DataFrame]:
    changed = {name: t[name].withColumns({c: F.expr(text) for c, text in columns.items()}) for name, columns in NEXT.items()}
    return changed | {name: t[name] for name in ("comment", "rating")}


def guards_sql() -> str:
    def moved(parent: str, key: str, other: str, other_key: str) -> str:
        return f"""SELECT DISTINCT 'moved {parent}' AS guard, n.{key}::VARCHAR AS entity_id FROM {parent} o JOIN next_{parent} n USING ({key})
          JOIN (SELECT member_id, page_id FROM comment UNION ALL SELECT member_id, page_id FROM rating) g USING ({key}) JOIN next_{other} x USING ({other_key})
          WHERE o.website_id IS DISTINCT FROM n.website_id AND x.website_id IS DISTINCT FROM n.website_id"""

    later = ", ".join(f"next_{name} AS (SELECT * REPLACE ({', '.join(f'{text} AS {c}' for c, text in columns.items())}) FROM {name})" for name, columns in NEXT.items())
    return f"""{HEAD}, {later} {moved("website_member", "member_id", "page", "page_id")} UNION ALL {moved("page", "page_id", "website_member", "member_id")} UNION ALL
      SELECT 'changed refunded payment', o.event_id::VARCHAR FROM payment_refund_activity_event o JOIN next_payment_refund_activity_event n USING (event_id)
      WHERE o.event_time <> n.event_time AND EXISTS (FROM next_payment_refund_activity_event r WHERE r.event_type = 'payment_refunded' AND r.original_payment_ref = o.payment_ref
        AND (r.account_id IS DISTINCT FROM n.account_id OR n.event_time >= r.event_time))"""


def queries() -> dict[str, Callable[[OperationalTables], DataFrame]]:
    """dq_rule_01 to dq_rule_32 (all violations), the constraint families and dq_verdicts (counts)."""
    out = {f"dq_rule_{name[3:]}": (lambda t, name=name: rules.violations(t, name)) for name in rules.RULES}
    out |= {name: (lambda t, family=family: summary(family(t))) for name, family in FAMILIES.items()}
    out["dq_fk"] = constraints.foreign_key_verdicts
    out["change_guards"] = lambda t: changes.guards(t, next_version(t))
    return out | {"dq_verdicts": rules.verdicts, "dq_samples": reports.samples, "dq_imperfections": reports.imperfections}


def oracle_sql() -> dict[str, str]:
    def counts(parts: dict[str, str]) -> str:
        rows = " UNION ALL ".join(f"SELECT '{name}' AS rule, count(*) AS violations FROM {rest}" for name, rest in parts.items())
        return f"{HEAD} SELECT rule, violations, CASE WHEN violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM ({rows})"

    out = {f"dq_rule_{name[3:]}": f"{HEAD} " + " UNION ALL ".join(parts) for name, parts in RULE_SQL.items()}
    out["change_guards"] = guards_sql()
    out |= {name: counts(parts) for name, parts in constraint_sql().items()}
    out["dq_verdicts"] = counts({name: "(" + " UNION ALL ".join(parts) + ")" for name, parts in RULE_SQL.items()})
    some = "(SELECT '{}' AS rule, * FROM ({}) ORDER BY violation_type, entity_id, \"at\" NULLS FIRST LIMIT 5)"
    out["dq_samples"] = f"{HEAD} " + " UNION ALL ".join(some.format(name, " UNION ALL ".join(parts)) for name, parts in RULE_SQL.items())
    blank = {"product_event_without_website": ("product_behaviour_event", "website_id"), "signup_without_account": ("signup_journey_context", "resulting_account_id"), "interaction_without_page": ("audience_interaction_event", "page_id"), "open_membership_period": ("user_account_membership_period", "valid_to")}
    late = """SELECT 'late_session_attribution' AS imperfection, count(*) FILTER (attributed_at > t + INTERVAL 1 DAY) AS rows, count(*) AS of
      FROM session_member_attribution JOIN (SELECT session_id, min(event_time) AS t FROM session_lifecycle_event WHERE event_type = 'session_started' GROUP BY 1) USING (session_id)"""
    out["dq_imperfections"] = f"{HEAD} {late} " + " ".join(f"UNION ALL SELECT '{k}', count(*) - count({c}), count(*) FROM {t}" for k, (t, c) in blank.items())
    return out
