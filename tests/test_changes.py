"""Changes between two versions, and the guards on them."""

from __future__ import annotations

from datetime import datetime as T

import pytest

from tidemark.plans import changes as m


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_changes_between_versions(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, None, 1), (4, "d", 1)], "k int, x string, y int")
    new = spark.createDataFrame([(None, "a", 1), (1, "b", 2), (1, None, 3), (9, "n", 5)], "y int, x string, k int")
    assert values(m.changes(old, new, "k"), "change", "k", "old.y", "new.y") == [("delete", 4, 1, None), ("insert", 5, None, 9)]
    changed = new.replace("b", "c")
    assert values(m.changes(old, changed, "k"), "change", "k", "old.x", "new.x") == [("delete", 4, "d", None), ("insert", 5, None, "n"), ("update", 2, "b", "c")]
    assert m.changes(old, old, "k").count() == 0 and m.changes(old.limit(0), old.limit(0), "k").count() == 0
    assert values(m.counted({"t": old}, {"t": new}), "table", "change", "rows") == [("t", "delete", 1), ("t", "insert", 1)]
    with pytest.raises(ValueError, match="columns"):
        m.changes(old, new.drop("y"), "k")
    plan = m.changes(old, new, "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join ") == 1


def tables(spark, member="w1", page="w1", payment=("p1", "payment_succeeded", "a1", 1)):
    ref, kind, account, day = payment
    return {
        "website_member": spark.createDataFrame([("m1", member), ("m2", "w2"), ("m3", "w9" if member != "w1" else "w1")], "member_id string, website_id string"),
        "page": spark.createDataFrame([("g1", page), ("g2", "w2")], "page_id string, website_id string"),
        "comment": spark.createDataFrame([("c1", "m1", "g1")], "comment_id string, member_id string, page_id string"),
        "rating": spark.createDataFrame([("r1", "m2", "g2")], "rating_id string, member_id string, page_id string"),
        "payment_refund_activity_event": spark.createDataFrame(
            [("e1", account, kind, T(2024, 1, day), ref, None), ("e2", "a1", "payment_refunded", T(2024, 1, 5), None, "p1"), ("e3", "a1", "payment_succeeded", T(2024, 1, day), "p3", None)],
            "event_id string, account_id string, event_type string, event_time timestamp_ntz, payment_ref string, original_payment_ref string"),
    }


@pytest.mark.parametrize(("change", "found"), [
    ({}, []), ({"member": "w7"}, [("moved website_member", "m1")]), ({"page": "w7"}, [("moved page", "g1")]), ({"member": "w7", "page": "w7"}, []),
    ({"payment": ("p1", "payment_succeeded", "a1", 2)}, []), ({"payment": ("p1", "payment_succeeded", "a1", 5)}, [("changed refunded payment", "e1")]),
    ({"payment": ("p1", "payment_succeeded", "a2", 1)}, [("changed refunded payment", "e1")]), ({"payment": ("p2", "payment_succeeded", "a1", 1)}, [("changed refunded payment", "e1")]),
    ({"payment": (None, "payment_succeeded", "a1", 1)}, [("changed refunded payment", "e1")]), ({"payment": ("p1", "payment_failed", "a1", 1)}, [("changed refunded payment", "e1")]),
])
def test_guards(spark, change, found):
    assert values(m.guards(tables(spark), tables(spark, **change)), "guard", "entity_id") == found
