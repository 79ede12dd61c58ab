"""Two versions of a table as row changes, and the guards that run on changes rather than on a state.

Versions are compared by key and a hash of the row, in one join; only rows that differ go on to the guards, and what a
guard looks up is joined to those few.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Tables = Mapping[str, DataFrame]


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(change, key, old, new): insert, update or delete with the row before and after as structs, null where there is none.

    Keys must be unique and without nulls; columns must be the same, in any order. Equal rows have no change.
    """
    columns = old.columns
    if sorted(columns) != sorted(new.columns):
        raise ValueError(f"the versions have columns {columns} and {new.columns}")
    sides = []
    for df, name in ((old, "old"), (new, "new")):
        row = F.struct(*columns)
        sides.append(df.select(F.col(key).alias(f"_{name}"), row.alias(name), F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256).alias(f"_{name}_hash")))
    both = sides[0].join(sides[1], F.col("_old") == F.col("_new"), "full").where(~F.col("_old_hash").eqNullSafe(F.col("_new_hash")))
    kind = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").otherwise("update")
    return both.select(kind.alias("change"), F.coalesce("_old", "_new").alias(key), "old", "new")


def counted(old: Tables, new: Tables) -> DataFrame:
    """(table, change, rows) of the tables that both have, keyed by their first columns."""
    parts = [changes(old[n], new[n], old[n].columns[0]).groupBy("change").agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "change", "rows") for n in sorted({*old} & {*new})]
    return reduce(DataFrame.unionAll, parts)


def moved_parents(old: Tables, new: Tables, parent: str, key: str, other: str, other_key: str) -> DataFrame:
    """(guard, entity_id): parents whose website changed although a comment or rating of theirs lies on another website by now."""
    moved = changes(old[parent], new[parent], key).where((F.col("change") == "update") & ~F.col("old.website_id").eqNullSafe(F.col("new.website_id")))
    moved = moved.select(F.col(key), F.col("new.website_id").alias("_website"))
    given = reduce(DataFrame.unionAll, [new[n].select(key, other_key) for n in ("comment", "rating")])
    at = new[other].select(other_key, F.col("website_id").alias("_other"))
    apart = given.join(moved, key).join(at, other_key).where(~F.col("_other").eqNullSafe(F.col("_website")))
    return apart.select(F.lit(f"moved {parent}").alias("guard"), F.col(key).cast("string").alias("entity_id")).distinct()


def changed_refunded_payments(old: Tables, new: Tables) -> DataFrame:
    """(guard, entity_id): refunded payments whose reference, kind, account or time changed so that a refund has lost its payment."""
    name = "payment_refund_activity_event"
    touched = changes(old[name], new[name], "event_id").where("change = 'update' and old.payment_ref is not null").select("event_id", "old", "new")
    refunds = new[name].where("event_type = 'payment_refunded'").select(F.col("original_payment_ref").alias("_ref"), F.col("account_id").alias("_account"), F.col("event_time").alias("_time"))
    broken = (
        ~F.col("new.payment_ref").eqNullSafe(F.col("old.payment_ref")) | (F.col("new.event_type") != "payment_succeeded")
        | ~F.col("_account").eqNullSafe(F.col("new.account_id")) | (F.col("new.event_time") >= F.col("_time"))
    )
    found = touched.join(refunds, F.col("old.payment_ref") == F.col("_ref")).where(broken)
    return found.select(F.lit("changed refunded payment").alias("guard"), F.col("event_id").cast("string").alias("entity_id")).distinct()


def guards(old: Tables, new: Tables) -> DataFrame:
    """(guard, entity_id) of every change from one version to the next that a guard refuses, each once."""
    members = moved_parents(old, new, "website_member", "member_id", "page", "page_id")
    pages = moved_parents(old, new, "page", "page_id", "website_member", "member_id")
    return members.unionAll(pages).unionAll(changed_refunded_payments(old, new))
