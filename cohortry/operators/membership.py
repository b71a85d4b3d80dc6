"""Set operations on the membership relation (segment_id, customer_id, assigned_at).

Both sides are unique on (segment_id, customer_id), so none of these joins has a hot key.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import as_categories, instant_literal

KEYS = ["segment_id", "customer_id"]


def to_add(matches: DataFrame, members: DataFrame) -> DataFrame:
    return matches.join(members, KEYS, "left_anti").select(*KEYS)


def to_remove(matches: DataFrame, members: DataFrame) -> DataFrame:
    return members.join(matches, KEYS, "left_anti").select(*KEYS)


def delta(matches: DataFrame, members: DataFrame, add_only: bool = False) -> DataFrame:
    """Additions (``assigned``) and removals together, evaluating ``matches`` once."""
    if add_only:
        return to_add(matches, members).selectExpr(*KEYS, "true AS assigned")
    fresh, held = matches.selectExpr(*KEYS, "true AS matched"), members.selectExpr(*KEYS, "true AS held")
    changed = fresh.join(held, KEYS, "full_outer").where("matched IS NULL OR held IS NULL")
    return changed.selectExpr(*KEYS, "matched IS NOT NULL AS assigned")


def assign(members: DataFrame, pairs: DataFrame, now: dt.datetime) -> DataFrame:
    """Upsert: a pair assigned again gets a fresh ``assigned_at``."""
    new = pairs.select(*KEYS).distinct().selectExpr(*KEYS, f"{instant_literal(now)} AS assigned_at")
    kept = members.join(new, KEYS, "left_anti").select(*KEYS, "assigned_at")
    return kept.unionByName(new)


def remove(members: DataFrame, pairs: DataFrame) -> DataFrame:
    return members.join(pairs, KEYS, "left_anti").select(*KEYS, "assigned_at")


def segment_counts(members: DataFrame) -> DataFrame:
    return members.groupBy("segment_id").agg(F.expr("count(*) AS customer_count"))


def segment_ids(members: DataFrame) -> DataFrame:
    """The segments of each customer; at most one entry per segment, so bounded."""
    return members.groupBy("customer_id").agg(F.expr("sort_array(collect_set(segment_id)) AS segment_ids"))


def with_segment_ids(customers: DataFrame, members: DataFrame) -> DataFrame:
    """Customers plus ``segment_ids``; an empty array without memberships."""
    known = customers.join(segment_ids(members), "customer_id", "left")
    return known.withColumn("segment_ids", F.expr("coalesce(segment_ids, CAST(array() AS ARRAY<INT>))"))


def in_segments(table: DataFrame, members: DataFrame, ids: object, negate: bool = False) -> DataFrame:
    """Rows whose customer is in any of the segments (or, negated, in none).

    ``ids`` is a list or a comma-separated string.

    A NULL customer (guest) is in no segment; it is not kept by the negation either.
    """
    wanted = as_categories(ids)
    chosen = members.where(F.col("segment_id").isin(wanted)).select("customer_id").distinct()
    known = table.where("customer_id IS NOT NULL")
    return known.join(chosen, "customer_id", "left_anti" if negate else "left_semi")
