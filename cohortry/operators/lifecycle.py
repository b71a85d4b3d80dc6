"""Segment definitions: listing, saving, deleting, and which are due for a refresh."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.compare import CONTAINS, EQ, compare_text
from ..functions.values import all_of, instant_literal
from ..sources.shop import active_segments

# Refresh modes and their labels, and the staleness limit.
MODE_LABELS = {"manual": "Manual", "cron": "Cron Schedule", "realtime": "Real-time"}
STATUS_LABELS = {True: "Active", False: "Inactive"}
STALE_AFTER = dt.timedelta(hours=1)


@dataclass(frozen=True)
class SegmentFilter:
    """Grid filters; ranges are inclusive and None leaves an end open."""

    ids: tuple[int | None, int | None] = (None, None)
    counts: tuple[int | None, int | None] = (None, None)
    name: str | None = None
    is_active: bool | None = None
    refresh_mode: str | None = None
    last_refreshed: tuple[dt.datetime | None, dt.datetime | None] = (None, None)
    created_at: tuple[dt.datetime | None, dt.datetime | None] = (None, None)


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    total: int


def filter_segments(segments: DataFrame, chosen: SegmentFilter) -> DataFrame:
    tests = ["true"]
    ranges = (
        ("segment_id", chosen.ids, int),
        ("customer_count", chosen.counts, int),
        ("last_refreshed", chosen.last_refreshed, instant_literal),
        ("created_at", chosen.created_at, instant_literal),
    )
    for column, (low, high), literal in ranges:
        if low is not None:
            tests.append(f"{column} >= {literal(low)}")
        if high is not None:
            tests.append(f"{column} <= {literal(high)}")
    if chosen.name is not None:
        tests.append(compare_text("name", CONTAINS, chosen.name))
    if chosen.is_active is not None:
        tests.append("is_active" if chosen.is_active else "NOT is_active")
    if chosen.refresh_mode is not None:
        tests.append(compare_text("refresh_mode", EQ, chosen.refresh_mode))
    return segments.where(all_of(tests))


def page_of(
    rows: DataFrame, unique: str, page: int, size: int, sort_by: str | None = None, descending: bool = False
) -> Page:
    """Page ``page`` (from 1) beside the total row count.

    Ordered by ``sort_by`` and then the ``unique`` column, so pages neither overlap nor
    miss rows. Sort, offset and limit become one top-k: every task keeps page * size rows.
    """
    first = sort_by or unique
    order = [F.desc(first) if descending else F.asc(first), F.asc(unique)]
    return Page(rows.orderBy(*order).offset((page - 1) * size).limit(size), rows.count())


def page_after(rows: DataFrame, key: str, last_key: object, size: int) -> DataFrame:
    """The rows behind ``last_key``: deep paging without sorting what came before."""
    return rows.where(F.col(key) > last_key).orderBy(key).limit(size)


def with_labels(segments: DataFrame) -> DataFrame:
    modes = " ".join(f"WHEN '{code}' THEN '{label}'" for code, label in MODE_LABELS.items())
    return segments.selectExpr(
        "*",
        f"CASE refresh_mode {modes} ELSE refresh_mode END AS mode_label",
        f"if(is_active, '{STATUS_LABELS[True]}', '{STATUS_LABELS[False]}') AS status_label",
    )


def list_segments(
    segments: DataFrame, chosen: SegmentFilter, sort_by: str, page: int, size: int, descending: bool = False
) -> Page:
    found = with_labels(filter_segments(segments, chosen))
    return page_of(found, "segment_id", page, size, sort_by, descending)


def upsert_segments(segments: DataFrame, changes: DataFrame, now: dt.datetime) -> DataFrame:
    """Create or update; fields a change leaves out (or NULL) keep their value.

    New rows get the table's defaults, ``created_at`` on insert, ``updated_at`` always.
    """
    defaults = {"is_active": "true", "refresh_mode": "'manual'", "customer_count": "0"}
    stamp = instant_literal(now)

    def pick(column: str, kind: str) -> str:
        if column == "created_at":
            value = f"coalesce(old.created_at, {stamp})"
        elif column == "updated_at":
            value = f"if(new.segment_id IS NOT NULL, {stamp}, old.updated_at)"
        else:
            sources = [f"new.{column}"] if column in changes.columns else []
            sources.append(f"old.{column}")
            sources.append(defaults.get(column, "NULL"))
            value = f"coalesce({', '.join(sources)})"
        return f"CAST({value} AS {kind}) AS {column}"

    merged = segments.alias("old").join(changes.alias("new"), F.expr("old.segment_id = new.segment_id"), "full_outer")
    return merged.selectExpr(*[pick(column, kind) for column, kind in segments.dtypes])


def delete_segments(ids: DataFrame, *tables: DataFrame) -> tuple[DataFrame, ...]:
    """The given tables (definitions, members, log) without the deleted segments."""
    return tuple(table.join(ids.select("segment_id"), "segment_id", "left_anti") for table in tables)


def forget_customers(members: DataFrame, customers: DataFrame) -> DataFrame:
    """Members that still exist as customers."""
    return members.join(customers.select("customer_id"), "customer_id", "left_semi")


def segments_due(segments: DataFrame, ticks: DataFrame, now: dt.datetime) -> DataFrame:
    """What a scheduled run at ``now`` refreshes.

    ``ticks`` (cron_expression, due_at) is the schedule worked out by the scheduler. No
    expression, or one the scheduler does not know, is always due; a known one is due
    only with a tick at this minute.
    """
    minute = instant_literal(now.replace(second=0, microsecond=0))
    at_minute = f"due_at >= {minute} AND due_at < {minute} + INTERVAL 1 MINUTE"
    schedule = ticks.groupBy("cron_expression").agg(F.expr(f"bool_or({at_minute}) AS due"))
    return (
        active_segments(segments, "cron", "realtime")
        .join(schedule, "cron_expression", "left")
        .where("cron_expression IS NULL OR cron_expression IN ('', '0') OR coalesce(due, true)")
        .select(*segments.columns)
    )


def _overdue(now: dt.datetime) -> str:
    return f"(last_refreshed IS NULL OR last_refreshed < {instant_literal(now - STALE_AFTER)})"


def segments_stale(segments: DataFrame, now: dt.datetime) -> DataFrame:
    """Active scheduled segments, and realtime ones not refreshed for an hour."""
    overdue = f"refresh_mode = 'realtime' AND {_overdue(now)}"
    return active_segments(segments).where(f"refresh_mode = 'cron' OR ({overdue})")


def needs_refresh(segments: DataFrame, now: dt.datetime) -> DataFrame:
    """Per-segment check: active, not manual, and not refreshed for an hour."""
    return active_segments(segments).where(f"refresh_mode <> 'manual' AND {_overdue(now)}")
