from __future__ import annotations

import datetime as dt

import pytest

from cohortry import schemas
from cohortry.operators import lifecycle, lookup, membership
from cohortry.session import small_table

NOW = dt.datetime(2024, 1, 31, 12)
HOUR = dt.timedelta(hours=1)


def segment(sid, mode="cron", active=True, cron=None, refreshed=None, name=None, count=0):
    return (sid, name or f"S{sid}", None, active, "{}", mode, cron, count, refreshed, NOW - sid * HOUR, NOW - sid * HOUR)


def ids(df):
    return sorted(r.segment_id for r in df.collect())


def test_due(spark):
    segments = small_table(
        spark,
        [
            segment(1),
            segment(2, cron=""),
            segment(3, cron="no such schedule"),
            segment(4, cron="0 * * * *"),
            segment(5, cron="5 * * * *"),
            segment(6, mode="manual"),
            segment(7, mode="realtime", cron="0 * * * *"),
            segment(8, active=False),
        ],
        schemas.SEGMENTS,
    )
    ticks = [("0 * * * *", NOW), ("0 * * * *", NOW + HOUR), ("5 * * * *", NOW + dt.timedelta(minutes=5))]
    ticks = small_table(spark, ticks, "cron_expression string, due_at timestamp_ntz")
    assert ids(lifecycle.segments_due(segments, ticks, NOW + dt.timedelta(seconds=40))) == [1, 2, 3, 4, 7]
    assert ids(lifecycle.segments_due(segments, ticks, NOW + dt.timedelta(minutes=5))) == [1, 2, 3, 5]


def test_stale(spark):
    rows = []
    for n, mode in enumerate(("manual", "cron", "realtime")):
        rows += [
            segment(10 * n + 1, mode, refreshed=NOW - HOUR),
            segment(10 * n + 2, mode, refreshed=NOW - HOUR - dt.timedelta(seconds=1)),
            segment(10 * n + 3, mode),
            segment(10 * n + 4, mode, active=False),
        ]
    segments = small_table(spark, rows, schemas.SEGMENTS)
    assert ids(lifecycle.segments_stale(segments, NOW)) == [11, 12, 13, 22, 23]
    assert ids(lifecycle.needs_refresh(segments, NOW)) == [12, 13, 22, 23]


def test_list(spark):
    rows = [segment(i, "cron" if i % 2 else "manual", i % 3 > 0, count=i * 10, name=f"It's {i % 4}") for i in range(1, 31)]
    segments = small_table(spark, rows, schemas.SEGMENTS)

    def listed(page=1, size=5, **chosen):
        found = lifecycle.list_segments(segments, lifecycle.SegmentFilter(**chosen), "segment_id", page, size)
        return [r.segment_id for r in found.rows.collect()], found.total

    assert listed() == ([1, 2, 3, 4, 5], 30)
    assert listed(page=6) == ([26, 27, 28, 29, 30], 30) and listed(page=7) == ([], 30)
    assert listed(ids=(10, 12), counts=(None, 110)) == ([10, 11], 2)
    assert listed(name="IT'S 3") == ([3, 7, 11, 15, 19], 7)
    assert listed(is_active=False, refresh_mode="cron") == ([3, 9, 15, 21, 27], 5)
    assert listed(created_at=(NOW - 3 * HOUR, NOW - 2 * HOUR)) == ([2, 3], 2)
    assert listed(last_refreshed=(NOW, None)) == ([], 0)
    by_mode = [
        r.segment_id
        for page in range(1, 5)
        for r in lifecycle.list_segments(segments, lifecycle.SegmentFilter(), "refresh_mode", page, 8).rows.collect()
    ]
    assert by_mode == [*range(1, 31, 2), *range(2, 31, 2)]
    after = lifecycle.page_after(segments, "segment_id", 28, 5).collect()
    assert [r.segment_id for r in after] == [29, 30]
    down = lifecycle.list_segments(segments, lifecycle.SegmentFilter(), "customer_count", 1, 2, descending=True)
    labelled = [(r.segment_id, r.mode_label, r.status_label) for r in down.rows.collect()]
    assert labelled == [(30, "Manual", "Inactive"), (29, "Cron Schedule", "Active")]


def test_upsert(spark):
    segments = small_table(spark, [segment(1, count=7), segment(2)], schemas.SEGMENTS)
    changes = small_table(
        spark, [(2, "Renamed", None), (3, "New", False)], "segment_id int, name string, is_active boolean"
    )
    got = {r.segment_id: r for r in lifecycle.upsert_segments(segments, changes, NOW).collect()}
    assert got[1] == segments.where("segment_id = 1").first()
    assert (got[2].name, got[2].is_active, got[2].refresh_mode) == ("Renamed", True, "cron")
    assert (got[2].created_at, got[2].updated_at) == (NOW - 2 * HOUR, NOW)
    assert (got[3].name, got[3].is_active, got[3].refresh_mode, got[3].customer_count) == ("New", False, "manual", 0)
    assert got[3].created_at == got[3].updated_at == NOW
    assert lifecycle.upsert_segments(segments, changes, NOW).dtypes == segments.dtypes


def test_delete_cascades(spark):
    segments = small_table(spark, [segment(1), segment(2)], schemas.SEGMENTS)
    members = small_table(spark, [(1, 5, NOW), (2, 5, NOW)], schemas.MEMBERSHIP)
    log = small_table(spark, [(1, "saved", None, NOW), (2, "saved", None, NOW)], schemas.SEGMENT_LOG)
    left = lifecycle.delete_segments(small_table(spark, [(1,)], "segment_id int"), segments, members, log)
    assert [ids(table) for table in left] == [[2], [2], [2]]
    assert lifecycle.forget_customers(members, small_table(spark, [(6,)], "customer_id bigint")).isEmpty()


@pytest.fixture
def members(spark):
    return small_table(spark, [(1, 5, NOW), (2, 5, NOW), (3, 6, NOW), (9, 6, NOW)], schemas.MEMBERSHIP)


def test_segments_of_customers(spark, members):
    segments = small_table(spark, [segment(i) for i in (1, 2, 3)], schemas.SEGMENTS)
    got = {(r.customer_id, r.segment_id, r.name) for r in lookup.customer_segments(members, segments).collect()}
    assert got == {(5, 1, "S1"), (5, 2, "S2"), (6, 3, "S3")}
    people = small_table(spark, [(5,), (7,)], "customer_id bigint")
    arrays = {r.customer_id: r.segment_ids for r in membership.with_segment_ids(people, members).collect()}
    assert arrays == {5: [1, 2], 7: []}


def test_eligibility(spark, members):
    quotes = small_table(spark, [(1, 5), (2, 6), (3, None), (4, 7)], "quote_id bigint, customer_id bigint")

    def found(ids_, negate=False):
        return sorted(r.quote_id for r in membership.in_segments(quotes, members, ids_, negate).collect())

    assert found([1, 2]) == [1] and found([1, 3]) == found("1, 3") == [1, 2]
    assert found([1, 3], negate=True) == [4]


def test_custom_condition(spark):
    from cohortry.functions.compare import compare_number
    from cohortry.operators.conditions import ConditionRegistry
    from cohortry.plans.evaluate import RuleSet, matches
    from cohortry.plans.rules import compile_tree, group, leaf

    from .small_shop import NOW as SHOP_NOW
    from .small_shop import random_shop

    registry = ConditionRegistry()
    points = small_table(spark, [(1, 50), (2, 5)], "customer_id bigint, points int")
    registry.register(
        "Loyalty", "points", points, lambda op, v: compare_number("points", op, v), ("points",), {"points": "0"}
    )
    rules = RuleSet(
        {
            1: compile_tree(group("all", leaf("Loyalty.points", ">", "10")), registry),
            2: compile_tree(group("all", leaf("Loyalty.points", "==", "0"), leaf("Customer.gender", "==", "1")), registry),
        }
    )
    small = random_shop(3)
    found = {(r.segment_id, r.customer_id) for r in matches(small.shop(spark), rules, SHOP_NOW, registry).collect()}
    others = {r["customer_id"] for r in small.records("customer") if r["gender"] == 1} - {0, 1, 2}
    assert found == {(1, 1)} | {(2, c) for c in others}
