"""Members that time alone moves, without events and without reading anybody else."""

from __future__ import annotations

import datetime as dt
import re

import pytest

from cohortry.functions.compare import age_steps
from cohortry.operators.conditions import ConditionRegistry
from cohortry.plans.rules import group, leaf
from cohortry.session import small_table, work_dir
from cohortry.sources.layout import cluster_by_customer
from cohortry.sources.membership_store import MembershipStore

from .small_shop import NOW, Loops, random_shop
from .test_layout import plan
from .test_refresh import SegmentEngine, rows, segments

AGE = "Cart.cart_last_activity"
RULES = {
    1: ("realtime", True, group("all", leaf(AGE, "<", "40"))),
    2: ("realtime", True, group("all", leaf(AGE, "==", "60"))),
    3: ("realtime", True, group("any", leaf(AGE, ">", "100.5"), group("all", leaf(AGE, "!=", "30"), leaf("Customer.gender", "==", "2")))),
    4: ("realtime", True, group("all", leaf("Customer.gender", "==", "1"))),
    5: ("manual", True, group("all", leaf(AGE, "<=", "30"))),
    6: ("realtime", True, group("all", leaf(AGE, ">=", "-3"), leaf(AGE, "<=", "0"))),
}
EARLY = dt.datetime(2023, 6, 1, 7, 30)


def start(spark, small, shop=None):
    return SegmentEngine(shop or small.shop(spark), segments(spark, RULES), MembershipStore(spark, work_dir(spark, "test")))


def expected(small, now):
    loops = Loops(small, now)
    return {(i, c) for i, (mode, _, rule) in RULES.items() if mode == "realtime" for c in loops.members(rule)}


def test_runs_without_events_find_everybody(spark):
    small = random_shop(51)
    e = start(spark, small)
    e.refresh_all(EARLY)
    manual = {p for p in rows(e.members()) if p[0] == 5}
    before = rows(e.members())
    for days in (0.5, 21, 200):
        now = EARLY + dt.timedelta(days=days)
        e.refresh_elapsed(now)
        after = rows(e.members())
        assert set(after) - manual == expected(small, now) | (manual & expected(small, now))
        # who stays keeps the time of joining, who joins has the time of the run
        assert all(at == before.get(pair, now) for pair, at in after.items())
        before = after
    e.store.fold_deadlines(now)
    for days in (400,):
        now = EARLY + dt.timedelta(days=days)
        e.refresh_elapsed(now, batch=f"run {days}")
        assert e.refresh_elapsed(now, batch=f"run {days}") is None
        assert set(rows(e.members())) - manual == expected(small, now)


def test_a_late_evaluation_does_not_lose_a_deadline(spark):
    """An event that is dealt with by an earlier clock than the last run's leaves deadlines that the next run sees."""
    small = random_shop(52)
    e = start(spark, small)
    e.refresh_all(EARLY)
    e.refresh_elapsed(EARLY + dt.timedelta(days=90))
    everyone = small_table(spark, [(c,) for c in range(1, 41)], "customer_id bigint")
    e.refresh_customers(everyone, EARLY + dt.timedelta(days=10))
    e.refresh_elapsed(EARLY + dt.timedelta(days=91))
    assert {p for p in rows(e.members()) if p[0] != 5} == expected(small, EARLY + dt.timedelta(days=91))


def test_others_are_not_read(spark, monkeypatch):
    small = random_shop(53)
    shop = cluster_by_customer(small.shop(spark), work_dir(spark, "layout"), buckets=16)
    e = start(spark, small, shop)
    e.refresh_all(EARLY)
    now = EARLY + dt.timedelta(days=5)
    due = {r.customer_id for r in e.store.due(now).collect()}
    assert 0 < len(due) < 30
    weeks = re.findall(r"PartitionFilters: \[(.*?)\]\n", plan(e.store.due(now)))
    assert all("due_week" in w for w in weeks)
    seen = []
    from cohortry.plans import refresh

    real = refresh.feature_table
    monkeypatch.setattr(refresh, "feature_table", lambda shop, *rest: seen.append(real(shop, *rest)) or seen[-1])
    e.refresh_elapsed(now)
    (features,) = seen
    assert {r.customer_id for r in features.collect()} <= due
    reads = re.findall(r"\n\(\d+\) Scan parquet.*?\n\n", plan(features), re.S)
    reads = [read for read in reads if "/touched-" not in read]
    pruned = [read for read in reads if re.search(r"PartitionFilters: \[.*customer_bucket", read)]
    assert len(pruned) == len(reads) >= 2
    assert {p for p in rows(e.members()) if p[0] != 5} == expected(small, now)


@pytest.mark.parametrize("op", ["==", "!=", "<", "<=", ">", ">="])
@pytest.mark.parametrize("value", ["0", "3", "2.5", "-2", "-0.5", "x", "1e300"])
def test_steps_are_where_the_answer_changes(op, value):
    holds = {"==": int.__eq__, "!=": int.__ne__, "<": float.__lt__, "<=": float.__le__, ">": float.__gt__, ">=": float.__ge__}[op]
    steps = age_steps(op, value)
    if value in ("x", "1e300"):
        assert steps == ()
        return
    test = lambda age: holds(float(age), float(value)) if op not in ("==", "!=") else (age == float(value)) == (op == "==")
    assert {age for age in range(-10, 10) if test(age) != test(age - 1)} == set(steps)


def test_own_conditions_may_depend_on_time(spark):
    small, registry = random_shop(54), ConditionRegistry()
    trials = small_table(spark, [(c, EARLY + dt.timedelta(days=c)) for c in range(1, 30)], "customer_id bigint, ends timestamp_ntz")
    registry.register(
        "Trial", "ends_within", trials, lambda op, value: f"ends <= TIMESTAMP_NTZ '2023-06-10 07:30:00' AND ends > TIMESTAMP_NTZ '{EARLY}'",
        ("ends",), flips=lambda op, value: ("ends",),
    )
    one = {1: ("realtime", True, group("all", leaf("Trial.ends_within", "==", "9")))}
    e = SegmentEngine(small.shop(spark), segments(spark, one), MembershipStore(spark, work_dir(spark, "test")), registry)
    e.refresh_all(EARLY)
    assert {c for _, c in rows(e.members())} == set(range(1, 10))
    assert {r.customer_id for r in e.store.due(EARLY + dt.timedelta(days=5)).collect()} == {1, 2, 3, 4, 5}
    assert NOW > EARLY
