from __future__ import annotations

import datetime as dt

import pytest

from cohortry.functions.values import RuleError
from cohortry.operators import membership
from cohortry.plans.refresh import SegmentEngine
from cohortry.plans.rules import group, leaf
from cohortry.session import small_table, work_dir
from cohortry.sources.membership_store import MembershipStore
from cohortry import schemas
from cohortry.suite.definitions import rule_text

from .small_shop import NOW, Loops, random_shop

LATER = NOW + dt.timedelta(days=1)
RULES = {
    1: ("manual", True, group("all", leaf("Order.total_orders", ">=", "2"))),
    2: ("realtime", True, group("all", leaf("Cart.has_active_cart", "==", "1"))),
    3: ("realtime", True, group("any", leaf("Order.used_coupon", "==", "SAVE1"), leaf("Customer.gender", "==", "2"))),
    4: ("realtime", False, group("all", leaf("Customer.gender", "==", "1"))),
    5: ("cron", True, group("all", leaf("Weather.rain", "==", "1"))),
    6: ("realtime", True, group("all", leaf("Order.total_orders", ">", "1000"))),
}


def segments(spark, rules=None):
    rows = [
        (i, f"S{i}", None, active, rule_text(rule), mode, None, 0, None, NOW, NOW)
        for i, (mode, active, rule) in (rules or RULES).items()
    ]
    return small_table(spark, rows, schemas.SEGMENTS)


def engine(spark, small, store=None, rules=None) -> SegmentEngine:
    store = store or MembershipStore(spark, work_dir(spark, "test"))
    return SegmentEngine(small.shop(spark), segments(spark, rules), store)


def rows(df):
    return {(r.segment_id, r.customer_id): r.assigned_at for r in df.select("segment_id", "customer_id", "assigned_at").collect()}


@pytest.fixture(scope="module")
def small():
    return random_shop(11)


def test_refresh_all(spark, small):
    e, loops = engine(spark, small), Loops(small)
    report = e.refresh_all(NOW)
    expected = {i: loops.members(RULES[i][2]) for i in (1, 2, 3, 6)}
    assert report.counts == {i: len(m) for i, m in expected.items()}
    assert report.total == sum(report.counts.values())
    assert list(report.failures) == [5]
    assert rows(e.members()) == {(i, c): NOW for i, m in expected.items() for c in m}
    # a second run changes nothing but the time
    assert e.refresh_all(LATER).counts == report.counts
    assert rows(e.members()) == {pair: LATER for pair in rows(e.members())}
    # one at a time gives the same as all at once
    single = engine(spark, small)
    for i in (1, 2, 3, 6):
        assert single.refresh_segment(i, LATER) == report.counts[i]
    assert rows(single.members()) == rows(e.members())


def test_refresh_one(spark, small):
    e = engine(spark, small)
    assert e.refresh_segment(4, NOW) == 0 and not rows(e.members())
    with pytest.raises(LookupError):
        e.refresh_segment(99, NOW)
    with pytest.raises(RuleError):
        e.refresh_segment(5, NOW)
    report = e.mass_refresh([1, 4, 5, 99], NOW)
    assert report.counts.keys() == {1, 4} and report.counts[4] == 0
    assert report.failures.keys() == {5, 99}


def test_a_failed_refresh_keeps_the_members(spark, small):
    e = engine(spark, small)
    e.refresh_all(NOW)
    before = rows(e.members())
    broken = engine(spark, small, e.store, {1: ("manual", True, group("all", leaf("Weather.rain", "==", "1")))})
    with pytest.raises(RuleError):
        broken.refresh_segment(1, LATER)
    # data written without its commit stays invisible, and is overwritten by the next refresh
    e.matches(LATER, 1).selectExpr("1 AS segment_id", "customer_id + 1000 AS customer_id").write.partitionBy(
        "segment_id"
    ).parquet(f"{e.store.root}/members/seq={e.store.next_seq()}")
    assert rows(e.members()) == before
    e.refresh_segment(2, LATER)
    assert {c for s, c in rows(e.members()) if s == 1} == {c for s, c in before if s == 1}


def test_facts_that_cannot_be_read_stop_one_segment_only(spark, small):
    gone = work_dir(spark, "gone")
    spark.range(1).selectExpr("id AS customer_id", "1 AS points").write.parquet(gone)
    points = spark.read.parquet(gone)
    broken = points.selectExpr("customer_id", "raise_error('unreadable') AS points")
    rules = {**RULES, 7: ("manual", True, group("all", leaf("Loyalty.points", "==", "1")))}
    e = engine(spark, small, rules=rules)
    e.registry.register("Loyalty", "points", broken, lambda op, v: f"points = {int(v)}", ("points",))
    report = e.refresh_all(NOW)
    assert report.failures.keys() == {5, 7} and "unreadable" in report.failures[7]
    loops = Loops(small)
    assert report.counts == {i: len(loops.members(RULES[i][2])) for i in (1, 2, 3, 6)}


def test_facts_with_several_rows_for_a_customer_are_refused(spark, small):
    points = small_table(spark, [(1, 5), (1, 5), (2, 5), (None, 1), (None, 2)], "customer_id bigint, points int")
    rules = {1: RULES[1], 7: ("manual", True, group("all", leaf("Loyalty.points", "==", "5")))}
    e = engine(spark, small, rules=rules)
    e.registry.register("Loyalty", "points", points, lambda op, v: f"points = {int(v)}", ("points",))
    report = e.refresh_all(NOW)
    assert report.failures.keys() == {7} and "several rows" in report.failures[7]
    assert report.counts == {1: len(Loops(small).members(RULES[1][2]))}


def test_odd_documents_do_not_stop_the_others(spark, small):
    keyed = {"aggregator": "any", "conditions": {"1": leaf("Customer.gender", "==", "2"), "1--1": leaf("Order.total_orders", ">", "1000")}}
    odd = {"conditions": {"1": "x"}}
    e = engine(spark, small, rules={1: RULES[1], 8: ("manual", True, keyed), 9: ("manual", True, odd)})
    report = e.refresh_all(NOW)
    loops = Loops(small)
    assert report.failures.keys() == {9}
    assert report.counts == {1: len(loops.members(RULES[1][2])), 8: len(loops.members(group("all", leaf("Customer.gender", "==", "2"))))}


@pytest.mark.parametrize("leaves", [1, 7, 8, 70])
def test_categories_mean_the_same_however_many_leaves_there_are(spark, small, leaves):
    ids = ["1", "99999999999999999999", "1e999", "9007199254740993", "-1e400", "x", "2"]
    rules = {n: ("manual", True, group("all", leaf("Product.purchased_categories", "==", ids[n % 7] if n < 7 else str(n)))) for n in range(leaves)}
    rules |= {500: ("manual", True, group("all", leaf("Product.purchased_categories", "!=", "99999999999999999999")))}
    report = engine(spark, small, rules=rules).refresh_all(NOW)
    loops = Loops(small)
    plain = {n: len(loops.members(group("all", leaf("Product.purchased_categories", "==", str(n))))) for n in (1, 2)}
    assert not report.failures and report.counts[0] == plain[1] > 0
    assert all(report.counts[n] == 0 for n in (1, 2, 3, 4) if n < leaves)
    assert report.counts.get(6, plain[2]) == plain[2]
    assert report.counts[500] == len(loops.members(group("all", leaf("Product.purchased_categories", "!=", "-77"))))


def test_a_segment_that_matches_nobody_any_more_is_emptied(spark, small):
    e = engine(spark, small)
    e.refresh_all(NOW)
    assert any(s == 1 for s, _ in rows(e.members()))
    nobody = {1: ("manual", True, group("all", leaf("Order.total_orders", ">", "1000")))}
    assert engine(spark, small, e.store, nobody).refresh_segment(1, LATER) == 0
    members = rows(e.members())
    assert not any(s == 1 for s, _ in members) and any(s == 2 for s, _ in members)


def test_many_segments_in_several_passes(spark, small, setting):
    setting(spark__cohortry__segmentsPerPass=7)
    rules = {
        i: ("manual", True, group("all", leaf("Order.total_orders", ">=", i % 5), leaf("Customer.store_id", "==", i % 4 + 1)))
        for i in range(1, 31)
    }
    e, loops = engine(spark, small, rules=rules), Loops(small)
    found = {(r.segment_id, r.customer_id) for r in e.matches(NOW).collect()}
    assert found == {(i, c) for i, (_, _, rule) in rules.items() for c in loops.members(rule)}


def test_touched_customers_end_up_as_a_full_refresh_leaves_them(spark, small):
    half = random_shop(11)
    half.rows["sales_order"] = half.rows["sales_order"][::2]
    half.rows["quote"] = half.rows["quote"][::2]
    store = engine(spark, half).store
    engine(spark, half, store).refresh_all(NOW)
    before = rows(engine(spark, half, store).members())

    e = engine(spark, small, store)
    everyone = small_table(spark, [(i,) for i in [*range(0, 41), 1, 1, None]], "customer_id bigint")
    e.refresh_customers(everyone, LATER, batch="b-1")
    full = engine(spark, small)
    full.refresh_all(LATER)
    realtime = {p for p in rows(full.members()) if p[0] in (2, 3, 6)}
    after = rows(e.members())
    assert {p for p in after if p[0] in (2, 3, 6)} == realtime
    assert {p for p in after if p[0] == 1} == {p for p in before if p[0] == 1}
    assert all(when == before.get(pair, LATER) for pair, when in after.items())
    # replaying the batch does nothing
    assert e.refresh_customers(everyone, LATER + dt.timedelta(days=1), batch="b-1") is None
    assert rows(e.members()) == after


def test_a_scheduled_run(spark, small):
    rules = {
        1: ("cron", True, group("all", leaf("Order.total_orders", ">=", "2"))),
        2: ("manual", True, group("all", leaf("Customer.gender", "==", "1"))),
        3: ("realtime", True, group("all", leaf("Customer.gender", "==", "2"))),
        4: ("cron", True, group("all", leaf("Customer.gender", "==", "3"))),
    }
    e = engine(spark, small, rules=rules)
    e.definitions = e.definitions.selectExpr(
        "* EXCEPT (cron_expression)", "element_at(map(1, '0 2 * * *', 4, '0 3 * * *'), segment_id) AS cron_expression"
    )
    due = [("0 2 * * *", NOW), ("0 3 * * *", NOW + dt.timedelta(hours=1))]
    ticks = small_table(spark, due, "cron_expression string, due_at timestamp_ntz")
    assert e.refresh_due(ticks, NOW).counts.keys() == {1, 3}
    assert e.refresh_due(ticks, NOW + dt.timedelta(hours=1)).counts.keys() == {3, 4}
    growth = [(r.segment_id, r.growth) for r in e.store.history().orderBy("segment_id", "refreshed_at").collect()]
    assert growth == [(1, None), (3, None), (3, 0), (4, None)]


def test_delta_is_additions_and_removals(spark):
    old = small_table(spark, [(1, 1, NOW), (1, 2, NOW), (2, 1, NOW)], schemas.MEMBERSHIP)
    new = small_table(spark, [(1, 2), (1, 3), (3, 1)], "segment_id int, customer_id bigint")
    add = {tuple(r) for r in membership.to_add(new, old).collect()}
    gone = {tuple(r) for r in membership.to_remove(new, old).collect()}
    assert (add, gone) == ({(1, 3), (3, 1)}, {(1, 1), (2, 1)})
    both = {tuple(r) for r in membership.delta(new, old).collect()}
    assert both == {(*p, True) for p in add} | {(*p, False) for p in gone}
    assert {tuple(r) for r in membership.delta(new, old, add_only=True).collect()} == {(*p, True) for p in add}


def test_assign_and_unassign(spark, small):
    e = engine(spark, small)
    e.refresh_all(NOW)
    before = rows(e.members())
    pairs = small_table(spark, [(6, 5), (6, 5), (2, 1000), next(iter(before))], "segment_id int, customer_id bigint")
    assert e.assign(pairs, LATER) == 3
    expected = {**before, **{tuple(r): LATER for r in pairs.collect()}}
    assert rows(e.members()) == expected
    gone = small_table(spark, [(6, 5), (6, 6), (77, 1)], "segment_id int, customer_id bigint")
    assert e.unassign(gone, LATER) == 1 and e.unassign(gone, LATER) == 0
    del expected[6, 5]
    assert rows(e.members()) == expected
    # folding the changes in changes nothing but the way it is stored
    state = {r.segment_id: r.last_refreshed for r in e.store.status().collect()}
    assert e.store.fold_changes().keys() == {2, 6, next(iter(before))[0]}
    assert rows(e.members()) == expected and e.store.fold_changes() == {}
    assert {r.segment_id: r.last_refreshed for r in e.store.status().collect()} == state
    # another session on the same folder sees the same
    assert rows(MembershipStore(spark, e.store.root).members()) == expected
    # a refresh replaces what was done by hand, in its segment only
    e.refresh_segment(6, LATER)
    e.assign(pairs.where("segment_id = 6"), LATER)
    e.refresh_segment(2, LATER)
    assert (6, 5) in rows(e.members()) and (2, 1000) not in rows(e.members())


def test_log_and_status(spark, small):
    e = engine(spark, small)
    report = e.refresh_all(NOW)
    e.assign(small_table(spark, [(6, 5)], "segment_id int, customer_id bigint"), LATER)
    log = {(r.segment_id, r.action, r.details) for r in e.store.log().collect()}
    assert (1, "refresh_before", None) in log and (1, "refresh_after", f"assigned_count={report.counts[1]}") in log
    assert any(s == 5 and action == "refresh_failed" for s, action, _ in log)
    assert (6, "assigned", "customer_id=5") in log
    state = {r.segment_id: (r.customer_count, r.last_refreshed) for r in e.refreshed_segments().collect()}
    assert state[1] == (report.counts[1], NOW) and state[4] == (0, None) == state[5]


def test_match_check(spark, small):
    e, loops = engine(spark, small), Loops(small)
    pairs = [(c, s) for c in (0, 1, 2, 3, 999) for s in (1, 2, 3, 4, 5, 77)]
    table = small_table(spark, pairs + pairs[:3], "customer_id bigint, segment_id int")
    expected = {(s, c): s in (1, 2, 3) and c in loops.members(RULES[s][2]) for c, s in pairs}
    got = e.match_check(table, NOW).collect()
    assert {(r.segment_id, r.customer_id): r.matches for r in got} == expected and len(got) == len(expected)


def test_validate_batch(spark, small):
    e, loops = engine(spark, small), Loops(small)
    ids = small_table(spark, [(i,) for i in (0, 1, 2, 3, 4, 5, 5, 999)], "customer_id bigint")

    def found(*check):
        return {r.customer_id for r in e.validate_batch(ids, *check, NOW).collect()}

    people = {1, 2, 3, 4, 5}
    assert found("gender", "==", "2", "customer") == people & loops.members(group("all", leaf("Customer.gender", "==", "2")))
    few = people & loops.members(group("all", leaf("Order.total_orders", "<", "3"), leaf("Order.total_orders", ">", "0")))
    assert found("total_orders", "<", "3", "order") == few
    assert found("total_orders", "==", "0", "order") == set()
    assert found("total_orders", "==", "0", "shelf") == set() == found("nothing", "==", "0", "customer")
