"""Rules of a large catalogue, compiled in tasks, give what rules on the driver give."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from cohortry import schemas
from cohortry.operators.conditions import ConditionRegistry
from cohortry.plans import evaluate
from cohortry.plans.refresh import SegmentEngine
from cohortry.plans.rules import group, leaf
from cohortry.session import small_table, work_dir
from cohortry.sources import membership_store
from cohortry.sources.membership_store import MembershipStore

from .small_shop import NOW, Loops, random_shop
from .test_rule_index import VALUED, random_rule

LATER = NOW + dt.timedelta(days=1)


def valued_rule(r: random.Random) -> dict:
    clauses = [group("any", *[r.choice(VALUED)(r) for _ in range(r.randint(1, 3))]) for _ in range(r.randint(1, 3))]
    return group("all", *clauses)


def definitions(spark, texts: dict):
    rows = [(n, f"S{n}", None, True, text, "manual", None, 0, None, NOW, NOW) for n, text in texts.items()]
    return small_table(spark, rows, schemas.SEGMENTS)


@pytest.fixture
def many(spark, setting, monkeypatch):
    setting(spark__cohortry__driverRules=3)
    monkeypatch.setattr(membership_store, "MOST_STATES", 3)
    rnd, small = random.Random(81), random_shop(81)
    trees = {n: valued_rule(rnd) for n in range(1, 31)} | {n: random_rule(rnd) for n in range(31, 36)} | {36: group("all")}
    texts = {n: json.dumps(tree) for n, tree in trees.items()} | {37: None, 38: json.dumps(group("all", leaf("Weather.rain", "==", "1")))}
    loops = Loops(small)
    expected = {(n, c) for n, tree in trees.items() for c in loops.members(tree)}
    return small, definitions(spark, texts), expected


def pairs(rows) -> list[tuple]:
    return sorted((r.segment_id, r.customer_id) for r in rows.collect())


def test_rules_that_ask_for_values_stay_off_the_driver(spark, many):
    small, segments, expected = many
    seen = evaluate.compile_segments(segments, ConditionRegistry(), listed=True)
    assert set(seen.failures) == {38} and {36, 37} <= set(seen.rules) and not set(seen.rules) & set(range(1, 31))
    engine = SegmentEngine(small.shop(spark), segments, MembershipStore(spark, work_dir(spark, "store")))
    assert pairs(engine.matches(NOW)) == sorted(expected)


def test_refresh_and_changes(spark, many):
    small, segments, expected = many
    engine = SegmentEngine(small.shop(spark), segments, MembershipStore(spark, work_dir(spark, "store")))
    report = engine.refresh_all(NOW)
    assert report.total == len(expected) and set(report.failures) == {38}
    assert pairs(engine.members()) == sorted(expected)
    sizes = {r.segment_id: r.customer_count for r in engine.store.status().collect()}
    assert sizes == {n: sum(s == n for s, _ in expected) for n in range(1, 38)}
    gone, new = sorted(expected)[0], (2, 4711)
    engine.unassign(small_table(spark, [gone], "segment_id int, customer_id bigint"), LATER)
    engine.assign(small_table(spark, [new], "segment_id int, customer_id bigint"), LATER)
    held = {(r.segment_id, r.customer_id): r.assigned_at for r in engine.members().collect()}
    assert held == dict.fromkeys(expected - {gone}, NOW) | {new: LATER}
    engine.refresh_all(LATER)
    assert {(r.segment_id, r.customer_id): r.assigned_at for r in engine.members().collect()} == dict.fromkeys(expected, LATER)
    started = engine.store.log().where("action = 'refresh_before'").groupBy("segment_id").count().collect()
    assert {r.segment_id: r["count"] for r in started} == dict.fromkeys(range(1, 39), 2)


def test_facts_that_cannot_be_read_stop_only_their_rules(spark, many):
    small, segments, expected = many
    shop = small.shop(spark)
    broken = shop.product_view.withColumn("customer_id", F.expr("CAST(raise_error('no disk') AS BIGINT)"))
    engine = SegmentEngine(shop.with_tables(product_view=broken), segments, MembershipStore(spark, work_dir(spark, "store")))
    report = engine.refresh_all(NOW)
    failed = {r.segment_id for r in report.listed.where("customer_count IS NULL").collect()} | set(report.failures)
    views = {r.segment_id for r in segments.where("conditions_serialized LIKE '%viewed_categories%'").collect()}
    assert failed == views | {38} and views
    assert pairs(engine.members()) == sorted((s, c) for s, c in expected if s not in views)
