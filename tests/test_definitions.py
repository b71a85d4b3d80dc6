from __future__ import annotations

import datetime as dt

import pytest

from cohortry.plans.refresh import SegmentEngine
from cohortry.plans.rules import group, leaf
from cohortry.session import small_table, work_dir
from cohortry.sources.definition_store import DefinitionStore
from cohortry.sources.membership_store import MembershipStore
from cohortry.suite.definitions import rule_text

from .small_shop import NOW, Loops, random_shop

LATER = NOW + dt.timedelta(days=1)
COLUMNS = "segment_id int, name string, conditions_serialized string, refresh_mode string"
WOMEN = group("all", leaf("Customer.gender", "==", "2"))
BUYERS = group("all", leaf("Order.total_orders", ">=", "2"))


@pytest.fixture
def engine(spark):
    root = work_dir(spark, "engine")
    return SegmentEngine(random_shop(41).shop(spark), DefinitionStore(spark, root), MembershipStore(spark, root))


def save(engine, now, *rows):
    saved = engine.save_segments(small_table(engine.spark, rows, COLUMNS), now)
    return sorted(r.segment_id for r in saved.collect())


def test_life_of_segments(spark, engine):
    loops = Loops(random_shop(41))
    assert engine.segments.isEmpty()
    assert save(engine, NOW, (None, "A", rule_text(WOMEN), "realtime"), (None, "B", rule_text(BUYERS), None)) == [1, 2]
    assert save(engine, NOW, (7, "C", rule_text({}), None), (None, "D", None, None)) == [3, 7]
    # numbers of new segments never collide with given ones saved earlier
    assert save(engine, NOW, (None, "E", None, None)) == [8]
    engine.refresh_all(NOW)
    counts = {r.segment_id: r.customer_count for r in engine.refreshed_segments().collect()}
    assert counts == {1: len(loops.members(WOMEN)), 2: len(loops.members(BUYERS)), 3: 0, 7: 40, 8: 0}

    assert save(engine, LATER, (2, "B2", None, "cron")) == [2]
    row = engine.segments.where("segment_id = 2").first()
    assert (row.name, row.refresh_mode, row.conditions_serialized) == ("B2", "cron", rule_text(BUYERS))
    assert (row.created_at, row.updated_at) == (NOW, LATER)

    assert engine.delete_segments(small_table(spark, [(1,), (99,)], "segment_id int")) == [1]
    assert sorted(r.segment_id for r in engine.segments.collect()) == [2, 3, 7, 8]
    assert {r.segment_id for r in engine.members().collect()} == {2, 7}
    assert {r.segment_id for r in engine.activity_log().collect()} == {2, 3, 7, 8}
    assert {r.name for r in engine.customer_segments().collect()} == {"B2", "C"}
    assert engine.customers(7, page=2, size=15).total == 40
    # the number of a deleted segment is not given again
    assert save(engine, LATER, (None, "F", None, None)) == [9]
    assert engine.delete_segments(engine.segments) == [2, 3, 7, 8, 9]
    assert engine.segments.isEmpty() and engine.members().isEmpty()


def test_large_saves_and_deletes_stay_in_tasks(spark, monkeypatch):
    """New rows of several partitions get successive numbers without one task; deleting gives a table."""
    store = DefinitionStore(spark, work_dir(spark, "definitions"))
    changes = spark.range(0, 200, 1, 7).selectExpr("CAST(NULL AS INT) AS segment_id", "concat('s', id) AS name")
    monkeypatch.setattr(type(changes), "coalesce", lambda *_: pytest.fail("one task"))
    saved = store.save(changes.where("name NOT LIKE '%3'"), NOW)
    found = sorted((r.segment_id, int(r.name[1:])) for r in saved.collect())
    assert [i for i, _ in found] == list(range(1, 181)) and [n for _, n in found] == [n for n in range(200) if n % 10 != 3]
    ids = store.segments().where("segment_id > 100")
    gone = store.delete(ids)
    assert gone.columns == ["segment_id"] and sorted(r.segment_id for r in gone.collect()) == list(range(101, 181))
    assert store.segments().count() == 100


def test_two_stores_on_one_root(spark, engine):
    save(engine, NOW, (None, "A", rule_text(WOMEN), None))
    again = SegmentEngine(
        engine.shop, DefinitionStore(spark, engine.store.root), MembershipStore(spark, engine.store.root)
    )
    assert again.refresh_segment(1, NOW) == engine.members().count() > 0


def test_writers_of_one_application_take_turns(spark, engine):
    from concurrent.futures import ThreadPoolExecutor

    def write(n):
        store = MembershipStore(spark, engine.store.root)
        delta = small_table(spark, [(1, n, True), (2, n, True)], "segment_id int, customer_id bigint, assigned boolean")
        return store.change(delta, NOW, f"batch-{n % 8}")

    with ThreadPoolExecutor(4) as pool:
        seqs = list(pool.map(write, range(1, 17)))
    assert sorted(s for s in seqs if s) == list(range(1, 9))
    found = [(r.segment_id, r.customer_id) for r in engine.members().collect()]
    assert len(found) == len(set(found)) == 16
