"""Streams leave what a batch run leaves, in one or many micro-batches, replayed or not."""

from __future__ import annotations

import datetime as dt

import pytest

from cohortry.session import small_table, work_dir
from cohortry.streaming import changes

from .small_shop import NOW, Loops, random_shop
from .test_refresh import RULES, engine, rows

LATER = NOW + dt.timedelta(days=1)


@pytest.fixture(scope="module")
def world(spark):
    """Memberships of an earlier day, and today's facts."""
    today, earlier = random_shop(21), random_shop(21)
    earlier.rows["sales_order"] = earlier.rows["sales_order"][::3]
    earlier.rows["quote"] = earlier.rows["quote"][::2]
    return today, earlier


def start(spark, world):
    today, earlier = world
    before = engine(spark, earlier)
    before.refresh_all(NOW)
    return engine(spark, today, before.store), rows(before.members())


def stream(spark, table, files=1):
    path = work_dir(spark, "events")
    table.repartition(files).write.parquet(path)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)


def expected(before, small, touched, add_only=False):
    after, loops = dict(before), Loops(small)
    for sid in (2, 3, 6):
        match = loops.members(RULES[sid][2])
        for c in touched:
            if c in match:
                after.setdefault((sid, c), LATER)
            elif not add_only:
                after.pop((sid, c), None)
    return after


@pytest.mark.parametrize("files", [1, 3])
def test_saved_customers(spark, world, files):
    e, before = start(spark, world)
    ids = [1, 1, 2, 3, 5, 8, 13, 21, 34, 0, None, 999]
    events = stream(spark, small_table(spark, [(i,) for i in ids], "customer_id bigint"), files)
    checkpoint = work_dir(spark, "checkpoint")
    changes.drain(changes.customer_saved(events, lambda: e, lambda: LATER, checkpoint))
    after = rows(e.members())
    assert after == expected(before, world[0], {1, 2, 3, 5, 8, 13, 21, 34})
    assert after != before
    # nothing new: a restart from the checkpoint changes nothing
    changes.drain(changes.customer_saved(events, lambda: e, lambda: LATER + dt.timedelta(days=1), checkpoint))
    assert rows(e.members()) == after
    # after a lost checkpoint everything is evaluated again, with the same outcome
    commits = e.store.commits().count()
    changes.drain(changes.customer_saved(events, lambda: e, lambda: LATER, work_dir(spark, "checkpoint")))
    assert rows(e.members()) == after and e.store.commits().count() == commits + files


def test_streams_do_not_take_each_other_for_replays(spark, world):
    e, before = start(spark, world)
    for begin, customers in ((changes.order_placed, [1, 2, None]), (changes.cart_changed, [3]), (changes.order_placed, [5])):
        events = stream(spark, small_table(spark, [(i,) for i in customers], "customer_id bigint"))
        changes.drain(begin(events, lambda: e, lambda: LATER, work_dir(spark, "checkpoint")))
    assert rows(e.members()) == expected(before, world[0], {1, 2, 3, 5})


def test_a_batch_replayed_after_a_failure_takes_effect_once(spark, world):
    e, before = start(spark, world)
    events = stream(spark, small_table(spark, [(i,) for i in (1, 2, 3)], "customer_id bigint"))
    checkpoint, calls = work_dir(spark, "checkpoint"), []

    class Lost(Exception):
        pass

    def clock():
        calls.append(1)
        return LATER

    def failing():
        """Fails after the write of the first attempt."""
        refresh = e.refresh_customers

        class Engine:
            def refresh_customers(self, *args, **kwargs):
                refresh(*args, **kwargs)
                if len(calls) == 1:
                    raise Lost

        return Engine()

    with pytest.raises(Exception, match="Lost"):
        changes.drain(changes.customer_saved(events, failing, clock, checkpoint))
    after, commits = rows(e.members()), e.store.commits().count()
    changes.drain(changes.customer_saved(events, failing, clock, checkpoint))
    assert len(calls) == 2 and e.store.commits().count() == commits
    assert rows(e.members()) == after == expected(before, world[0], {1, 2, 3})


def test_registered_customers_only_join(spark, world):
    e, before = start(spark, world)
    events = stream(spark, small_table(spark, [(i,) for i in range(1, 41)], "customer_id bigint"), 2)
    changes.drain(changes.customer_registered(events, lambda: e, lambda: LATER, work_dir(spark, "checkpoint")))
    after = rows(e.members())
    assert after == expected(before, world[0], range(1, 41), add_only=True)
    assert before.keys() < after.keys()


def test_change_log(spark, world):
    e, before = start(spark, world)
    entries = [("segment", 1), ("segment", 1), ("segment", 3), ("segment", 4), ("segment", 77), ("customer", 1), ("customer", 2)]
    events = stream(spark, small_table(spark, entries, "entity string, row_id bigint"))
    changes.drain(changes.change_log(events, lambda: e, lambda: LATER, work_dir(spark, "checkpoint")))
    loops = Loops(world[0])
    after = expected(before, world[0], {1, 2})
    after = {p: t for p, t in after.items() if p[0] not in (1, 3)}
    after |= {(s, c): LATER for s in (1, 3) for c in loops.members(RULES[s][2])}
    assert rows(e.members()) == after


def test_logins(spark, world, spread):
    e, before = start(spark, world)
    events = [(n, c) for n, c in enumerate([1] * 9 + [2, 3, 999, None])]
    table = small_table(spark, events, "event_id bigint, customer_id bigint")
    sink = work_dir(spark, "sink")
    changes.drain(changes.login_lookup(stream(spark, table, 2), e.members, sink, work_dir(spark, "checkpoint")))
    found = spark.read.schema("event_id bigint, customer_id bigint, segment_count bigint").parquet(f"{sink}/batch=*")
    counts = {c: sum(c == m for _, m in before) for c in (1, 2, 3, 999, None)}
    assert sorted(tuple(r) for r in found.collect()) == [(n, c, counts[c]) for n, c in events]
