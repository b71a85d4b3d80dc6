"""Facts that are added batch by batch lead where a full evaluation leads."""

from __future__ import annotations

import datetime as dt
import random
import re

from cohortry.plans import refresh
from cohortry.plans.rules import group, leaf
from cohortry.session import small_table, work_dir
from cohortry.sources import fact_store
from cohortry.sources.layout import cluster_by_customer
from cohortry.sources.membership_store import MembershipStore

from .small_shop import NOW, SCHEMAS, Loops, random_shop
from .test_layout import plan
from .test_refresh import SegmentEngine, rows, segments

RULES = {
    1: ("realtime", True, group("all", leaf("Order.total_orders", "<", "3"))),
    2: ("realtime", True, group("all", leaf("Order.average_order_value", "<", "150"), leaf("Order.first_order_date", ">", "2023-02-01"))),
    3: ("realtime", True, group("any", leaf("Order.total_revenue", ">", "400"), leaf("Order.last_order_date", "<", "2023-09-01"))),
    4: ("realtime", True, group("all", leaf("Order.used_coupon", "==", "SAVE1"), leaf("Product.purchased_products", "{}", "sku-1"))),
    5: ("realtime", True, group("any", leaf("Cart.cart_subtotal", ">", "100"), leaf("Cart.cart_products", "==", "sku-2"))),
    6: ("realtime", True, group("all", leaf("Cart.cart_last_activity", "<", "200"), leaf("Product.purchased_categories", "==", "2"))),
    7: ("realtime", True, group("all", leaf("Product.wishlist_items_count", ">=", "1"), leaf("Order.total_items", ">=", "100"))),
}


def expected(small, now):
    loops = Loops(small, now)
    return {(i, c) for i, (_, _, rule) in RULES.items() for c in loops.members(rule)}


def by_segment(pairs):
    return sorted(pairs)


def test_many_batches_with_cancellations_and_a_replay(spark, monkeypatch):
    monkeypatch.setattr(fact_store, "MOST_OPEN", 4)
    today = random_shop(61)
    rnd = random.Random(61)
    orders = list(today.rows["sales_order"])
    carts = list(today.rows["quote"])
    rnd.shuffle(orders)
    early, later = random_shop(61), orders[60:]
    early.rows["sales_order"], early.rows["quote"] = orders[:60], carts[:40]
    store = MembershipStore(spark, work_dir(spark, "test"))
    SegmentEngine(early.shop(spark), segments(spark, RULES), store).refresh_all(NOW)
    e = SegmentEngine(early.shop(spark), segments(spark, RULES), store, streamed=("orders", "carts"))
    e.build_facts()
    now = NOW
    for n in range(6):
        now += dt.timedelta(hours=1)
        new = later[n::6]
        known = early.rows["sales_order"]
        # some orders that counted are cancelled
        gone = [o for o in rnd.sample(known, 3) if o[2] not in ("canceled", "closed")]
        early.rows["sales_order"] = [o if o not in gone else (*o[:2], "canceled", *o[3:]) for o in known] + new
        cancelled = [(*o[:2], "canceled", *o[3:]) for o in gone]
        cart = carts[40 + n :: 6]
        early.rows["quote"] = early.rows["quote"] + cart
        e.shop = early.shop(spark)
        batch = small_table(spark, new + cancelled + new[:2], SCHEMAS["sales_order"])
        e.place_orders(batch, now, batch=f"orders {n}")
        if n % 2:
            assert e.place_orders(batch, now, batch=f"orders {n}") is None
        e.change_carts(small_table(spark, cart, SCHEMAS["quote"]), now, batch=f"carts {n}")
    assert {p for p in rows(e.members())} == expected(early, now)
    facts = e._facts(refresh.active_rules(e.segments, e.registry, "realtime"))
    assert len(facts._open()) <= 6
    # the kept facts are those of a full computation
    again = facts.rows().collect()
    facts.build(e.shop)
    key = lambda r: (r.customer_id is None, r.customer_id or 0)
    fresh = {r.customer_id: r for r in facts.rows().collect()}
    for row in sorted(again, key=key):
        if row.customer_id in fresh:
            assert row["__orders"] == fresh[row.customer_id]["__orders"] and row["__revenue"] == fresh[row.customer_id]["__revenue"]


def test_a_batch_reads_new_orders_and_touched_buckets_only(spark, monkeypatch):
    small = random_shop(62)
    shop = cluster_by_customer(small.shop(spark), work_dir(spark, "layout"), buckets=16)
    monkeypatch.setattr(fact_store, "BUCKET_CUSTOMERS", 3)
    kept = {n: RULES[n] for n in (1, 2, 3)}
    store = MembershipStore(spark, work_dir(spark, "test"))
    e = SegmentEngine(shop, segments(spark, kept), store, streamed=("orders",))
    e.refresh_all(NOW)
    e.build_facts()
    new = (9001, 7, "complete", "pending", 10, 1, NOW, None, "card", "flatrate", None)
    plans = []
    real = refresh.written
    monkeypatch.setattr(refresh, "written", lambda table, what: plans.append((what, plan(table))) or real(table, what))
    decided = SegmentEngine._decided
    monkeypatch.setattr(SegmentEngine, "_decided", lambda self, features, rules, now: plans.append(("features", plan(features))) or decided(self, features, rules, now))
    e.place_orders(small_table(spark, [new], SCHEMAS["sales_order"]), NOW + dt.timedelta(hours=1), batch="one")
    (features,) = [text for what, text in plans if what == "features"]
    reads = re.findall(r"\n\(\d+\) Scan parquet.*?\n\n", features, re.S)
    assert not any("/sales_order" in read or "/quote" in read for read in reads)
    assert all(re.search(r"PartitionFilters: \[.*customer_bucket", read) for read in reads if "/facts/" in read or "/customer" in read)
    assert any("/facts/" in read for read in reads)


def test_without_kept_facts_a_batch_is_evaluated_from_the_shop(spark):
    small = random_shop(63)
    store = MembershipStore(spark, work_dir(spark, "test"))
    e = SegmentEngine(small.shop(spark), segments(spark, RULES), store, streamed=("orders", "carts"))
    e.place_orders(small_table(spark, small.rows["sales_order"], SCHEMAS["sales_order"]), NOW)
    owners = {o[1] for o in small.rows["sales_order"]}
    assert set(rows(e.members())) == {(s, c) for s, c in expected(small, NOW) if c in owners}
