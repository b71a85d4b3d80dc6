"""The registered queries: every operator once, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.compare import compare_cart_sku, compare_category, compare_number, compare_sku_list
from ..functions.values import all_of
from ..operators import features as feats
from ..operators import lifecycle, lookup, membership
from ..operators.conditions import ConditionRegistry
from ..plans.evaluate import compile_segments, matches
from ..plans.refresh import SAVED, SegmentEngine, log_rows
from ..plans.rules import group, leaf
from ..session import small_table, work_dir, written
from ..sources import eav, shop as scans
from ..sources.definition_store import DefinitionStore
from ..sources.driver_tables import K as _BIG_K
from ..sources.driver_tables import quotes, read, sales_orders, shop
from ..sources.membership_store import ASSIGNED, MembershipStore
from ..sources.shop import Shop
from ..streaming import changes
from . import definitions as defs
from .cases import CASES, RULES
from .definitions import NOW

Query = Callable[[SparkSession, str], DataFrame]
K = f"CAST({_BIG_K} AS INT)"


# -- building blocks ------------------------------------------------------------


def _store(spark: SparkSession) -> MembershipStore:
    return MembershipStore(spark, work_dir(spark, "store"))


def _engine(spark: SparkSession, folder: str, *ids: int, registry: ConditionRegistry | None = None) -> SegmentEngine:
    return SegmentEngine(shop(spark, folder), defs.segments(spark, *ids), _store(spark), registry)


def _earlier(spark: SparkSession, folder: str) -> tuple[SegmentEngine, SegmentEngine]:
    """An engine whose store holds the memberships of an earlier day, and today's."""
    store = _store(spark)
    before = SegmentEngine(shop(spark, folder).ordered_before(defs.BEFORE), defs.segments(spark), store)
    before.refresh_all(defs.EARLIER)
    return before, SegmentEngine(shop(spark, folder), defs.segments(spark), store)


def _rules(*rules: object) -> Query:
    """Evaluate rules, numbered from 1, for the whole population."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        registry = ConditionRegistry()
        rows = [(number, defs.rule_text(rule)) for number, rule in enumerate(rules, 1)]
        documents = small_table(spark, rows, "segment_id int, conditions_serialized string")
        return matches(shop(spark, folder), compile_segments(documents, registry), NOW, registry)

    return query


def _catalog(spark: SparkSession, folder: str) -> DataFrame:
    return defs.catalog(spark, read(spark, folder, "part"))


def _buyers(spark: SparkSession, folder: str) -> DataFrame:
    """Memberships of the product catalogue: who bought what, assigned at the last order."""
    bought = feats.order_products(shop(spark, folder))
    segment = F.expr("CAST(product_id + 1000 AS INT) AS segment_id")
    return bought.groupBy(segment, "customer_id").agg(F.expr("max(created_at) AS assigned_at"))


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "events")


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """(customer_id, segment_id) pairs of the product catalogue out of the events."""
    return _events(spark, folder).selectExpr("user_id AS customer_id", f"{K} + 1000 AS segment_id")


# -- sources and sinks ----------------------------------------------------------


def src_population(spark: SparkSession, folder: str) -> DataFrame:
    return scans.population(shop(spark, folder).customer).select("customer_id", "email", "created_at")


def src_eav_pivot(spark: SparkSession, folder: str) -> DataFrame:
    kinds = {"firstname": "string", "lastname": "string", "dob": "date", "gender": "int", "taxvat": "string"}
    people = scans.population(shop(spark, folder).customer)
    text = people.selectExpr("customer_id AS entity_id", *[f"CAST({code} AS STRING) AS `{n}`" for n, code in enumerate(kinds, 1)])
    values = text.unpivot("entity_id", [str(n) for n in range(1, 6)], "attribute_id", "value").where("value IS NOT NULL")
    values = values.selectExpr("entity_id", "CAST(attribute_id AS INT) AS attribute_id", "value")
    codes = small_table(spark, enumerate(kinds, 1), "attribute_id int, attribute_code string")
    return eav.widen(values, codes, kinds)


def src_valid_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = scans.valid_orders(shop(spark, folder).sales_order)
    return orders.withColumns({c: F.col(c).cast("double") for c in ("base_grand_total", "total_qty_ordered")})


def src_active_carts(spark: SparkSession, folder: str) -> DataFrame:
    carts = scans.active_carts(shop(spark, folder).quote)
    return carts.withColumn("subtotal", F.col("subtotal").cast("double"))


def src_cart_items(spark: SparkSession, folder: str) -> DataFrame:
    return scans.top_level_items(shop(spark, folder).quote_item).select("quote_id", "sku")


def src_active_segments(spark: SparkSession, folder: str) -> DataFrame:
    return scans.active_segments(_catalog(spark, folder), "realtime").select("segment_id", "name", "refresh_mode")


def _exported(spark: SparkSession, folder: str, kind: str) -> tuple[SegmentEngine, str]:
    engine = _engine(spark, folder, 6)
    engine.refresh_segment(6, NOW)
    path = work_dir(spark, "export")
    engine.export(6, path, kind)
    return engine, path


def export_csv(spark: SparkSession, folder: str) -> DataFrame:
    _, path = _exported(spark, folder, "csv")
    columns = ("customer_id bigint", "email string", "first_name string", "last_name string", "created_at string")
    return spark.read.csv(path, schema=", ".join(columns), header=True, escape='"', enforceSchema=True)


def export_xml(spark: SparkSession, folder: str) -> DataFrame:
    _, path = _exported(spark, folder, "xml")
    columns = "customer_id bigint, email string, first_name string, last_name string, created_at string"
    return spark.read.schema(columns).xml(path, rowTag="customer")


# -- features and aggregates ----------------------------------------------------


def feature_table(spark: SparkSession, folder: str) -> DataFrame:
    registry = ConditionRegistry()
    customer = [feats.Feature(name, "customer") for name in registry.attributes("Customer")]
    wanted = [*customer, *feats.ORDER_FEATURES.values(), *feats.CART_FEATURES.values(), feats.WISHLIST_COUNT]
    return feats.feature_table(shop(spark, folder), wanted, NOW)


def agg_order_summary(spark: SparkSession, folder: str) -> DataFrame:
    return feats.order_summary(shop(spark, folder))


def agg_having(spark: SparkSession, folder: str) -> DataFrame:
    summary = feats.order_summary(shop(spark, folder))
    having = [compare_number("total_orders", ">=", "5"), compare_number("total_revenue", "<", "1500000")]
    return summary.where(all_of(having)).select("customer_id", "total_orders", "total_revenue")


def agg_purchased_items(spark: SparkSession, folder: str) -> DataFrame:
    test = all_of(["product_type = 'simple'", compare_sku_list("sku", "{}", "Brand#1")])
    return feats.purchased_item_counts(shop(spark, folder), test)


def agg_distinct_products(spark: SparkSession, folder: str) -> DataFrame:
    return feats.distinct_products(shop(spark, folder), compare_category("category_id", "==", "10,20,112"))


def agg_segment_counts(spark: SparkSession, folder: str) -> DataFrame:
    return membership.segment_counts(_buyers(spark, folder))


def cart_latest(spark: SparkSession, folder: str) -> DataFrame:
    carts = scans.latest_carts(shop(spark, folder).quote)
    return carts.withColumn("subtotal", F.col("subtotal").cast("double"))


def cart_matching_items(spark: SparkSession, folder: str) -> DataFrame:
    """How many top-level items of the latest cart a SKU test hits."""
    facts = shop(spark, folder)
    hits = scans.top_level_items(facts.quote_item).where(compare_cart_sku("sku", "{}", "brand#1"))
    per_cart = hits.groupBy("quote_id").agg(F.expr("count(*) AS items"))
    return scans.latest_carts(facts.quote).join(per_cart, "quote_id").select("customer_id", "quote_id", "items")


# -- refresh --------------------------------------------------------------------


def refresh_segment(spark: SparkSession, folder: str) -> DataFrame:
    engine = _engine(spark, folder, 1)
    engine.refresh_segment(1, NOW)
    return engine.members()


def refresh_all(spark: SparkSession, folder: str) -> DataFrame:
    engine = _engine(spark, folder)
    engine.refresh_all(NOW)
    return engine.members()


def mass_refresh(spark: SparkSession, folder: str) -> DataFrame:
    engine = _engine(spark, folder)
    report = engine.mass_refresh([4, 5, 9, 16, 18, 99], NOW)
    return engine.store.status().withColumn("total", F.lit(report.total).cast("bigint"))


def refresh_log(spark: SparkSession, folder: str) -> DataFrame:
    engine = _engine(spark, folder, 1, 4, 17, 18)
    engine.store.append_log(log_rows(engine.segments, SAVED, defs.EARLIER))
    engine.refresh_all(NOW)
    engine.assign(_pairs(spark, folder).withColumn("segment_id", F.lit(18)).where("customer_id > 0"), NOW)
    return engine.store.log()


def refresh_status(spark: SparkSession, folder: str) -> DataFrame:
    engine = _engine(spark, folder)
    engine.refresh_all(NOW)
    return engine.refreshed_segments().select("segment_id", "is_active", "customer_count", "last_refreshed")


def stale_after_refresh(spark: SparkSession, folder: str) -> DataFrame:
    """What is stale when all was refreshed earlier and some just now."""
    engine = _engine(spark, folder)
    engine.refresh_all(defs.EARLIER)
    engine.mass_refresh(defs.JUST_REFRESHED, NOW)
    return engine.stale(NOW).select("segment_id", "refresh_mode", "last_refreshed")


def list_after_refresh(spark: SparkSession, folder: str) -> DataFrame:
    engine = _engine(spark, folder)
    engine.refresh_all(NOW)
    found = engine.list_segments(lifecycle.SegmentFilter(is_active=True), "customer_count", size=10, descending=True)
    rows = found.rows.select("segment_id", "status_label", "customer_count", "last_refreshed")
    return rows.withColumn("total", F.lit(found.total).cast("bigint"))


def forget_stored(spark: SparkSession, folder: str) -> DataFrame:
    """Stored memberships left after customers were deleted."""
    engine = _engine(spark, folder)
    engine.refresh_all(NOW)
    engine.forget_customers(scans.population(engine.shop.customer).where("group_id = 3"), NOW)
    return engine.members()


def segment_growth(spark: SparkSession, folder: str) -> DataFrame:
    _, engine = _earlier(spark, folder)
    engine.refresh_all(NOW)
    return engine.store.history()


def match_check(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _events(spark, folder).selectExpr("user_id AS customer_id", f"{K} % 22 + 1 AS segment_id")
    return _engine(spark, folder).match_check(pairs, NOW)


def validate_batch(spark: SparkSession, folder: str) -> DataFrame:
    engine = _engine(spark, folder)
    users = _events(spark, folder).select(F.col("user_id").alias("customer_id"))
    checks = [
        ("email", "{}", "@household", "customer"),
        ("total_orders", "<", "8", "order"),
        ("total_orders", "==", "0", "order"),
        ("last_order_date", ">", "2001-01-01", "order"),
        ("total_orders", ">=", "1", "warehouse"),
    ]
    found = None
    for number, (attribute, op, value, entity) in enumerate(checks, 1):
        hits = engine.validate_batch(users, attribute, op, value, entity, NOW).select(
            F.lit(number).alias("check_id"), "customer_id"
        )
        found = hits if found is None else found.unionByName(hits)
    return found


def custom_condition(spark: SparkSession, folder: str) -> DataFrame:
    registry = ConditionRegistry()
    balances = read(spark, folder, "customer").selectExpr("c_custkey AS customer_id", "c_acctbal AS balance")
    registry.register(
        "Account", "balance", balances, lambda op, value: compare_number("balance", op, value), ("balance",)
    )
    rule = group("all", leaf("Account.balance", ">=", "5000"), leaf("Order.total_orders", ">=", "5"))
    engine = SegmentEngine(shop(spark, folder), defs.one_segment(spark, rule, 30), _store(spark), registry)
    return engine.matches(NOW)


def custom_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Own conditions over raw events, any number of them a customer."""
    registry = ConditionRegistry()
    events = _events(spark, folder).selectExpr("user_id AS customer_id", "event_type", "value", "ts")
    registry.register_rows(
        "Event", "errors", events, {"errors": "count_if(event_type = 'error')"},
        lambda op, value: compare_number("errors", op, value), {"errors": "0"},
    )
    registry.register_rows(
        "Event", "spread", events, {"lowest": "min(value)", "highest": "max(value)", "seen": "max(ts)"},
        lambda op, value: f"seen >= TIMESTAMP_NTZ '2024-01-20' AND {compare_number('highest - lowest', op, value)}",
    )
    rules = {
        41: group("all", leaf("Event.errors", ">=", "14")),
        42: group("all", leaf("Event.spread", ">", "90"), leaf("Customer.group_id", "!=", "3")),
        43: group("any", leaf("Event.errors", "==", "0"), leaf("Order.total_orders", ">=", "18")),
    }
    rows = [(number, defs.rule_text(rule)) for number, rule in rules.items()]
    documents = small_table(spark, rows, "segment_id int, conditions_serialized string")
    return matches(shop(spark, folder), compile_segments(documents, registry), NOW, registry)


# -- memberships ----------------------------------------------------------------


def _matches(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    registry = ConditionRegistry()
    every = defs.segments(spark).unionByName(defs.live(spark))
    rules = compile_segments(scans.active_segments(every), registry)
    today = matches(shop(spark, folder), rules, NOW, registry)
    earlier = matches(shop(spark, folder).ordered_before(defs.BEFORE), rules, NOW, registry)
    return today, earlier


def delta_added(spark: SparkSession, folder: str) -> DataFrame:
    return membership.to_add(*_matches(spark, folder))


def delta_removed(spark: SparkSession, folder: str) -> DataFrame:
    return membership.to_remove(*_matches(spark, folder))


def assign_customers(spark: SparkSession, folder: str) -> DataFrame:
    return membership.assign(_buyers(spark, folder), _pairs(spark, folder), NOW)


def remove_customers(spark: SparkSession, folder: str) -> DataFrame:
    return membership.remove(_buyers(spark, folder), _pairs(spark, folder))


def assign_stored(spark: SparkSession, folder: str) -> DataFrame:
    """Assignments and removals on a stored membership, one after the other."""
    engine = _engine(spark, folder, 9, 10, 11, 13)
    engine.refresh_all(defs.EARLIER)
    events = scans.population(_events(spark, folder).withColumnRenamed("user_id", "customer_id"))
    pairs = ("customer_id", f"{K} % 3 + 9 AS segment_id")
    engine.assign(events.selectExpr(*pairs), NOW)
    engine.unassign(events.where("event_type = 'error'").selectExpr(*pairs), NOW)
    return engine.members()


def customer_segments(spark: SparkSession, folder: str) -> DataFrame:
    return lookup.customer_segments(_buyers(spark, folder), _catalog(spark, folder))


def customer_segment_ids(spark: SparkSession, folder: str) -> DataFrame:
    people = scans.population(shop(spark, folder).customer).select("customer_id")
    with_ids = membership.with_segment_ids(people, _buyers(spark, folder))
    return with_ids.selectExpr(
        "customer_id",
        "array_join(CAST(segment_ids AS ARRAY<STRING>), ',') AS segment_ids",
        "CAST(size(segment_ids) AS BIGINT) AS segments",
    )


def membership_check(spark: SparkSession, folder: str) -> DataFrame:
    return lookup.membership_check(_pairs(spark, folder), _buyers(spark, folder))


def export_members(spark: SparkSession, folder: str) -> DataFrame:
    return lookup.export_members(shop(spark, folder), _buyers(spark, folder), 1005)


def matched_customers(spark: SparkSession, folder: str) -> DataFrame:
    found = lookup.matched_customers(shop(spark, folder), _buyers(spark, folder), 1010, page=1, size=20)
    return found.rows.withColumn("total", F.lit(found.total).cast("bigint"))


def customers_in_segment(spark: SparkSession, folder: str) -> DataFrame:
    people = scans.population(shop(spark, folder).customer)
    return lookup.customers_in_segment(people, _buyers(spark, folder), 1003).select("customer_id", "email", "group_id")


def rule_quote_eligible(spark: SparkSession, folder: str) -> DataFrame:
    quotes = shop(spark, folder).quote.select("quote_id", "customer_id")
    return membership.in_segments(quotes, _buyers(spark, folder), [1003, 1005, 1010])


def rule_quote_not_in(spark: SparkSession, folder: str) -> DataFrame:
    quotes = shop(spark, folder).quote.select("quote_id", "customer_id")
    return membership.in_segments(quotes, _buyers(spark, folder), [1003, 1005, 1010], negate=True)


def segment_profile(spark: SparkSession, folder: str) -> DataFrame:
    facts = shop(spark, folder)
    wanted = [feats.ORDER_FEATURES[name] for name in ("total_orders", "total_revenue", "total_items")]
    features = feats.feature_table(facts, wanted, NOW)
    return lookup.segment_profile(_buyers(spark, folder), features, high_value=2_000_000)


# -- definitions ----------------------------------------------------------------


def segment_list(spark: SparkSession, folder: str) -> DataFrame:
    chosen = lifecycle.SegmentFilter(
        ids=(1010, None), counts=(900, 5000), name="BRAND#1", is_active=True, last_refreshed=(None, NOW)
    )
    found = lifecycle.list_segments(_catalog(spark, folder), chosen, "segment_id", page=2, size=20)
    return found.rows.select(
        "segment_id", "name", "status_label", "mode_label", "customer_count", "last_refreshed", F.lit(found.total).cast("bigint").alias("total")
    )


def segment_list_after(spark: SparkSession, folder: str) -> DataFrame:
    chosen = lifecycle.SegmentFilter(refresh_mode="cron")
    rows = lifecycle.filter_segments(_catalog(spark, folder), chosen)
    return lifecycle.page_after(rows, "segment_id", 1100, 50).select("segment_id", "name", "created_at")


def _segment_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Edits of some segments, and new ones for bundled products."""
    parts = read(spark, folder, "part").where("p_type = 'PROMO' OR p_size > 45")
    return parts.selectExpr(
        "CAST(p_partkey + if(p_type = 'PROMO', 10000000, 1000) AS INT) AS segment_id",
        "concat('Fans of ', p_name) AS name",
        "if(p_size % 2 = 0, 'realtime', NULL) AS refresh_mode",
        "if(p_size % 3 = 0, false, NULL) AS is_active",
    )


def upsert_segments(spark: SparkSession, folder: str) -> DataFrame:
    merged = lifecycle.upsert_segments(_catalog(spark, folder), _segment_changes(spark, folder), NOW)
    return merged.select(
        "segment_id", "name", "description", "is_active", "refresh_mode", "customer_count", "created_at", "updated_at"
    )


def stored_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Definitions after being stored, edited and deleted, one after the other."""
    store = DefinitionStore(spark, work_dir(spark, "definitions"))
    store.save(_catalog(spark, folder), defs.EARLIER)
    store.save(_segment_changes(spark, folder), NOW)
    store.delete(store.segments().where("refresh_mode = 'cron'"))
    return store.segments().select("segment_id", "name", "is_active", "refresh_mode", "created_at", "updated_at")


def delete_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Rows left per segment in the three tables after a cascading delete."""
    catalog, members = _catalog(spark, folder), _buyers(spark, folder)
    log = members.selectExpr("segment_id", f"'{ASSIGNED}' AS action", "assigned_at AS created_at")
    gone = catalog.where("refresh_mode = 'manual'").select("segment_id")
    tables = lifecycle.delete_segments(gone, catalog, members, log)
    left = [
        table.groupBy("segment_id").agg(F.expr("count(*) AS left_rows"), F.expr(f"'{name}' AS table_name"))
        for name, table in zip(("segments", "members", "log"), tables)
    ]
    return left[0].unionByName(left[1]).unionByName(left[2])


def forget_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Memberships left after customers were deleted."""
    people = scans.population(shop(spark, folder).customer).where("group_id <> 3")
    return lifecycle.forget_customers(_buyers(spark, folder), people)


def _ticks(spark: SparkSession, folder: str) -> DataFrame:
    """The worked-out schedule: a five-minute slot of each hour in which something happened."""
    return _events(spark, folder).selectExpr(
        "concat('*/5 ', CAST(hour(ts) AS STRING), ' * * *') AS cron_expression",
        "ts - make_dt_interval(0, 0, minute(ts) % 5, CAST(extract(SECOND FROM ts) AS DECIMAL(18,6))) AS due_at",
    )


def segments_due(spark: SparkSession, folder: str) -> DataFrame:
    due = lifecycle.segments_due(_catalog(spark, folder), _ticks(spark, folder), defs.TICK)
    return due.select("segment_id", "refresh_mode", "cron_expression")


def segments_stale(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle.segments_stale(_catalog(spark, folder), NOW).select("segment_id", "refresh_mode", "last_refreshed")


def segments_need_refresh(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle.needs_refresh(_catalog(spark, folder), NOW).select("segment_id", "refresh_mode", "last_refreshed")


# -- streams --------------------------------------------------------------------


def _file_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    # a file stream takes a folder or a pattern, not one file
    return spark.readStream.schema(schemas.SOURCE_FILES[table]).parquet(f"{folder}/{table}.parque[t]")


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    return _file_stream(spark, folder, "events")


def _of_kind(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return _event_stream(spark, folder).where(f"event_type = '{kind}'").selectExpr("event_id", "user_id AS customer_id")


def stream_register(spark: SparkSession, folder: str) -> DataFrame:
    """Earlier memberships, then those who signed up, over today's facts: they only join."""
    _, engine = _earlier(spark, folder)
    stream = _of_kind(spark, folder, "signup")
    changes.drain(changes.customer_registered(stream, lambda: engine, lambda: NOW, work_dir(spark, "stream")))
    return engine.members()


def _live(spark: SparkSession, folder: str, before: Shop, *streamed: str) -> SegmentEngine:
    """Today's engine over memberships, deadlines and kept facts of an earlier day."""
    store = _store(spark)
    SegmentEngine(before, defs.live(spark), store).refresh_all(defs.EARLIER)
    engine = SegmentEngine(shop(spark, folder), defs.live(spark), store, streamed=streamed)
    if streamed:
        engine.build_facts(before)
    return engine


def stream_customer_save(spark: SparkSession, folder: str) -> DataFrame:
    """Customers in debt were saved: they join and leave the realtime segments by today's facts."""
    engine = _live(spark, folder, shop(spark, folder).ordered_before(defs.BEFORE))
    saved = _file_stream(spark, folder, "customer").where("c_acctbal < 0").selectExpr("c_custkey AS customer_id")
    changes.drain(changes.customer_saved(saved, lambda: engine, lambda: NOW, work_dir(spark, "stream")))
    return engine.members()


def stream_order_placed(spark: SparkSession, folder: str) -> DataFrame:
    """The orders since the earlier day are placed one by one: added to kept facts, and with them whom time alone moves."""
    engine = _live(spark, folder, shop(spark, folder).ordered_before(defs.BEFORE), "orders")
    raw = _file_stream(spark, folder, "orders").where(f"o_orderdate >= TIMESTAMP_NTZ '{defs.BEFORE}'")
    placed = sales_orders(spark, folder, raw)
    changes.drain(changes.orders_placed(placed, lambda: engine, lambda: NOW, work_dir(spark, "stream")))
    return engine.members()


def stream_cart_change(spark: SparkSession, folder: str) -> DataFrame:
    """The carts of the last days change: new ones become the latest, bought ones are gone."""
    engine = _live(spark, folder, shop(spark, folder).carts_before(defs.CARTS_BEFORE), "carts")
    changed = quotes(spark, folder, _event_stream(spark, folder)).where(f"updated_at >= TIMESTAMP_NTZ '{defs.CARTS_BEFORE}'")
    changes.drain(changes.carts_changed(changed, lambda: engine, lambda: NOW, work_dir(spark, "stream")))
    return engine.members()


def time_flips(spark: SparkSession, folder: str) -> DataFrame:
    """Members on day 0 and after three later runs without any event."""
    engine = SegmentEngine(shop(spark, folder), defs.live(spark), _store(spark))
    engine.refresh_all(defs.DAY_0)
    states = [written(engine.members(), "members").withColumn("run", F.lit(0))]
    for run, now in enumerate(defs.RUNS, 1):
        engine.refresh_elapsed(now)
        states.append(written(engine.members(), "members").withColumn("run", F.lit(run)))
    return reduce(DataFrame.unionByName, states)


def refresh_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """All active segments of the product catalogue, one per product, in one pass."""
    engine = SegmentEngine(shop(spark, folder), _catalog(spark, folder), _store(spark))
    engine.refresh_all(NOW)
    return engine.members()


def stream_changelog(spark: SparkSession, folder: str) -> DataFrame:
    _, engine = _earlier(spark, folder)
    entries = _event_stream(spark, folder).where("event_type IN ('error', 'view')").selectExpr(
        f"if(event_type = 'error', '{changes.SEGMENT_ROW}', '{changes.CUSTOMER_ROW}') AS entity",
        f"if(event_type = 'error', {K} % 10 + 1, user_id) AS row_id",
    )
    changes.drain(changes.change_log(entries, lambda: engine, lambda: NOW, work_dir(spark, "stream")))
    return engine.members()


def stream_login_lookup(spark: SparkSession, folder: str) -> DataFrame:
    sink = work_dir(spark, "logins")
    logins = _of_kind(spark, folder, "error")
    members = lambda: _buyers(spark, folder)
    changes.drain(changes.login_lookup(logins, members, sink, work_dir(spark, "stream")))
    return spark.read.schema("event_id bigint, customer_id bigint, segment_count bigint").parquet(f"{sink}/batch=*")


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for query in (
        stream_register, stream_customer_save, stream_order_placed, stream_cart_change, time_flips, refresh_catalog,
        src_population, src_eav_pivot, src_valid_orders, src_active_carts, src_cart_items, src_active_segments,
        export_csv, export_xml,
        feature_table, agg_order_summary, agg_having, agg_purchased_items, agg_distinct_products,
        agg_segment_counts, cart_latest, cart_matching_items,
        refresh_segment, refresh_all, mass_refresh, refresh_log, refresh_status,
        stale_after_refresh, list_after_refresh, forget_stored, segment_growth, match_check, validate_batch,
        custom_condition, custom_rows,
        delta_added, delta_removed, assign_customers, remove_customers, assign_stored,
        customer_segments, customer_segment_ids, membership_check, export_members, matched_customers,
        customers_in_segment, rule_quote_eligible, rule_quote_not_in, segment_profile,
        segment_list, segment_list_after, upsert_segments, stored_segments, delete_segments, forget_customers,
        segments_due, segments_stale, segments_need_refresh,
        stream_changelog, stream_login_lookup,
    ):
        found[query.__name__] = query
    for key, cases in CASES.items():
        found[key] = _rules(*[group("all", leaf(path, op, value)) for path, op, value, _ in cases])
    for key, trees in RULES.items():
        found[key] = _rules(*[rule for rule, _ in trees])
    return found
