"""Thousands of rules at once: values lead to leaves, leaves to segments.

A rule is a list of clauses, and some leaf of each must hold. Most leaves of large catalogues ask whether some fact of
the customer has one of some values ("bought SKU x"). Those are not tested at all: the distinct values of a customer are
looked up in a table value -> leaves, and the leaves that were raised lead to the segments. Of each rule only one clause
leads there, the one that was raised least often (as counted), so that the work grows with the matches of the rarest
clause and not with rules x customers; a candidate is then held against the rule's other clauses.

Only rules with a clause of such leaves alone come here; of the leaves in their other clauses, those that compare
numbers and texts of a customer are evaluated once each, however many rules share them.

Large catalogues do not fit into the driver. Of those, rules all of whose leaves ask for values are compiled in tasks to
a table of their clauses, leaves and values (``listed_rules``), and never come to the driver.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Iterator, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import RuleError
from ..operators.conditions import ConditionRegistry, Leaf
from ..operators.features import feature_table, order_products
from ..operators.joins import lookup_join
from ..session import SEGMENTS_PER_PASS, int_setting, ship, small_table, written
from ..sources.shop import Shop, latest_carts, population, top_level_items, valid_orders
from .rules import CompiledRule, compile_rule

Clause = frozenset[Leaf]


def _looked_up(leaf: Leaf) -> bool:
    return len(leaf.features) == 1 and bool(leaf.features[0].values)


def indexable(rule: CompiledRule) -> bool:
    """Some clause of the rule consists of leaves that ask for values."""
    return any(clause and all(map(_looked_up, clause)) for clause in rule.clauses or ())


def _customer_values(shop: Shop, source: str, key: str, column: str, wanted: DataFrame, rows: int) -> DataFrame:
    """Distinct (customer_id, ``column``) of the facts of a source, of the wanted values only.

    ``wanted`` is unique in ``column``. Facts are reduced to wanted values before they meet their customer, and to
    distinct pairs, with map-side combining, before anything else.
    """

    def kept(facts: DataFrame) -> DataFrame:
        valued = facts.withColumn(column, F.expr(key))
        return lookup_join(valued.where(F.col(column).isNotNull()), wanted, column, rows, "left_semi")

    if source == "order_rows":
        found = kept(valid_orders(shop.sales_order))
    elif source == "order_items":
        items = kept(shop.sales_order_item).select("order_id", column).distinct()
        orders = valid_orders(shop.sales_order).select("order_id", "customer_id")
        found = lookup_join(items, orders, "order_id", shop.order_rows, keys=shop.item_keys)
    elif source == "cart_items":
        items = kept(top_level_items(shop.quote_item)).select("quote_id", column).distinct()
        # a latest cart is one row, so its items meet one row
        found = items.join(latest_carts(shop.quote).select("quote_id", "customer_id"), "quote_id")
    else:
        # per product the values of its categories; a product has few
        links = kept(shop.category_product).groupBy("product_id").agg(F.collect_set(column).alias("__values"))
        if source == "order_categories":
            seen = order_products(shop).select("customer_id", "product_id").distinct()
        else:
            seen = shop.product_view.select("customer_id", "product_id").where("customer_id IS NOT NULL").distinct()
        found = lookup_join(seen, links, "product_id", shop.catalog_rows).select("customer_id", F.explode("__values").alias(column))
    return found.select("customer_id", column).distinct()


def _raised(shop: Shop, leaves: Mapping[Leaf, int]) -> DataFrame:
    """Distinct (customer_id, leaf_id) of the leaves that ask for values."""
    spark = shop.customer.sparkSession
    by_key: dict[tuple[str, str], dict[object, list[int]]] = {}
    for leaf, number in leaves.items():
        feature = leaf.features[0]
        for value in feature.values:
            by_key.setdefault((feature.source, feature.key), {}).setdefault(value, []).append(number)
    parts = []
    for (source, key), values in sorted(by_key.items()):
        kind = "bigint" if isinstance(next(iter(values)), int) else "string"
        table = small_table(spark, [(v, sorted(set(ids))) for v, ids in values.items()], f"__value {kind}, __leaves array<int>")
        table = written(table, "rule-values")
        pairs = _customer_values(shop, source, key, "__value", table.select("__value"), len(values))
        found = lookup_join(pairs, table, "__value", len(values)).select("customer_id", F.explode("__leaves").alias("leaf_id"))
        # several values of one leaf
        parts.append(found.distinct())
    return reduce(DataFrame.unionByName, parts)


def _tested(features: DataFrame, leaves: Mapping[Leaf, int]) -> DataFrame:
    """customer_id, tested: the numbers of the other leaves that hold, a bounded number of them at a time."""
    per_pass = int_setting(features.sparkSession, SEGMENTS_PER_PASS)
    ordered = sorted(leaves.items(), key=lambda item: item[1])
    parts = []
    for at in range(0, len(ordered), per_pass):
        hits = ", ".join(f"if({leaf.predicate}, {number}, NULL)" for leaf, number in ordered[at : at + per_pass])
        parts.append(features.selectExpr("customer_id", f"array_compact(array({hits})) AS tested"))
    if len(parts) == 1:
        return parts[0]
    whole = reduce(DataFrame.unionByName, parts)
    return whole.groupBy("customer_id").agg(F.flatten(F.collect_list("tested")).alias("tested"))


def indexed_matches(
    shop: Shop, rules: Mapping[int, CompiledRule], now: dt.datetime, registry: ConditionRegistry
) -> DataFrame:
    """(segment_id, customer_id) of ``indexable`` rules."""
    spark = shop.customer.sparkSession
    live = {segment_id: rule.clauses for segment_id, rule in sorted(rules.items()) if all(rule.clauses)}
    distinct = dict.fromkeys(leaf for clauses in live.values() for clause in clauses for leaf in clause)
    numbers = {leaf: number for number, leaf in enumerate(sorted(distinct, key=lambda leaf: leaf.predicate))}
    if not numbers:
        return small_table(spark, [], "segment_id int, customer_id bigint")
    valued = {leaf: n for leaf, n in numbers.items() if _looked_up(leaf)}
    others = {leaf: n for leaf, n in numbers.items() if not _looked_up(leaf)}
    people = population(shop.customer).select("customer_id")
    raised = written(_raised(shop, valued).join(people, "customer_id", "left_semi"), "raised-leaves")
    # one count per leaf of a rule: people wrote them, and the rules are on the driver anyway
    counts = {row.leaf_id: row["count"] for row in raised.groupBy("leaf_id").count().collect()}

    lists: dict[int, list[tuple[int, list[list[int]]]]] = {}
    for segment_id, clauses in live.items():
        keys = [clause for clause in clauses if all(map(_looked_up, clause))]
        rarest = min(keys, key=lambda clause: (sum(counts.get(numbers[leaf], 0) for leaf in clause), sorted(numbers[x] for x in clause)))
        rest = [sorted(numbers[leaf] for leaf in clause) for clause in clauses if clause is not rarest]
        for leaf in rarest:
            lists.setdefault(numbers[leaf], []).append((segment_id, rest))
    kind = "leaf_id int, segments array<struct<segment_id: int, rest: array<array<int>>>>"
    records = [(n, [{"segment_id": s, "rest": rest} for s, rest in found]) for n, found in sorted(lists.items())]
    lists_table = written(small_table(spark, records, kind), "leaf-lists")
    found = lookup_join(raised, lists_table, "leaf_id", len(records)).select("customer_id", F.explode("segments").alias("s"))
    candidates = found.select("customer_id", "s.segment_id", "s.rest")
    if any(rest for _, entries in lists.items() for _, rest in entries):
        sets = raised.groupBy("customer_id").agg(F.collect_set("leaf_id").alias("held"))
        if others:
            needed = set().union(*[leaf.features for leaf in others])
            tested = _tested(written(feature_table(shop, needed, now, registry.facts), "features"), others)
            sets = sets.join(tested, "customer_id", "left")
            sets = sets.select("customer_id", F.expr("concat(held, coalesce(tested, array())) AS held"))
        candidates = candidates.join(sets, "customer_id").where("forall(rest, clause -> arrays_overlap(clause, held))")
    return candidates.select("segment_id", "customer_id").distinct()


_LISTED = "segment_id int, clause int, leaf_id bigint, source string, key string, text_value string, id_value bigint, rule string"


def _list_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per rule, clause, leaf and value; rules of another form come back as they are."""
    registry, names = ConditionRegistry(), [part.split()[0] for part in _LISTED.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
    for batch in batches:
        rows: list[tuple] = []
        for segment_id, text in zip(*(column.to_pylist() for column in batch.columns)):
            try:
                rule = compile_rule(text, registry)
            except RuleError:
                rule = None
            if rule is None or not rule.clauses or not all(c and all(map(_looked_up, c)) for c in rule.clauses):
                rows.append((segment_id, None, None, None, None, None, None, text))
                continue
            for number, clause in enumerate(rule.clauses):
                for leaf in clause:
                    feature = leaf.features[0]
                    leaf_id = int.from_bytes(hashlib.sha1(leaf.predicate.encode()).digest()[:8], "big", signed=True)
                    for value in feature.values:
                        both = (None, value) if isinstance(value, int) else (value, None)
                        rows.append((segment_id, number, leaf_id, feature.source, feature.key, *both, None))
        columns = zip(*rows) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(columns, kinds)], names)


def listed_rules(definitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table of rules all of whose leaves ask for values, and the definitions of all other rules.

    Of definitions that repeat an id the last counts.
    """
    ship(definitions.sparkSession.sparkContext)
    placed = definitions.select("segment_id", "conditions_serialized", F.monotonically_increasing_id().alias("__at"))
    last = placed.groupBy("segment_id").agg(F.expr("max_by(conditions_serialized, __at) AS conditions_serialized"))
    found = written(last.mapInArrow(_list_rules, _LISTED), "listed-rules")
    others = found.where("clause IS NULL").selectExpr("segment_id", "rule AS conditions_serialized")
    return found.where("clause IS NOT NULL").drop("rule"), others


def listed_matches(shop: Shop, listed: DataFrame) -> DataFrame:
    """(segment_id, customer_id) of ``listed_rules``: the same as ``indexed_matches``, with nothing of the rules on the driver."""
    people = population(shop.customer).select("customer_id")
    parts = []
    for row in sorted(listed.select("source", "key").distinct().collect()):  # the kinds of leaves there are
        of_kind = listed.where((F.col("source") == row.source) & (F.col("key") == row.key))
        column = "text_value" if of_kind.where("id_value IS NOT NULL").isEmpty() else "id_value"
        table = of_kind.groupBy(F.col(column).alias("__value")).agg(F.collect_set("leaf_id").alias("__leaves"))
        table = written(table, "rule-values")
        values = table.count()
        pairs = _customer_values(shop, row.source, row.key, "__value", table.select("__value"), values)
        found = lookup_join(pairs, table, "__value", values).select("customer_id", F.explode("__leaves").alias("leaf_id"))
        parts.append(found.distinct())
    if not parts:
        return small_table(listed.sparkSession, [], "segment_id int, customer_id bigint")
    raised = written(reduce(DataFrame.unionByName, parts).join(people, "customer_id", "left_semi"), "raised-leaves")

    counts = raised.groupBy("leaf_id").agg(F.expr("count(*) AS n"))
    clauses = listed.select("segment_id", "clause", "leaf_id").distinct().join(counts, "leaf_id", "left")
    clauses = clauses.groupBy("segment_id", "clause").agg(F.expr("sum(coalesce(n, 0)) AS n"), F.collect_list("leaf_id").alias("leaves"))
    rules = clauses.groupBy("segment_id").agg(
        F.expr("min(struct(n, clause)).clause AS rarest"), F.collect_list(F.struct("clause", "leaves")).alias("clauses")
    )
    chosen = rules.selectExpr(
        "segment_id",
        "explode(flatten(transform(filter(clauses, c -> c.clause = rarest), c -> c.leaves))) AS leaf_id",
        "transform(filter(clauses, c -> c.clause <> rarest), c -> c.leaves) AS rest",
    )
    lists = written(chosen.groupBy("leaf_id").agg(F.collect_list(F.struct("segment_id", "rest")).alias("segments")), "leaf-lists")
    found = lookup_join(raised, lists, "leaf_id", lists.count()).select("customer_id", F.explode("segments").alias("s"))
    candidates = found.select("customer_id", "s.segment_id", "s.rest")
    if not lists.where("exists(segments, s -> size(s.rest) > 0)").isEmpty():
        sets = raised.groupBy("customer_id").agg(F.collect_set("leaf_id").alias("held"))
        candidates = candidates.join(sets, "customer_id").where("forall(rest, clause -> arrays_overlap(clause, held))")
    return candidates.select("segment_id", "customer_id").distinct()
