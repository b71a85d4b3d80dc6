"""Facts stored by customer bucket give the same answers and are read in part."""

from __future__ import annotations

import random
import re

from cohortry.operators.conditions import ConditionRegistry
from cohortry.plans.evaluate import RuleSet, matches
from cohortry.plans.rules import compile_tree
from cohortry.session import small_table, work_dir
from cohortry.sources.layout import cluster_by_customer

from .small_shop import NOW, random_shop
from .test_rules_by_loops import every_leaf, random_group


def plan(df) -> str:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_same_answers(spark, spread):
    small, registry = random_shop(31), ConditionRegistry()
    rules = RuleSet({n: compile_tree(rule, registry) for n, rule in every_leaf().items()})
    shop = small.shop(spark)
    clustered = cluster_by_customer(shop, work_dir(spark, "layout"), buckets=8)
    expected = {tuple(r) for r in matches(shop, rules, NOW, registry).collect()}
    assert {tuple(r) for r in matches(clustered, rules, NOW, registry).collect()} == expected


def test_some_customers_read_some_buckets(spark):
    small, registry, rnd = random_shop(32), ConditionRegistry(), random.Random(32)
    rules = RuleSet({n: compile_tree(random_group(rnd), registry) for n in range(1, 25)})
    clustered = cluster_by_customer(small.shop(spark), work_dir(spark, "layout"), buckets=16)
    touched = small_table(spark, [(1,), (7,), (999,)], "customer_id bigint")
    everyone = {tuple(r) for r in matches(small.shop(spark), rules, NOW, registry).collect()}
    some = matches(clustered.for_customers(touched, 3), rules, NOW, registry)
    assert {tuple(r) for r in some.collect()} == {(s, c) for s, c in everyone if c in (1, 7)}
    reads = re.findall(r"\n\(\d+\) Scan parquet.*?\n\n", plan(some), re.S)
    pruned = [read for read in reads if re.search(r"PartitionFilters: \[.*customer_bucket", read)]
    assert len(pruned) == len(reads) >= 5


def test_nobody(spark):
    clustered = cluster_by_customer(random_shop(33).shop(spark), work_dir(spark, "layout"), buckets=4)
    nobody = small_table(spark, [], "customer_id bigint")
    assert clustered.for_customers(nobody, 0).sales_order.isEmpty()


def test_a_hot_bucket_is_cut_into_several_files(spark, setting):
    setting(
        spark__sql__adaptive__advisoryPartitionSizeInBytes="64k",
        spark__sql__adaptive__coalescePartitions__minPartitionSize="16k",
        spark__sql__shuffle__partitions=8,
    )
    small = random_shop(34)
    hot = spark.range(0, 200_000, 1, 8).selectExpr(
        "id AS order_id", "if(id % 3 = 0, 1L, id) AS customer_id", "'complete' AS state", "md5(CAST(id AS STRING)) AS status"
    )
    shop = small.shop(spark).with_tables(sales_order=hot)
    path = work_dir(spark, "layout")
    clustered = cluster_by_customer(shop, path, buckets=4)
    bucket = clustered.sales_order.where("customer_id = 1").select("customer_bucket").first()[0]
    files = {f for f in spark.read.parquet(f"{path}/sales_order/customer_bucket={bucket}").inputFiles()}
    assert len(files) >= 4
    assert clustered.sales_order.count() == 200_000


def test_many_customers(spark, setting):
    """Beyond the broadcast bound only the population is reduced, in whichever layout."""
    small, registry = random_shop(35), ConditionRegistry()
    rules = RuleSet({n: compile_tree(rule, registry) for n, rule in every_leaf().items()})
    shop = small.shop(spark)
    touched = small_table(spark, [(i,) for i in range(1, 30)], "customer_id bigint")
    expected = {(s, c) for s, c in map(tuple, matches(shop, rules, NOW, registry).collect()) if c < 30}
    setting(spark__cohortry__broadcastRows=5)
    for facts in (shop, cluster_by_customer(shop, work_dir(spark, "layout"), buckets=4)):
        found = matches(facts.for_customers(touched, 29), rules, NOW, registry)
        assert {tuple(r) for r in found.collect()} == expected


def test_order_items_of_some_customers_are_dealt_by_their_number(spark, setting):
    """AQE would put them into tasks that hold more the more items there are."""
    small, registry, rnd = random_shop(35), ConditionRegistry(), random.Random(35)
    rules = RuleSet({n: compile_tree(random_group(rnd), registry) for n in range(1, 25)})
    touched = small_table(spark, [(1,), (7,), (999,)], "customer_id bigint")
    expected = {tuple(r) for r in matches(small.shop(spark).for_customers(touched, 3), rules, NOW, registry).collect()}
    items = len(small.rows["sales_order_item"])
    setting(spark__cohortry__taskRows=items // 20, spark__sql__autoBroadcastJoinThreshold=-1)
    shop = small.shop(spark).for_customers(touched, 3)
    assert shop.item_rows == items
    assert shop.item_keys.rdd.getNumPartitions() >= 20
    assert {tuple(r) for r in matches(shop, rules, NOW, registry).collect()} == expected
