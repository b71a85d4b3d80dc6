"""What the physical plans must and must not contain."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

from cohortry.operators.conditions import ConditionRegistry
from cohortry.plans.evaluate import active_rules, compile_segments, matches
from cohortry.plans.rules import group, leaf
from cohortry.sources.driver_tables import shop
from cohortry.suite import definitions as defs
from cohortry.suite.queries import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables not present")


def plan(df) -> str:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def scans(text: str) -> dict[str, list[str]]:
    """Columns read per scan, by table."""
    found: dict[str, list[str]] = {}
    for block in re.findall(r"\(\d+\) Scan parquet.*?\n\n", text, re.S):
        table = re.search(r"/(\w+)\.parquet", block).group(1)
        found.setdefault(table, []).append(re.search(r"ReadSchema: struct<(.*)>", block).group(1))
    return found


@pytest.fixture(scope="module")
def all_segments(spark):
    registry = ConditionRegistry()
    return plan(matches(shop(spark, FOLDER), active_rules(defs.segments(spark), registry), defs.NOW, registry))


def test_one_pass_over_each_fact(all_segments):
    read = scans(all_segments)
    assert len(read["orders"]) == len(read["customer"]) == len(read["lineitem"]) == 1
    assert read["lineitem"] == ["l_orderkey:bigint,l_partkey:bigint"]


def test_nothing_that_does_not_scale(all_segments):
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Window", "collect_list", "Python", "SinglePartition"):
        assert bad not in all_segments


def test_only_needed_tables_and_columns(spark):
    read = scans(plan(queries()["ord_total_orders"](spark, FOLDER)))
    assert "lineitem" not in read and "events" not in read
    assert read["orders"] == ["o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string"]


def test_a_single_rule_is_pushed_down(spark):
    rule = group("all", leaf("Customer.lastname", "==", "Customer#000000007"), leaf("Order.total_orders", ">=", "1"))
    registry = ConditionRegistry()
    rules = compile_segments(defs.one_segment(spark, rule), registry)
    text = plan(matches(shop(spark, FOLDER), rules, defs.NOW, registry))
    assert re.search(r"PushedFilters: \[.*EqualTo\(c_name,Customer#000000007\)", text)
    assert "LeftOuter" not in text


def test_filters_reach_the_scan(spark):
    text = plan(queries()["cart_latest"](spark, FOLDER))
    assert re.search(r"PushedFilters: \[.*EqualTo\(event_type,click\)", text)


def test_latest_cart_combines_before_the_shuffle(spark):
    text = plan(queries()["cart_latest"](spark, FOLDER)).split("\n\n")[0]
    assert text.count("SortAggregate") == 2 and text.count("Exchange") == 1
