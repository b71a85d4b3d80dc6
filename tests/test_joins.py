from __future__ import annotations

import collections

import pytest

from cohortry.operators.joins import lookup_join, spread_join
from cohortry.session import small_table


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def bag(df):
    return collections.Counter(tuple(row) for row in df.collect())


@pytest.fixture
def tables(spark):
    """Key 1 owns a third of the rows, NULL another part; key 9 has no match."""
    rows = [(1, i) for i in range(400)] + [(None, i) for i in range(200)] + [(i % 50 + 2, i) for i in range(600)]
    large = small_table(spark, rows, "k bigint, v int")
    unique = small_table(spark, [(k, f"n{k}") for k in range(0, 40) if k != 9], "k bigint, n string")
    return large, unique


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_spread_join_is_the_plain_join(spark, spread, tables, how):
    large, unique = tables
    expected = bag(large.join(unique, "k", how))
    assert bag(lookup_join(large, unique, "k", 40, how)) == expected
    # counting keys in a table with more rows, and of other keys, changes nothing
    keys = large.select("k").unionAll(large.select("k")).unionAll(small_table(spark, [(77,)] * 9, "k bigint"))
    assert bag(spread_join(large, unique, "k", how, keys)) == expected


def test_hot_and_null_keys_use_many_partitions(spark, spread, setting, tables):
    setting(spark__sql__adaptive__enabled="false", spark__sql__shuffle__partitions=16)
    large, unique = tables
    joined = lookup_join(large, unique, "k", 40, "left").selectExpr("k", "spark_partition_id() AS p")
    spread_of = {r.k: r.n for r in joined.groupBy("k").agg({"p": "collect_set"}).selectExpr("k", "size(`collect_set(p)`) AS n").collect()}
    assert spread_of[1] > 8 and spread_of[None] > 8


def test_size_decides(spark, setting, tables):
    large, unique = tables
    setting(spark__sql__autoBroadcastJoinThreshold=-1, spark__cohortry__broadcastRows=40)
    assert "__salt" not in plan(lookup_join(large, unique, "k", 40))
    assert "__salt" in plan(lookup_join(large, unique, "k", 41))
    wide = unique.selectExpr("*", *[f"k AS w{i}" for i in range(8)])  # ten columns
    assert "__salt" not in plan(lookup_join(large, wide, "k", 20))
    assert "__salt" in plan(lookup_join(large, wide, "k", 21))


def test_unknown_join_type(tables):
    with pytest.raises(ValueError):
        lookup_join(*tables, "k", 40, "full_outer")


def test_equal_rows_of_a_hot_key_count_once_before_the_shuffle(spark, spread, setting):
    setting(spark__sql__adaptive__enabled="false", spark__sql__shuffle__partitions=16)
    large = small_table(spark, [(1, 7)] * 2000 + [(1, i) for i in range(40)], "k bigint, v int")
    unique = small_table(spark, [(1, "a")], "k bigint, n string")
    assert bag(lookup_join(large, unique, "k", 40, repeats=False)) == bag(large.distinct().join(unique, "k"))
    joined = lookup_join(large, unique, "k", 40, repeats=False).selectExpr("spark_partition_id() AS p")
    assert joined.distinct().count() > 3
