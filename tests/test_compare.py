from __future__ import annotations

import pytest

from cohortry.functions import compare as cmp
from cohortry.functions.values import RuleError, as_category, as_list, as_number, as_range, text_literal
from cohortry.operators.conditions import ConditionRegistry
from cohortry.session import small_table


def matched(spark, test: str, values: list, kind: str = "string") -> list:
    table = small_table(spark, [(v,) for v in values], f"v {kind}")
    return [r.v for r in table.where(f"coalesce({test}, false)").collect()]


TRICKY = ["it's", "back\\slash", "${spark.app.name}", "tab\there", "100%_", "ümlaut", "", "'; --", "line\nbreak", "\\'"]


@pytest.mark.parametrize("escaped", ["true", "false"])
def test_any_text_is_one_literal(spark, setting, escaped):
    setting(spark__sql__parser__escapedStringLiterals=escaped)
    for text in TRICKY:
        assert spark.sql(f"SELECT {text_literal(text)} AS v").first().v == text
        assert matched(spark, cmp.compare_text("v", "==", text), [*TRICKY, None]) == [text]


def test_wildcards_are_plain_characters(spark):
    assert matched(spark, cmp.compare_text("v", "{}", "%"), ["a%b", "ab"]) == ["a%b"]
    assert matched(spark, cmp.compare_text("v", "^=", "_"), ["_a", "ab"]) == ["_a"]


def test_null_never_matches(spark):
    for op in cmp.ALL_OPERATORS:
        assert None not in matched(spark, cmp.compare_text("v", op, "a,b"), [None, "a", "b", "c"])
        if op not in cmp.MATCHING:
            assert None not in matched(spark, cmp.compare_number("v", op, "1,2"), [None, 1, 2, 3], "int")
    assert matched(spark, cmp.compare_number("v", "!()", "a,b"), [None, 1], "int") == [1]


def test_numbers():
    assert as_number(" 5 ") is not None and as_number("1e3") == 1000 and as_number("-.5") == -0.5
    assert [as_number(v) for v in ("", None, "5 apples", "1_000", "nan", "0x1A", [])] == [None] * 7
    assert as_number(True) == 1 and as_category("7.9") == 7 and as_category("x") == 0


def test_a_value_that_is_no_number_matches_nobody(spark):
    for op in ("==", "!=", "<", "()"):
        assert matched(spark, cmp.compare_number("v", op, "many"), [1, 2], "int") == []
    assert matched(spark, cmp.compare_number("v", "between", "1,x"), [1, 2], "int") == []


def test_lists_and_ranges():
    assert as_list(" a, b ,c") == ["a", "b", "c"] == as_list(["a ", " b", "c"])
    assert as_range([1, 2]) == ("1", "2")
    with pytest.raises(RuleError):
        as_range("1")


def test_dates(spark):
    days = ["2024-01-01", "2024-01-02", None]
    table = small_table(spark, [(d,) for d in days], "s string").selectExpr("CAST(s AS DATE) AS v")

    def found(test):
        return [str(r.v) for r in table.where(test).collect()]

    assert found(cmp.compare_day("v", "==", "2024-01-02 23:59:00")) == ["2024-01-02"]
    assert found(cmp.compare_day("v", "between", "2024-01-01,2024-01-01")) == ["2024-01-01"]
    assert found(cmp.compare_day("v", "{}", "2024-01-01 05:00:00")) == ["2024-01-01"]
    assert found(cmp.compare_day("v", "==", "")) == []
    with pytest.raises(RuleError):
        cmp.compare_day("v", "==", "soon")


def test_order_dates_compare_days_or_instants(spark):
    table = small_table(spark, [("2024-01-01 10:00:00",)], "s string").selectExpr("CAST(s AS TIMESTAMP_NTZ) AS v")

    def holds(op, value):
        return not table.where(cmp.compare_order_date("v", op, value)).isEmpty()

    assert holds("==", "2024-01-01 23:00:00") and not holds("!=", "2024-01-01")
    assert holds(">", "2024-01-01") and not holds("<", "2024-01-01 10:00:00")
    assert holds("between", ["2024-01-01 10:00:00", "2024-01-02"])


@pytest.mark.parametrize(
    "path, op, value",
    [
        ("Customer.email", "~", "x"),
        ("Customer.shoe_size", "==", "1"),
        ("Order.total_orders", "{}", "1"),
        ("Order.last_order_date", "()", "2024-01-01"),
        ("Order.last_order_date", ">", "soon"),
        ("Order.payment_method", "^=", "c"),
        ("Cart.cart_subtotal", "{}", "1"),
        ("Cart.cart_items_count", "between", "1,2"),
        ("Cart.cart_products", "()", "a"),
        ("Product.purchased_categories", "{}", "1"),
        ("Product.purchased_products", "()", "a"),
        ("Product.wishlist_items_count", "()", "1"),
    ],
)
def test_leaves_that_make_no_sense(path, op, value):
    family, attribute = path.split(".")
    with pytest.raises(RuleError):
        ConditionRegistry().leaf(family, attribute, op, value)
