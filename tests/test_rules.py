from __future__ import annotations

import json

import pytest

from cohortry.functions.values import RuleError
from cohortry.operators.conditions import ConditionRegistry
from cohortry.plans.rules import EVERYONE, NOBODY, compile_rule, group, leaf


def rule(document) -> object:
    return compile_rule(document if document is None or isinstance(document, str) else json.dumps(document), ConditionRegistry())


@pytest.mark.parametrize("text", [None, "", "0", "{", "not json"])
def test_missing_rule_matches_nobody(text):
    assert rule(text) == NOBODY


@pytest.mark.parametrize("text", ["{}", "[]", "5", '{"conditions": []}', '{"aggregator": "any", "conditions": null}'])
def test_empty_rule_matches_everyone(text):
    assert rule(text) == EVERYONE


def test_a_qualified_type_names_its_family_last():
    short = rule(group("all", leaf("Order.total_orders", ">=", "10")))
    document = {
        "type": "Shop\\Rule\\Condition\\Combine",
        "conditions": [
            {"type": "Shop\\Rule\\Condition\\Order", "attribute": "total_orders", "operator": ">=", "value": "10"}
        ],
    }
    assert rule(document) == short


def test_defaults_of_a_leaf():
    plain = rule(group("all", leaf("Customer.taxvat", "==", "")))
    assert rule({"conditions": [{"type": "Customer", "attribute": "taxvat"}]}) == plain


def test_the_negation_flag_of_a_group_is_stored_but_plays_no_part():
    node = group("any", leaf("Customer.gender", "==", "1"))
    assert rule(node) == rule({**node, "value": False})


def test_equal_leaves_share_one_feature():
    one = leaf("Order.used_coupon", "==", "SAVE1")
    same = leaf("Order.used_coupon", "==", ["SAVE1", "ignored"])
    assert len(rule(group("any", one, same)).features) == 1


@pytest.mark.parametrize(
    "document",
    [
        group("some", leaf("Customer.gender", "==", "1")),
        group("all", {"type": "Evil", "attribute": "x", "operator": "==", "value": 1}),
        group("all", group("any", leaf("Customer.nothing", "==", "1"))),
    ],
)
def test_rules_that_fail(document):
    with pytest.raises(RuleError):
        rule(document)


def test_an_unknown_aggregator_of_an_empty_group_does_no_harm():
    assert rule({"aggregator": "some", "conditions": []}) == EVERYONE


def test_keyed_conditions_are_a_list():
    one, two = leaf("Customer.gender", "==", "1"), leaf("Order.total_orders", ">=", "3")
    plain = {"aggregator": "any", "conditions": [one, two]}
    assert rule({"aggregator": "any", "conditions": {"1": one, "1--2": two}}) == rule(plain)
    nested = {"conditions": {"7": {"type": "Combine", "aggregator": "any", "conditions": {"a": one, "b": two}}}}
    assert rule(nested) == rule({"conditions": [{"type": "Combine", **plain}]})


@pytest.mark.parametrize(
    "document",
    [
        {"conditions": "all of them"},
        {"conditions": 7},
        {"conditions": ["x"]},
        {"conditions": [None]},
        {"conditions": [[leaf("Customer.gender", "==", "1")]]},
        {"aggregator": ["all"], "conditions": [leaf("Customer.gender", "==", "1")]},
        {"conditions": [{"type": {"a": 1}}]},
        {"conditions": [{"type": "Customer", "attribute": ["gender"]}]},
        {"conditions": [{"type": "Customer", "attribute": "gender", "operator": {}, "value": 1}, 3]},
        {"conditions": [leaf("Customer.gender", "()", [["1"]])]},
        {"conditions": [leaf("Customer.gender", "==", {"a": {"b": 1}})]},
        {"conditions": [leaf("Customer.dob", ">", "0001-01-01T00:00:00+23:00")]},
        "{\"conditions\": [{\"type\": \"Customer\", \"attribute\": \"email\", \"value\": \"\\ud800\"}]}",
        "{\"conditions\":[" * 100_000 + "]}" * 100_000,
    ],
)
def test_other_shapes_are_rule_errors(document):
    with pytest.raises(RuleError):
        rule(document)


def test_a_keyed_value_is_a_list():
    assert rule({"conditions": [leaf("Customer.gender", "()", {"0": "1", "1": "2"})]}) == rule({"conditions": [leaf("Customer.gender", "()", ["1", "2"])]})
