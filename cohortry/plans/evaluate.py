"""All segments against all customers in one pass over the feature table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame

from ..functions.values import RuleError, instant_literal
from ..operators.conditions import ConditionRegistry
from ..operators.features import Feature, feature_table
from ..session import DRIVER_RULES, SEGMENTS_PER_PASS, int_setting, small_table, written
from ..sources.shop import Shop, active_segments
from .rule_index import indexable, indexed_matches, listed_matches, listed_rules
from .rules import CompiledRule, compile_rule


@dataclass
class RuleSet:
    """Compiled rules by segment id, and why the others could not be compiled.

    ``listed`` holds rules of a large catalogue that are not on the driver (see ``rule_index.listed_rules``).
    """

    rules: dict[int, CompiledRule] = field(default_factory=dict)
    failures: dict[int, str] = field(default_factory=dict)
    listed: DataFrame | None = None

    @property
    def features(self) -> set[Feature]:
        return set().union(*[rule.features for rule in self.rules.values()])

    @property
    def moments(self) -> set[Feature]:
        return set().union(*[rule.moments for rule in self.rules.values()])

    @property
    def flips(self) -> list[str]:
        """The instants at which time alone may change the answer of some rule."""
        return sorted(set().union(*[rule.flips for rule in self.rules.values()]))


def compile_segments(definitions: DataFrame, registry: ConditionRegistry, listed: bool = False) -> RuleSet:
    """Compile the rules of some segments; one bad rule does not stop the others.

    Only ids and rules come to the driver. With ``listed``, where they are more than
    ``spark.cohortry.driverRules``, those that only ask for values do not.
    """
    rules = RuleSet()
    bound = int_setting(definitions.sparkSession, DRIVER_RULES)
    if listed and definitions.select("segment_id").limit(bound + 1).count() > bound:
        rules.listed, definitions = listed_rules(definitions)
    for row in definitions.select("segment_id", "conditions_serialized").collect():
        try:
            rules.rules[row.segment_id] = compile_rule(row.conditions_serialized, registry)
        except RuleError as problem:
            rules.failures[row.segment_id] = str(problem)
    return rules


def _emit(features: DataFrame, rules: list[tuple[int, CompiledRule]]) -> DataFrame:
    """(segment_id, customer_id) for every rule that holds, without a join.

    A single rule is a plain filter: Catalyst then pushes its customer tests into the
    scan and turns the outer joins it can into inner ones.
    """
    if len(rules) == 1:
        [(segment_id, rule)] = rules
        return features.where(rule.predicate).selectExpr(f"{int(segment_id)} AS segment_id", "customer_id")
    hits = ", ".join(f"if({rule.predicate}, {int(segment_id)}, NULL)" for segment_id, rule in rules)
    return features.selectExpr(f"explode(array_compact(array({hits}))) AS segment_id", "customer_id")


def matches_from(features: DataFrame, rules: Mapping[int, CompiledRule]) -> DataFrame:
    """Matches over an existing feature table.

    Rules are evaluated a bounded number at a time: one huge projection would grow
    beyond what the JIT compiles.
    """
    spark = features.sparkSession
    per_pass = int_setting(spark, SEGMENTS_PER_PASS)
    ordered = sorted(rules.items())
    if not ordered:
        return small_table(spark, [], "segment_id int, customer_id bigint")
    passes = [_emit(features, ordered[i : i + per_pass]) for i in range(0, len(ordered), per_pass)]
    return reduce(DataFrame.unionByName, passes)


def matches(
    shop: Shop, rules: RuleSet, now: dt.datetime, registry: ConditionRegistry
) -> DataFrame:
    """Who is in which segment.

    The rules of one pass are a single lazy job over the feature table. Of more rules, those that ask for values go
    through the rule index; for the others the feature table is written once to the shared folder and read by every pass.
    """
    per_pass = int_setting(shop.customer.sparkSession, SEGMENTS_PER_PASS)
    if rules.listed is not None:
        found = listed_matches(shop, rules.listed)
        return found.unionByName(matches(shop, RuleSet(rules.rules), now, registry)) if rules.rules else found
    if len(rules.rules) <= per_pass:
        return matches_from(feature_table(shop, rules.features, now, registry.facts), rules.rules)
    indexed = {segment_id: rule for segment_id, rule in rules.rules.items() if indexable(rule)}
    others = RuleSet({segment_id: rule for segment_id, rule in rules.rules.items() if segment_id not in indexed})
    parts = [indexed_matches(shop, indexed, now, registry)] if indexed else []
    if others.rules:
        features = feature_table(shop, others.features, now, registry.facts)
        if len(others.rules) > per_pass:
            features = written(features, "features")
        parts.append(matches_from(features, others.rules))
    return reduce(DataFrame.unionByName, parts)


def deadlines_from(features: DataFrame, rules: RuleSet, now: dt.datetime) -> DataFrame:
    """(customer_id, due_at): when time alone may next change some answer; customers for whom it never does are left out.

    ``features`` holds the rules' ``moments``.
    """
    instants = ", ".join(rules.flips) or "CAST(NULL AS TIMESTAMP_NTZ)"
    due = f"array_min(filter(array({instants}), due -> due > {instant_literal(now)})) AS due_at"
    return features.selectExpr("customer_id", due).where("due_at IS NOT NULL")


def deadlines(shop: Shop, rules: RuleSet, now: dt.datetime, registry: ConditionRegistry) -> DataFrame | None:
    """The same from the facts, of which only the moments are read; None for rules that time does not change."""
    if not rules.flips:
        return None
    return deadlines_from(feature_table(shop, rules.moments, now, registry.facts), rules, now)


def active_rules(segments: DataFrame, registry: ConditionRegistry, *modes: str, listed: bool = False) -> RuleSet:
    return compile_segments(active_segments(segments, *modes), registry, listed)
