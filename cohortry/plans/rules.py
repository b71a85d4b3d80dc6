"""Rule trees become SQL predicates.

A rule is a JSON document: groups (``aggregator`` all/any plus ``conditions``) and
leaves (``type``, ``attribute``, ``operator``, ``value``). The last part of a leaf's
type names its family, so both ``"Order"`` and a qualified class path are read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass

from ..functions.values import RuleError, all_of, any_of
from ..operators.conditions import ConditionRegistry, Leaf
from ..operators.features import Feature

GROUP = "Combine"


@dataclass(frozen=True)
class CompiledRule:
    """What a rule needs and says: features, and a predicate over them (NULL: no match).

    ``flips`` are instants, over the features ``moments``, at which time alone may change the answer. ``clauses`` say
    the same as the predicate: in each clause some leaf must hold. None where that form would be too long.
    """

    features: frozenset[Feature]
    predicate: str
    moments: frozenset[Feature] = frozenset()
    flips: frozenset[str] = frozenset()
    clauses: tuple[frozenset[Leaf], ...] | None = None


NOBODY = CompiledRule(frozenset(), "false", clauses=(frozenset(),))
EVERYONE = CompiledRule(frozenset(), "true", clauses=())

#: Clauses of a rule, and leaves of a clause, up to which the form of clauses is kept.
MOST_CLAUSES, MOST_LEAVES = 32, 256


def compile_rule(text: str | None, registry: ConditionRegistry) -> CompiledRule:
    """A missing or unreadable rule matches nobody, an empty one everyone.

    Raises ``RuleError`` for an unknown leaf, operator, aggregator or value format, and for a document of another shape.
    """
    if text is None or text in ("", "0"):
        return NOBODY
    try:
        document = json.loads(text)
    except ValueError:
        return NOBODY
    except RecursionError:
        raise RuleError("nested too deeply") from None
    try:
        return compile_tree(document if isinstance(document, dict) else {}, registry)
    except RecursionError:
        raise RuleError("nested too deeply") from None


def _text(node: dict, name: str, default: str) -> str:
    value = node.get(name)
    if not (value is None or isinstance(value, (str, int, float))):
        raise RuleError(f"{name} is no text: {value!r:.100}")
    return str(value or default)


def _value(node: dict) -> object:
    """A scalar, or a list of scalars; a map counts as the list of its values."""
    value = node.get("value", "")
    value = list(value.values()) if isinstance(value, dict) else value
    if any(isinstance(item, (dict, list)) for item in (value if isinstance(value, list) else [value])):
        raise RuleError(f"neither a value nor a list of values: {value!r:.100}")
    return value


def compile_tree(node: dict, registry: ConditionRegistry) -> CompiledRule:
    """A group; its conditions are a list, or a map of which the keys play no part."""
    conditions = node.get("conditions") or []
    conditions = list(conditions.values()) if isinstance(conditions, dict) else conditions
    if not isinstance(conditions, list):
        raise RuleError(f"conditions are no list: {conditions!r:.100}")
    children = [_child(child, registry) for child in conditions]
    if not children:
        return EVERYONE
    return combine(_text(node, "aggregator", "all"), children)


def _child(node: object, registry: ConditionRegistry) -> CompiledRule:
    if not isinstance(node, dict):
        raise RuleError(f"no condition: {node!r:.100}")
    kind = _text(node, "type", "")
    if GROUP in kind:
        return compile_tree(node, registry)
    family = re.split(r"[\\/.]", kind)[-1]
    leaf = registry.leaf(
        family, _text(node, "attribute", ""), _text(node, "operator", "=="), _value(node)
    )
    return CompiledRule(
        frozenset(leaf.features), leaf.predicate, frozenset(leaf.moments), frozenset(leaf.flips), (frozenset([leaf]),)
    )


def _clauses(aggregator: str, children: list[CompiledRule]) -> tuple[frozenset[Leaf], ...] | None:
    """All: the clauses of all children. Any: one clause of each child, in every combination."""
    parts = [child.clauses for child in children]
    if any(part is None for part in parts):
        return None
    if aggregator == "all":
        found = list(dict.fromkeys(clause for part in parts for clause in part))
    else:
        found = [frozenset()]
        for part in parts:
            found = list(dict.fromkeys(a | b for a in found for b in part))
            if len(found) > MOST_CLAUSES:
                return None
    return tuple(found) if len(found) <= MOST_CLAUSES and all(len(c) <= MOST_LEAVES for c in found) else None


def combine(aggregator: str, children: Iterable[CompiledRule]) -> CompiledRule:
    children = list(children)
    joiner = {"all": all_of, "any": any_of}.get(aggregator)
    if joiner is None:
        raise RuleError(f"unknown aggregator {aggregator!r}")
    return CompiledRule(
        frozenset().union(*[child.features for child in children]),
        joiner([child.predicate for child in children]),
        frozenset().union(*[child.moments for child in children]),
        frozenset().union(*[child.flips for child in children]),
        _clauses(aggregator, children),
    )


def group(aggregator: str, *conditions: dict) -> dict:
    """Write a rule in Python: ``group("all", leaf(...), group("any", ...))``."""
    return {"type": GROUP, "aggregator": aggregator, "value": True, "conditions": list(conditions)}


def leaf(path: str, operator: str, value: object) -> dict:
    family, attribute = path.split(".")
    return {"type": family, "attribute": attribute, "operator": operator, "value": value}
